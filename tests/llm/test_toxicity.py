"""The classifier on held-out labels, and its edges."""

import random
import zlib

from pyspark.sql import functions as F

from factspark.llm import toxicity


def texts(n, seed):
    r = random.Random(seed)
    plain = ["le", "café", "river", "stone", "walks", "under", "bridge", "très", "日本"]
    rude = ["grumblax", "fznord", "blörk"]
    rows = []
    for i in range(n):
        words = [r.choice(plain) + r.choice(["", "s", "ing"]) for _ in range(r.randrange(3, 120))]
        bad = r.random() < 0.15
        if bad:
            for _ in range(r.randrange(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(rude).upper())
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_held_out(spark):
    rows = texts(1200, 1)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.with_score(docs, toxicity.train_on_labels(docs, labels), "score").collect()}
    kept = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i].score >= 0.5) == bool(y) for i, y in kept) >= 0.98 * len(kept)
    marks = {r.id: r.h for r in spark.range(1000).withColumn("h", toxicity.held_out(F.col("id"))).collect()}
    assert marks == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(1000)}


def test_held_out_labels_do_not_matter(spark):
    rows = texts(300, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
    a, b = (toxicity.train_on_labels(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in ([(i, y) for i, _, y in rows], flip))
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_edges(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(1, None), (None, ""), (3, " .. "), (4, "x" * 100_000), (4, "dup")], schema)
    for labels in ([], [(1, 0)], [(1, 1), (3, 1)], [(1, None), (None, 1)], [(1, 1), (3, 0), (4, 0), (4, 1)]):
        model = toxicity.train_on_labels(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        out = toxicity.with_score(docs, model).collect()
        assert len(out) == 5 and all(0 <= r.toxicity <= 1 for r in out)
    assert toxicity.with_score(spark.createDataFrame([], schema), model).collect() == []


def test_whole_text_counts(spark):
    model = toxicity.train(spark.createDataFrame(texts(600, 3), "doc_id long, text string, toxic int"))
    long = "river stone " * 50_000
    low, high = toxicity.scores([long, long + " grumblax fznord grumblax"], model)
    assert low < 0.5 <= high
