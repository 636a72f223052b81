"""What line dedup leaves on disk, and what it writes on the way."""

import os
import random

from pyspark.sql import functions as F

from factspark import storage
from factspark.llm import line_dedup


def template_lines():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    template = [word() for _ in range(45)]
    lines = []
    for _ in range(300):
        own = [word() for _ in range(15)]
        lines += [" ".join(template + own), " ".join(template + own[:11] + [word() for _ in range(4)])]
    return lines


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names}


def test_intermediate_tables_go(spark):
    df = spark.createDataFrame(list(enumerate(template_lines())), "doc_id long, text string").repartition(4)
    folder = storage.shared_dir(spark).removeprefix("file://")
    before = files(folder)
    got = line_dedup.dedup_lines(df)
    left = {f.removeprefix(folder).split("/")[3].split("-")[0] for f in files(folder) - before}
    assert left == {"gone"}
    assert sum(x.n_removed for x in got.collect()) > 100


def test_no_table_of_all_shingles(spark, monkeypatch):
    """Lines travel as lines: the prefixes are the only rows of shingles with a line that are written."""
    df = spark.createDataFrame(list(enumerate(template_lines())), "doc_id long, text string").repartition(4)
    shingles = df.select(F.sum(F.size(line_dedup.grams(F.col("text"))))).first()[0]
    sizes = {}

    def counted(frame, label, *rest, **named):
        out = storage.materialize(frame, label, *rest, **named)
        values = out.select(F.sum(F.size("found")) if "found" in out.columns else F.count("*")).first()[0]
        sizes[label] = max(values or 0, sizes.get(label, 0))
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    line_dedup.dedup_lines(df).collect()
    assert sizes["prefixes"] > 0 and max(sizes.values()) <= 0.5 * shingles


def test_order_of_shingles_loses_nothing(spark, monkeypatch):
    """With no shingle known as frequent the order is another, and the lines that go are the same."""
    df = spark.createDataFrame(list(enumerate(template_lines())), "doc_id long, text string").repartition(4)
    gone = lambda: {x.doc_id for x in line_dedup.dedup_lines(df).collect() if x.n_removed}
    usual = gone()
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    assert gone() == usual and len(usual) > 100
