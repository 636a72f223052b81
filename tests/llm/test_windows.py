"""Word-window and byte-string dedup against brute force."""

import hashlib
import random

import pytest

from factspark.llm import substring_dedup, suffix_dedup


def brute(texts, split, join, width):
    tokens = {i: split((t or "").encode()) for i, t in texts}
    first = {}
    for i, ws in tokens.items():
        for k in range(len(ws) - width + 1):
            w = tuple(ws[k : k + width])
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, ws in tokens.items():
        gone = [False] * len(ws)
        for k in range(len(ws) - width + 1):
            if first[tuple(ws[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(ws), sum(gone), runs, hashlib.sha256(join([w for w, g in zip(ws, gone) if not g])).hexdigest())
    return out


def corpus(seed, n=120):
    r = random.Random(seed)
    vocabulary = ["a", "bé", "the", "of", "xyzzy", "日本", "lorem", "ipsum", " x"]
    passage = [r.choice(vocabulary) + str(r.randrange(30)) for _ in range(70)]
    docs = []
    for i in range(n):
        words = [r.choice(vocabulary) + str(r.randrange(30)) for _ in range(r.randrange(90))]
        if i % 3 == 0:
            at = r.randrange(len(words) + 1)
            a = r.randrange(10)
            words[at:at] = passage[a : len(passage) - r.randrange(10)]
        if i % 7 == 0 and docs:
            words = docs[r.randrange(len(docs))][1].split(" ") + words[:5]
        docs.append((i * 3 + 1, " ".join(words)))
    docs += [(5, None), (8, ""), (11, " \t\n"), (14, "a " * 200), (17, "a " * 150), (20, "aaaa" * 60), (23, "aaaa" * 50)]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, spans int, kept string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, len(r.spans), hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup.dedup_words(df).collect()}
    assert got == brute(docs, bytes.split, b" ".join, 50)


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.dedup_bytes(df).collect()}
    assert got == brute(docs, lambda b: [b[k : k + 1] for k in range(len(b))], b"".join, 50)


def test_common_passage_is_compared_once(spark):
    """A passage in most documents makes its grams frequent; results stay exact."""
    r = random.Random(3)
    passage = [f"p{r.randrange(10**6)}" for _ in range(80)]
    docs = [(i, " ".join([f"w{r.randrange(10**6)}" for _ in range(30)] + passage[i % 5 :] + [f"v{r.randrange(10**6)}" for _ in range(20)])) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_words, x.n_removed, len(x.spans), hashlib.sha256(x.kept.encode()).hexdigest()) for x in substring_dedup.dedup_words(df).collect()}
    assert got == brute(docs, bytes.split, b" ".join, 50)
    small = docs[:120]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in suffix_dedup.dedup_bytes(spark.createDataFrame(small, "doc_id long, text string")).collect()}
    assert got == brute(small, lambda b: [b[k : k + 1] for k in range(len(b))], b"".join, 50)


def test_edges(spark):
    schema = "doc_id long, text string"
    for f in (substring_dedup.dedup_words, suffix_dedup.dedup_bytes):
        assert f(spark.createDataFrame([], schema)).collect() == []
        text = " ".join(f"w{k}" for k in range(60))
        rows = f(spark.createDataFrame([(None, text), (None, text), (1, text), (1, text), (2, text)], schema)).collect()
        assert sorted((str(r.doc_id), r.n_removed > 0) for r in rows) == [("1", False), ("1", False), ("2", True), ("None", False), ("None", False)]
