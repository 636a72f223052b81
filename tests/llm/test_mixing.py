"""Targets and budgets of the mix."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from factspark.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Share by weight, stop what is above its cap, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return target


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STRETCH", 20)
    r = random.Random(2)
    names = ["b", "a", None, "ü", "zz", "Z", ""]
    rows = [(i, "w " * r.choice([0, 1, 5, 50, 300]), r.choice(names + ["a"] * 8)) for i in range(800)] + [(900, None, "only-null"), (901, "x", "one"), (None, "a b c", "a"), (None, "a b c", "a"), (901, "x", "one")]
    docs = spark.createDataFrame([(i, t, s, 0, 0.0) for i, t, s in rows], "doc_id long, text string, source string, size int, target double").repartition(6)
    quality = spark.createDataFrame([(i, 2.0) for i in range(0, 800, 3)] + [(5, -1.0), (5, None), (None, 3.0)], "doc_id long, weight double")
    out = mixing.mix(docs, quality).collect()
    assert len(out) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for x in out:
        sizes[x.source] += x.size
        taken[x.source] += x.taken
        target[x.source] = x.target
        assert 0 <= x.taken <= 2 * x.size
    want = brute_targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s]) and taken[s] == int(target[s] + 1e-9) and target[s] <= 2 * sizes[s]
    assert sorted(map(str, mixing.mix(docs.repartition(3), quality).collect())) == sorted(map(str, out))
    # Complete epochs come first, and better documents are drawn sooner.
    for x in out:
        assert x.taken >= x.epochs * x.size
    good = {i for i in range(0, 800, 3)}
    extra = lambda k: [bool(x.taken > x.epochs * x.size) for x in out if x.source == "a" and x.size and x.doc_id is not None and (x.doc_id in good) == k]
    assert sum(extra(True)) / len(extra(True)) > sum(extra(False)) / len(extra(False))


def test_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], schema)).collect()] == [0, 0]
    u = spark.range(5000).select(mixing.uniform(1, F.col("id")).alias("u")).agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 < u[0] < 0.01 and 0.99 < u[1] < 1 and abs(u[2] - 0.5) < 0.02
