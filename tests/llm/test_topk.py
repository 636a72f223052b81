"""Top-k against brute force."""

import math
import random

import numpy as np

from factspark.llm import topk


def brute(rows, k=20, every=20):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_topk(spark, monkeypatch):
    r = random.Random(1)
    centres = [[r.gauss(0, 1) for _ in range(24)] for _ in range(6)]
    rows = [(i, [c + r.gauss(0, 0.2) for c in r.choice(centres)]) for i in range(700)]
    rows += [(i, centres[0]) for i in range(700, 800)]  # ties
    rows += [(900, None), (901, [None] * 24), (902, [float("nan")] * 24), (903, [float("inf")] * 24), (None, centres[1]), (920, [1.0, 2.0]), (921, [1.0, 3.0]), (940, [])]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(6)
    want = brute(rows)
    assert sorted(tuple(x) for x in topk.top_k(df).collect()) == want
    for name, size in (("SLICE", 100), ("BLOCK", 8), ("PACK", 16)):
        monkeypatch.setattr(topk, name, size)
    assert sorted(tuple(x) for x in topk.top_k(df).collect()) == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_bounds_hold_and_prune():
    r = np.random.default_rng(2)
    q = r.integers(-40, 40, (30, 64))
    v = np.concatenate((q + r.integers(-2, 3, q.shape), r.integers(-3, 3, (5000, 64))))
    for s in topk.RESOLUTIONS:
        bound = topk._segment_features(q.astype(float), s) @ topk._segment_features(v.astype(float), s).T
        assert (bound + 1e-6 >= q @ v.T).all()
    a, b, c = topk.best_of_slice(q, np.arange(30), v, np.arange(100, 100 + len(v)), 5)
    want = [(i, *x) for i in range(30) for x in sorted(((-int(s), 100 + j) for j, s in enumerate(v @ q[i])))[:5]]
    assert [(x, -s, y) for x, y, s in zip(a.tolist(), b.tolist(), c.tolist())] == want


def test_huge_components(spark):
    """Finite components of any size: scores end at the range of a long."""
    rows = [(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 0.0]), (3, [1e8, 1e8])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1, 2**63 - 1), (2, 3, 2**63 - 1), (3, 2, -(2**63))]
