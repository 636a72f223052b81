"""Aggregates of one's own: what they give, and how many calls they cost."""

import pandas as pd

from factspark.operators import aggregates as agg


def test_small_groups_are_one_part(spark):
    df = spark.createDataFrame([(k % 100, k // 100) for k in range(2000)], "k int, v long")
    # The step counts its calls: one for each group, not one for each hash part of it.
    calls = agg.custom_aggregate(df, ["k"], "v", "double", "n", lambda v: 1.0, lambda v: float(v.sum()))
    assert [r.n for r in calls.collect()] == [1.0] * 100


def test_hot_groups_nulls_and_large_integers(spark):
    big = 2**60 + 1
    rows = [("hot", k) for k in range(5000)] * 2 + [(None, big), (None, big), ("null", None), ("null", 3), ("odd", big), ("odd", None)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(3)
    sums = agg.custom_aggregate(df, ["k"], "v", "long", "s", lambda v: int(v.dropna().sum()))
    got = {r.k: r.s for r in sums.collect()}
    assert got["hot"] == 5000 * 4999 // 2 and got[None] == big and got["null"] == 3 and set(got) == {"hot", None, "null", "odd"}
    parts = agg.custom_aggregate(df, ["k"], "v", "double", "n", lambda v: float(len(v) < 3000), lambda v: float(len(v)))
    got = {r.k: r.n for r in parts.collect()}
    assert got["hot"] == 5 and got["null"] == 1
    assert agg.custom_aggregate(df, [], "v", "double", "m", lambda v: float(v.max())).first().m == float(big)
    assert agg.custom_aggregate(df.filter("k = 'none'"), ["k"], "v", "double", "m", lambda v: float(pd.Series(v).max())).collect() == []
