"""Patterns, branches, aggregates and sources on small tables."""

import pytest
from pyspark.sql import functions as F

from factspark.operators import aggregates as agg
from factspark.operators import records as rec
from factspark.operators import recursion
from factspark.operators import relational as rel
from factspark.plans import program as prog
from factspark.sources import inputs, outputs
from factspark.streaming import runner


@pytest.fixture(scope="module")
def people(spark):
    rows = [("a", "tag", "person"), ("a", "tag", "old"), ("a", "name", "Ann"), ("a", "age", 7), ("b", "tag", "person"), ("b", "age", 30), ("c", "age", 7), ("a", "dog", "d"), ("d", "weight", 4)]
    return prog.changes(spark, [("add", e, a, v) for e, a, v in rows]).select("e", "a", "v")


def test_patterns(people):
    assert sorted(r.e for r in rel.records(people, ["age"], tag="person").collect()) == ["a", "b"]
    assert [r.e for r in rel.records(people, ["age"], tag=["person", "old"]).collect()] == ["a"]
    dogs = rel.records(people, ["dog"]).select("e", F.col("dog.s").alias("d"))
    weights = rel.records(people, ["weight"]).select(F.col("e").alias("d"), F.col("weight.n").alias("w"))
    assert [(r.e, r.w) for r in dogs.join(weights, "d").collect()] == [("a", 4.0)]
    assert rel.scan(people, v=7).count() == 2 and rel.scan(people, v="7").count() == 0
    assert rel.scan(people, e="a", a="tag").count() == 2


def test_choose_keys_and_branches(spark):
    outer = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, s string")
    many = spark.createDataFrame([(1, "p"), (1, "q")], "k int, v string")
    got = rel.choose(outer, ["k"], lambda o: o.join(many, "k").select("k", "v"), lambda o: o.filter("k < 3").select("k", F.col("s").alias("v")))
    assert sorted(map(tuple, got.collect())) == [(1, "p"), (1, "q"), (2, "y")]
    for f in (lambda *b: rel.choose(outer, ["k"], *b), lambda *b: rel.union_branches(outer, *b)):
        with pytest.raises(ValueError):
            f(lambda o: o.select("k"), lambda o: o.select("s"))
    assert rel.not_exists(outer, many).count() == 0 and rel.not_exists(outer, many.limit(0)).count() == 3


def test_ranks(spark):
    df = spark.createDataFrame([("g", 3), ("g", 1), ("g", 3), ("h", 2), ("h", None)], "g string, x int")
    got = sorted(((r.g, r.x, r.sort) for r in agg.gather_sort(df, ["x"], "down").collect()), key=str)
    assert got == [("g", 1, 3), ("g", 3, 1), ("g", 3, 1), ("h", 2, 2), ("h", None, 4)]
    assert sorted(((r.g, r.x, r.sort) for r in agg.gather_sort(df.na.drop(), ["x"], per=["g"]).collect())) == [("g", 1, 1), ("g", 3, 2), ("g", 3, 2), ("h", 2, 1)]
    big = spark.range(1000).select((F.col("id") % 100).alias("x"))
    assert {(r.x, r.sort) for r in agg.gather_sort(big, ["x"]).collect()} == {(x, x + 1) for x in range(100)}
    with pytest.raises(ValueError):
        agg.gather_sort(df, ["x"], "sideways")


def test_set_projected_sum(spark):
    df = spark.createDataFrame([("g", 1, 5), ("g", 1, 5), ("g", 2, 5), ("h", 1, 1)], "g string, k int, v int")
    assert sorted(map(tuple, agg.gather_sum(df, ["k"], "v", ["g"]).collect())) == [("g", 10), ("h", 1)]
    assert sorted(map(tuple, agg.gather_sum(df, [], "v", ["g"]).collect())) == [("g", 5), ("h", 1)]
    assert agg.gather_count(df.limit(0), ["k"]).collect() == []


def test_fixpoint_limit(spark):
    with pytest.raises(RuntimeError):
        recursion.fixpoint(spark.range(1), lambda new, known: new.select((F.col("id") + 1).alias("id")), most_rounds=3)


def test_nested_and_objects(spark):
    df = spark.createDataFrame([("r", 1.5, True, ("x", [1, 2]), [("p",), ("q",)])], "id string, n double, ok boolean, sub struct<name:string,nums:array<int>>, kids array<struct<name:string>>")
    got = sorted((r.e, r.a, r.v) for r in rel.fact_text(rec.flatten(df, "id")).collect())
    assert got == [("r", "kids", "r|kids|0"), ("r", "kids", "r|kids|1"), ("r", "n", "1.5"), ("r", "ok", "true"), ("r", "sub", "r|sub"), ("r|kids|0", "index", "1"), ("r|kids|0", "name", "p"),
                   ("r|kids|1", "index", "2"), ("r|kids|1", "name", "q"), ("r|sub", "name", "x"), ("r|sub", "nums", "1"), ("r|sub", "nums", "2")]
    facts = rec.flatten(df, "id")
    assert [r["n"] for r in rec.objects(facts.filter("e = 'r'"), ["n", "ok"]).collect()] == ["1.5"]
    with pytest.raises(Exception, match="several values"):
        rec.objects(facts, ["nums"]).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line 1\nliné 2")
    paths = spark.createDataFrame([(str(tmp_path / "a.txt"),), (str(tmp_path / "none.txt"),)], "path string")
    got = {r.path.rsplit("/")[-1]: (r.contents, r.error) for r in inputs.read_texts(spark, paths).collect()}
    assert got == {"a.txt": ("line 1\nliné 2", None), "none.txt": (None, "ENOENT")}
    done = outputs.write_texts(spark.createDataFrame([("x", "one"), ("y", "two")], "name string, contents string"), str(tmp_path / "out"))
    assert done.count() == 2 and spark.read.text(str(tmp_path / "out" / "name=x")).first()[0] == "one"


def test_streams(spark, tmp_path):
    rows = [(i, i % 3, f"t{i % 2}") for i in range(30)]
    spark.createDataFrame(rows, "event_id long, user_id long, kind string").repartition(4).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("event_id long, user_id long, kind string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert {(r.user_id, r.event_id) for r in runner.latest_of(spark, stream(), ["user_id"], ["event_id"]).collect()} == {(0, 27), (1, 28), (2, 29)}
    assert {(r.kind, r.n) for r in runner.counts_of(spark, stream(), ["kind"]).collect()} == {("t0", 15), ("t1", 15)}
    p = prog.Program(spark)
    runner.feed(stream(), p, lambda b: rec.set_value(b, F.col("user_id").cast("string"), F.lit("kind"), rec.text(F.col("kind"))))
    assert {r.e for r in p.facts().collect()} == {"0", "1", "2"}
    assert inputs.timer(spark).isStreaming
