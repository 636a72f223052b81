"""Restarts, exact values, files and connectors."""

import decimal

import pytest
from pyspark.sql import functions as F

from factspark.functions import scalar as fn
from factspark.functions.values import value_of
from factspark.operators import aggregates as agg
from factspark.operators import records as rec
from factspark.operators import relational as rel
from factspark.plans import program as prog
from factspark.sources import inputs, outputs
from factspark.streaming import runner


def test_restart_goes_on(spark, tmp_path):
    """A new program with the same checkpoint keeps the facts and tells only what is new."""
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "ck")

    def run(rows):
        spark.createDataFrame(rows, "e string, x double").write.mode("append").parquet(source)
        heard = []
        p = prog.Program(spark).watch("x", lambda f: rel.scan(f, a="x").select("e"), outputs.collector(heard))
        stream = spark.readStream.schema("e string, x double").parquet(source)
        runner.feed(stream, p, lambda b: b.select(F.lit("add").alias("op"), "e", F.lit("x").alias("a"), rec.number(F.col("x")).alias("v")), checkpoint=checkpoint)
        return sorted(r.e for r in p.stored.collect()), [sorted(e for (e,) in came) for came, _ in heard]

    assert run([("a", 1.0), ("b", 2.0)]) == (["a", "b"], [["a", "b"]])
    assert run([("c", 3.0)]) == (["a", "b", "c"], [["c"]])


def test_program_rules_in_any_order(spark):
    """Rules bound without hints are complete, also through a cycle."""
    copy = lambda a, b: lambda f: rel.scan(f, a=a).select("e", F.lit(b).alias("a"), "v")
    p = prog.Program(spark).bind("yz", copy("y", "z")).bind("zx", copy("z", "x")).bind("xy", copy("x", "y"))
    p.input(prog.changes(spark, [("add", "e", "x", 1)]))
    assert sorted(r.a for r in p.facts().collect()) == ["x", "y", "z"]


def test_limits_with_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 6)], "k int, x int")
    one = sorted(r.k for r in agg.limit_to(df, ["x"], 2).collect())
    assert one == sorted(r.k for r in agg.limit_to(df.withColumn("g", F.lit(0)), ["x"], 2, per=["g"]).collect()) == [1, 2]
    assert [r.k for r in agg.best_per(df, ["x"]).collect()] == [1]


def test_not_equal_of_mixed_types(spark):
    df = spark.createDataFrame([(1.0, "1"), (1.0, "2"), (1.0, "x"), (None, "x")], "n double, s string")
    assert [r[0] for r in df.select(fn.not_equal(df.n, df.s)).collect()] == [False, True, True, None]
    assert [r[0] for r in df.select(fn.not_equal(df.s, F.lit("1"))).collect()] == [False, True, True, True]


def test_values_keep_their_digits(spark):
    df = spark.createDataFrame([(2**53, decimal.Decimal("1.5")), (2**53 + 1, decimal.Decimal("0.123456789012345678")), (-(2**63), None)], "i bigint, d decimal(38,18)")
    assert [tuple(r[0]) for r in df.select(value_of(df, "i")).collect()] == [(2.0**53, None), (None, str(2**53 + 1)), (None, str(-(2**63)))]
    got = [tuple(r[0]) for r in df.select(value_of(df, "d")).collect()]
    assert got[0] == (1.5, None) and got[1][1] == "0.123456789012345678"


def test_files_of_other_names_stay(spark, tmp_path):
    folder = str(tmp_path / "out")
    schema = "name string, contents string"
    outputs.write_texts(spark.createDataFrame([("a", "one"), ("b", "two")], schema), folder)
    done = outputs.write_texts(spark.createDataFrame([("b", "three"), ("c", "x"), ("c", "y"), (None, "z"), ("d", None)], schema), folder)
    assert {r.name: r.error for r in done.collect()} == {"b": None, "c": "several contents", None: "no name", "d": "no contents"}
    assert {r.name: r.value for r in spark.read.text(folder).collect()} == {"a": "one", "b": "three"}
    (tmp_path / "x y").write_text("plain")
    paths = spark.createDataFrame([(str(tmp_path / "x y"),), (str(tmp_path / "none"),), (str(tmp_path),)], "path string")
    assert {(r.contents, r.error) for r in inputs.read_texts(spark, paths).collect()} == {("plain", None), (None, "ENOENT")}


def test_connectors(spark):
    p = prog.Program(spark).register("one", lambda q: q.bind("b", lambda f: f))
    with pytest.raises(ValueError):
        p.register("one", lambda q: None)
    assert "b" in p.attach("one").binds
    with pytest.raises(KeyError):
        p.unregister("one").attach("one")
