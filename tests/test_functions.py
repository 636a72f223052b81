"""Scalar functions where a naive expression would differ."""

import math

import pytest
from pyspark.sql import functions as F

from factspark.functions import scalar as fn
from factspark.functions import values


def one(spark, column, **row):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in row.items()) or "_x double"
    rows = [tuple(float(v) if isinstance(v, int) else v for v in row.values())] if row else [(0.0,)]
    return spark.createDataFrame(rows, schema).select(column).first()[0]


@pytest.mark.parametrize(
    "x, text",
    [
        (1.0, "1"), (-0.0, "0"), (0.5, "0.5"), (-2.25, "-2.25"), (12345678.0, "12345678"), (123456789.125, "123456789.125"), (1e20, "100000000000000000000"), (1e21, "1e+21"),
        (1.5e300, "1.5e+300"), (0.0001, "0.0001"), (0.000001, "0.000001"), (1e-7, "1e-7"), (-1.25e-9, "-1.25e-9"), (float("nan"), "NaN"), (float("-inf"), "-Infinity"), (1234567.75, "1234567.75"), (2.0**53, "9007199254740992"),
    ],
)
def test_number_text(spark, x, text):
    assert one(spark, values.number_text(F.col("x")), x=x) == text


def test_division_and_logs(spark):
    x, y = F.col("x"), F.col("y")
    assert one(spark, fn.divide(x, y), x=1, y=0) == math.inf and one(spark, fn.divide(x, y), x=-1, y=0) == -math.inf
    assert math.isnan(one(spark, fn.divide(x, y), x=0, y=0)) and math.isnan(one(spark, fn.modulo(x, y), x=5, y=0))
    assert one(spark, fn.modulo(x, y), x=-7, y=3) == -1
    assert one(spark, fn.natural_log(x), x=0) == -math.inf and math.isnan(one(spark, fn.natural_log(x), x=-1))
    assert math.isnan(one(spark, fn.minimum(x, y), x=float("nan"), y=1)) and one(spark, fn.maximum(x, y), x=2, y=1) == 2


def test_rounding(spark):
    assert [one(spark, fn.round_half_up(F.col("x")), x=v) for v in (2.5, -2.5, 2.4, -2.6)] == [3, -2, 2, -3]
    assert one(spark, fn.to_fixed(F.col("x"), 2), x=1234.5) == "1234.50"


def test_bases(spark):
    assert one(spark, fn.convert_base(F.col("x"), 16), x=255) == "ff" and one(spark, fn.convert_base(F.col("x"), 2), x=-5) == "-101"
    assert one(spark, fn.convert_base(F.col("x"), 37), x=5) is None and one(spark, fn.convert_base(F.col("x"), 10), x=0.5) is None


def test_ranges(spark):
    r = lambda a, b: one(spark, fn.range_values(F.col("a"), F.col("b")), a=a, b=b)
    assert r(1, 3) == [1, 2, 3] and r(3, 1) == [1, 2, 3] and r(0.5, 2) == [0.5, 1.5] and r(2, 2) == [2]
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    assert fn.apply_rows(df, "math/range", "i", df.a, df.b).count() == 0


def test_texts(spark):
    s = F.col("s")
    assert one(spark, fn.character_at(s, F.lit(2)), s="aé😀") == "é" and one(spark, fn.character_at(s, F.lit(4)), s="aé😀") is None
    assert one(spark, fn.index_of(s, F.lit("z")), s="abc") is None and one(spark, fn.index_of(s, F.lit("c")), s="abc") == 3
    assert one(spark, fn.replace(s, F.lit("."), F.lit("-")), s="a.b.c") == "a-b-c" and one(spark, fn.codepoint_length(s), s="😀") == 1
    assert one(spark, fn.toggle(s), s="true") == "false" and one(spark, fn.toggle(s), s="x") is None
    assert one(spark, fn.loose_equal(F.lit(1.0), s), s="1") and not one(spark, fn.loose_equal(F.lit(1.0), s), s="a")
    assert one(spark, fn.date_format(F.lit(0), "yyyy-mm-dd HH:MM:ss dddd")) == "1970-01-01 00:00:00 Thursday"


def test_random_and_registry(spark):
    a = one(spark, fn.random_number(F.lit("seed")))
    assert 0 <= a < 1 and a == one(spark, fn.random_number(F.lit("seed"))) != one(spark, fn.random_number(F.lit("other")))
    fn.define_function("test/half", lambda x: x / 2)
    df = spark.createDataFrame([(1.0, 0.5), (4.0, 3.0)], "x double, y double")
    assert fn.apply(df, "test/half", "h", df.x).count() == 2 and [r.x for r in fn.apply(df, "test/half", "y", df.x).collect()] == [1.0]
    with pytest.raises(ValueError):
        fn.define_function("test/half", abs)
    del fn.FUNCTIONS["test/half"]
    assert len(fn.FUNCTIONS) >= 36


def test_ids(spark):
    df = spark.createDataFrame([(1.0, "x", True)], "b double, a string, c boolean")
    assert df.select(values.record_id(df, ["t", "u"], ["b", "a", "c"])).first()[0] == "tag|t|tag|u|a|x|b|1|c|true"
