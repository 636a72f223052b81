"""Values of facts: one canonical text for each, and a typed pair for mixed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
#: A value in a fact: exactly one of a number and a string.
VALUE = "struct<n:double,s:string>"


def number_text(x: Column) -> Column:
    """A double's shortest text, without a fraction if it has none and without an exponent from 1e-6 to 1e21."""
    x = x.cast("double")
    plain = x.cast("string")
    sign = F.when(plain.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(plain, r"-?([0-9.]+)", 1), r"\.0$", ""), r"\.", "")
    power = F.coalesce(F.regexp_extract(plain, r"E(-?\d+)", 1).try_cast("int"), F.lit(0))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    large = F.concat(sign, digits, F.repeat(F.lit("0"), F.greatest(F.lit(0), power + 1 - F.length(digits))))
    fraction = F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, 2, 400))).otherwise("")
    scientific = F.concat(sign, F.substring(digits, 1, 1), fraction, F.when(power > 0, "e+").otherwise("e"), power.cast("string"))
    return (
        F.when(x == 0, "0")
        .when(~plain.contains("E"), F.regexp_replace(plain, r"\.0$", ""))
        .when((power < 0) & (power >= -6), small)
        .when((power >= 0) & (power < 21), F.when(F.length(digits) > power + 1, F.format_string("%s%s.%s", sign, F.substr(digits, F.lit(1), power + 1), F.substr(digits, power + 2))).otherwise(large))
        .otherwise(scientific)
    )


def canonical(df: DataFrame, column: str) -> Column:
    """The canonical text of a column: numbers as above, booleans as true and false."""
    kind = dict(df.dtypes)[column]
    if kind in ("float", "double"):
        return number_text(F.col(column))
    return F.col(column).cast("string")


def value_of(df: DataFrame, column: str) -> Column:
    """The column as a value of a fact; booleans are the strings true and false.

    Whole numbers past 2**53 and decimals that no double equals keep all their digits as
    a text, so that different numbers stay different.
    """
    kind, x = dict(df.dtypes)[column], F.col(column)
    if kind == "bigint" or kind.startswith("decimal"):
        exact = x.between(-(2**53), 2**53) if kind == "bigint" else F.coalesce(x.cast("double").try_cast(kind) == x, F.lit(False))
        return F.struct(F.when(exact, x.cast("double")).alias("n"), F.when(~exact, x.cast("string")).alias("s"))
    if kind in NUMBERS:
        return F.struct(x.cast("double").alias("n"), F.lit(None).cast("string").alias("s"))
    return F.struct(F.lit(None).cast("double").alias("n"), F.col(column).cast("string").alias("s"))


def value_text(v: str) -> Column:
    """The canonical text of a value."""
    return F.coalesce(number_text(F.col(f"{v}.n")), F.col(f"{v}.s"))


def record_id(df: DataFrame, tags: list[str], attributes: list[str]) -> Column:
    """An id made from the record's content: tags, then attributes by name, joined by pipes.

    Equal contents give equal ids, so deriving a record again changes nothing.
    """
    parts: list[Column] = []
    for tag in tags:
        parts += [F.lit("tag"), F.lit(tag)]
    for name in sorted(attributes):
        parts += [F.lit(name), canonical(df, name)]
    return F.concat_ws("|", *parts)
