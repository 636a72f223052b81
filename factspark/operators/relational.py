"""Patterns, negation, branches and ordered choice over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import value_of, value_text

Branch = Callable[[DataFrame], DataFrame]


def find(df: DataFrame, *columns: str, **attributes) -> DataFrame:
    """Rows with all given attribute values; a list asks for one of several.

    One scan: the conditions and the columns reach the reader.
    """
    for name, value in attributes.items():
        df = df.filter(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == F.lit(value))
    return df.select(*columns) if columns else df


def scan(facts: DataFrame, e=None, a=None, v=None) -> DataFrame:
    """Facts (e, a, v) with the given parts; a number or a text may be given for v."""
    if e is not None:
        facts = facts.filter(F.col("e") == F.lit(e))
    if a is not None:
        facts = facts.filter(F.col("a") == F.lit(a))
    if v is not None:
        facts = facts.filter(F.col("v.n") == F.lit(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else F.col("v.s") == F.lit(str(v).lower() if isinstance(v, bool) else v))
    return facts


def records(facts: DataFrame, attributes: Sequence[str], **constants) -> DataFrame:
    """Entities that have all the attributes, a row for each combination of their values: (e, attribute...).

    Constants restrict by further attributes; a list there asks for all its values.
    """
    needs = [scan(facts, a=name).select("e", F.col("v").alias(name)) for name in attributes]
    for name, value in constants.items():
        for one in value if isinstance(value, (list, tuple)) else [value]:
            needs.append(scan(facts, a=name, v=one).select("e").distinct())
    return reduce(lambda x, y: x.join(y, "e"), needs)


def lookup(df: DataFrame, entity: Column, columns: Sequence[str]) -> DataFrame:
    """The columns of a table as facts: (e, a, v), without nulls."""
    cells = F.array(*[F.struct(F.lit(c).alias("a"), value_of(df, c).alias("v")) for c in columns])
    facts = df.select(entity.alias("e"), F.inline(cells))
    return facts.filter(F.col("v.n").isNotNull() | F.col("v.s").isNotNull())


def attribute_named(df: DataFrame, facts: DataFrame, entity: str, attribute: str, out: str = "value") -> DataFrame:
    """Join each row with the values of the attribute that one of its own columns names."""
    right = facts.select(F.col("e").alias("_e"), F.col("a").alias("_a"), F.col("v").alias(out))
    return df.join(right, (df[entity] == F.col("_e")) & (df[attribute] == F.col("_a"))).drop("_e", "_a")


def exists(outer: DataFrame, inner: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``outer`` with a match."""
    return outer.join(inner.select(*on), list(on), "left_semi")


def not_exists(outer: DataFrame, inner: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Rows of ``outer`` without a match; with nothing in common, all rows or none."""
    if on:
        return outer.join(inner.select(*on), list(on), "left_anti")
    return outer.join(F.broadcast(inner.select(F.lit(1).alias("_any")).limit(1)), F.lit(True), "left_anti")


def union_branches(outer: DataFrame, *branches: Branch) -> DataFrame:
    """The distinct rows of all branches; each must return the same columns."""
    results = [b(outer) for b in branches]
    if any(sorted(r.columns) != sorted(results[0].columns) for r in results):
        raise ValueError("the branches return different columns")
    return reduce(lambda x, y: x.unionByName(y), results).distinct()


def choose(outer: DataFrame, keys: Sequence[str], *branches: Branch) -> DataFrame:
    """The rows of the first branch that has any, for each key.

    Keys are all columns of ``outer`` that some branch depends on. A branch that has
    several rows for its key keeps them all; a key without any is dropped. Conditions
    on the result belong into the branches, as they decide whether it matched.
    """
    results = [b(outer).withColumn("_branch", F.lit(k)) for k, b in enumerate(branches)]
    if any(sorted(r.columns) != sorted(results[0].columns) for r in results):
        raise ValueError("the branches return different columns")
    every = reduce(lambda x, y: x.unionByName(y), results)
    first = F.min("_branch").over(Window.partitionBy(*keys))
    return every.withColumn("_first", first).filter("_branch = _first").drop("_branch", "_first").distinct()


def choose_value(*cases: tuple[Column, Column], otherwise: Column | None = None) -> Column:
    """The value of the first case whose condition holds: a choice that needs no join."""
    out = F.when(*cases[0])
    for case in cases[1:]:
        out = out.when(*case)
    return out.otherwise(otherwise) if otherwise is not None else out


def choose_or_default(outer: DataFrame, found: DataFrame, keys: Sequence[str], **defaults) -> DataFrame:
    """The columns found for a row, or defaults: a choice of two branches as one outer join."""
    joined = outer.join(found, list(keys), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(x)) for c, x in defaults.items()})


def fact_text(facts: DataFrame) -> DataFrame:
    """Facts with the value as its canonical text."""
    return facts.select("e", "a", value_text("v").alias("v"))
