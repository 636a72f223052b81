"""Aggregates over sets: sums, counts and ranks of distinct projections."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


def gather_sum(df: DataFrame, projection: Sequence[str], value: str, per: Sequence[str] = (), name: str = "sum", unique: bool = False) -> DataFrame:
    """Sum of ``value`` over the distinct (projection, value) rows of each group.

    ``unique`` says that the projection holds a key of ``df``, so that nothing has to
    be made distinct and the sum is one shuffle of partial sums.
    """
    if not unique:
        df = df.select(*dict.fromkeys([*per, *projection, value])).distinct()
    return df.groupBy(*per).agg(F.sum(value).alias(name))


def gather_count(df: DataFrame, projection: Sequence[str], per: Sequence[str] = (), name: str = "count", unique: bool = False) -> DataFrame:
    """Number of distinct projections in each group; an empty group has no row."""
    if not unique:
        df = df.select(*dict.fromkeys([*per, *projection])).distinct()
    counted = df.groupBy(*per).agg(F.count(F.lit(1)).alias(name))
    return counted.filter(F.col(name) > 0)


def with_group(df: DataFrame, groups: DataFrame, per: Sequence[str]) -> DataFrame:
    """Every row with its group's aggregate."""
    return df.join(groups, list(per)) if per else df.crossJoin(F.broadcast(groups.limit(1)))


def order_by(columns: Sequence[str], directions: Sequence[str]) -> list[Column]:
    """Directions are up or down; missing ones repeat the last, and up is the first."""
    out, last = [], "up"
    for k, c in enumerate(columns):
        last = directions[k] if k < len(directions) else last
        if last not in ("up", "down"):
            raise ValueError(f"a direction is up or down, not {last}")
        out.append(F.desc(c) if last == "down" else F.asc(c))
    return out


def gather_sort(df: DataFrame, projection: Sequence[str], *directions: str, per: Sequence[str] = (), name: str = "sort") -> DataFrame:
    """Every row with the place of its projection among the distinct ones of its group, from 1.

    Without groups the distinct projections are range-partitioned, numbered in each
    range and shifted by the sizes of the ranges before, so no task sorts everything.
    """
    order = order_by(projection, directions)
    if per:
        return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*per).orderBy(*order)))
    distinct = df.select(*projection).distinct()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(distinct.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = ranged.withColumn("_inner", inner).join(F.broadcast(before), "_range").withColumn(name, (F.col("_inner") + F.col("_before")).cast("int"))
    same = None
    right = placed.select(*[F.col(c).alias(f"_{c}") for c in projection], name)
    for c in projection:
        same = df[c].eqNullSafe(F.col(f"_{c}")) if same is None else same & df[c].eqNullSafe(F.col(f"_{c}"))
    return df.join(right, same).drop(*[f"_{c}" for c in projection])


def limit_to(df: DataFrame, projection: Sequence[str], n: int, *directions: str, per: Sequence[str] = ()) -> DataFrame:
    """Rows whose projection is among the first ``n`` distinct ones of its group."""
    order = order_by(projection, directions)
    if per:
        return df.withColumn("_place", F.dense_rank().over(Window.partitionBy(*per).orderBy(*order))).filter(F.col("_place") <= n).drop("_place")
    first = df.select(*[F.col(c).alias(f"_{c}") for c in projection]).distinct().orderBy(*order_by([f"_{c}" for c in projection], directions)).limit(n)
    # Nulls are projections like others: they come first going up.
    return df.join(F.broadcast(first), reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in projection]), "left_semi")


def best_per(df: DataFrame, projection: Sequence[str], *directions: str, per: Sequence[str] = ()) -> DataFrame:
    """Rows whose projection comes first in its group."""
    return limit_to(df, projection, 1, *directions, per=per)


def custom_aggregate(df: DataFrame, per: Sequence[str], value: str, schema: str, name: str, step: Callable[[pd.Series], float], merge: Callable[[pd.Series], float] | None = None, part: int = 1000) -> DataFrame:
    """An aggregate of one's own over the distinct values of each group, by functions of a pandas Series.

    Groups of over ``part`` values are dealt by hash to parts of about that many, so
    that a hot group is not one task's; ``step`` sees one part, and ``merge`` (``step``
    itself, if not given) the results of all parts. So the aggregate must be one that
    partial results can make, as sums, products and extremes are. Groups travel as
    lists, thousands in a batch, so a small one costs little more than the call.
    """
    parts = [f"_per{k}" for k in range(len(per))]
    distinct = df.select(*[F.col(c).alias(p) for c, p in zip(per, parts, strict=True)], F.col(value).alias("_value")).distinct()
    large = distinct.groupBy(*parts).agg(F.count("*").alias("_n")).filter(F.col("_n") > part)
    large = large.select(F.struct(*parts).alias("_group"), F.ceil(F.col("_n") / part).alias("_parts"))
    salted = distinct.join(F.broadcast(large), F.struct(*parts).eqNullSafe(F.col("_group")), "left")
    salted = salted.withColumn("_part", F.coalesce(F.pmod(F.xxhash64("_value"), F.col("_parts")), F.lit(0)))
    # Structs, because a list leaves nulls out.
    lists = salted.groupBy(*parts, "_part").agg(F.collect_list(F.struct("_value")).alias("_values"))
    stepped = lists.select(*parts, _of_lists(step, schema)("_values").alias("_value"))
    merged = stepped.groupBy(*parts).agg(F.collect_list(F.struct("_value")).alias("_values"))
    return merged.select(*[F.col(p).alias(c) for c, p in zip(per, parts, strict=True)], _of_lists(merge or step, schema)("_values").alias(name))


def _of_lists(function: Callable[[pd.Series], float], schema: str) -> Callable[..., Column]:
    """``function`` of the values in each list of one-field structs."""

    def run(lists: pa.Array) -> pa.Array:
        values = lists.flatten().field(0)
        whole = None if values.null_count else values.to_pandas().array
        ends = np.cumsum(lists.value_lengths().to_numpy())
        found = []
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            # A null would turn the integers of its whole batch into doubles.
            found.append(function(values[a:b].to_pandas() if whole is None else pd.Series(whole[a:b])))
        return pa.array(found, from_pandas=True)

    return F.arrow_udf(run, schema)
