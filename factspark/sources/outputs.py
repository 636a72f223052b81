"""Where results go."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import value_text
from ..storage import materialize

def write_texts(df: DataFrame, folder: str) -> DataFrame:
    """Write rows (name, contents), a text file in a folder of its own for each name; returns (name, complete, error).

    Folders of other names stay as they are. A row without name or contents, and a name
    with several different contents, is not written and says so in ``error``.
    """
    rows = df.select("name", "contents").distinct()
    each = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("contents").alias("contents"))
    error = F.when(F.col("name").isNull(), "no name").when(F.col("n") > 1, "several contents").when(F.col("contents").isNull(), "no contents")
    judged = materialize(each.select("name", "contents", error.alias("error")), "texts")
    good = judged.filter("error is null").select("contents", "name")
    good.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name").text(folder)
    return judged.select("name", F.col("error").isNull().alias("complete"), "error")


def console(tag: str, stream=None) -> Callable[[DataFrame, DataFrame], None]:
    """A watch handler that prints the text attribute of all new facts, one partition at a time."""

    def handler(came: DataFrame, went: DataFrame) -> None:
        for row in came.filter("a = 'text'").select(value_text("v").alias("t")).toLocalIterator():
            print(f"{tag}: {row.t}", file=stream or sys.stdout)

    return handler


def collector(into: list) -> Callable[[DataFrame, DataFrame], None]:
    """A watch handler that keeps the differences as Python rows, for tests and small results."""

    def handler(came: DataFrame, went: DataFrame) -> None:
        into.append((sorted(map(tuple, came.collect()), key=str), sorted(map(tuple, went.collect()), key=str)))

    return handler


def table_writer(path: str) -> Callable[[DataFrame, DataFrame], None]:
    """A watch handler that appends differences with a sign to a Parquet table."""

    def handler(came: DataFrame, went: DataFrame) -> None:
        came.withColumn("count", F.lit(1)).unionByName(went.withColumn("count", F.lit(-1))).write.mode("append").parquet(path)

    return handler
