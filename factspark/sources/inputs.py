"""Where facts come from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import CHANGE, make_records, remove_record, text
from ..operators.relational import lookup


def table_facts(df: DataFrame, tag: str, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A table's rows as records with a tag and an id made of their key."""
    return make_records(df, [tag], list(key), [c for c in columns if c not in key])


def read_texts(spark: SparkSession, paths: DataFrame, encoding: str = "UTF-8") -> DataFrame:
    """(path, contents, error) of every path in the column ``path``: the whole file, or why there is none.

    Files are read by the executors through Spark's file source, from any file system
    it knows; a path without a file is a row with an error, not a failure. The list of
    paths is the user's and passes through the driver, contents do not.
    """
    wanted = [r.path for r in paths.select("path").distinct().collect() if r.path]
    conf = spark._jsc.hadoopConfiguration()
    rows = []
    for path in wanted:
        named = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = named.getFileSystem(conf)
        rows.append((path, fs.makeQualified(named).toString(), bool(fs.exists(named)) and bool(fs.getFileStatus(named).isFile())))
    found = spark.createDataFrame(rows, "path string, key string, there boolean")
    names = [key for _, key, there in rows if there]
    if not names:
        return found.select("path", F.lit(None).cast("string").alias("contents"), F.lit("ENOENT").alias("error"))
    read = spark.read.format("binaryFile").load(names).select(F.col("path").alias("key"), F.decode("content", encoding).alias("contents"))
    # A file that is there but was not read (it went meanwhile) is an error too.
    error = F.when(~F.col("there"), "ENOENT").when(F.col("contents").isNull(), "EIO")
    return found.join(read, "key", "left").select("path", "contents", error.alias("error"))


def calendar(timestamp: Column) -> dict[str, Column]:
    """Calendar attributes of a time: weekdays count from Sunday, 1; timestamp is in milliseconds."""
    return {
        "year": F.year(timestamp), "month": F.month(timestamp), "day": F.dayofmonth(timestamp), "weekday": F.dayofweek(timestamp), "hour": F.hour(timestamp), "minute": F.minute(timestamp),
        "second": F.second(timestamp), "millisecond": (F.unix_millis(timestamp) % 1000).cast("int"), "timestamp": F.unix_millis(timestamp),
    }


def timer(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """A stream of ticks with their calendar attributes."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return ticks.select(F.col("value").alias("tick"), *[c.alias(n) for n, c in calendar(F.col("timestamp")).items()])


def tick_changes(ticks: DataFrame, entity: str = "timer", resolution_ms: int = 1000) -> DataFrame:
    """The changes of a transaction that sets the timer record to the last of these ticks.

    Ticks are rows of ``timer``. The tick before goes with all its attributes (a drop of
    the record), the new one counts whole ``resolution_ms`` steps; no ticks, no change.
    """
    names = ["year", "month", "day", "weekday", "hour", "minute", "second", "millisecond", "timestamp", "tick"]
    last = ticks.agg(F.max(F.struct("timestamp", *[n for n in names if n != "timestamp"])).alias("t")).filter("t is not null").select("t.*")
    whole = (F.floor(F.col("timestamp") / resolution_ms) * resolution_ms).cast("long")
    stepped = last.withColumn("timestamp", whole).withColumn("millisecond", (F.col("millisecond") - F.col("millisecond") % min(resolution_ms, 1000)).cast("int"))
    facts = lookup(stepped, F.lit(entity), names).unionByName(stepped.select(F.lit(entity).alias("e"), F.lit("tag").alias("a"), text("timer").alias("v")))
    return remove_record(stepped, F.lit(entity)).unionByName(facts.select(F.lit("add").alias("op"), "e", "a", "v"))


def random_ids(df: DataFrame, name: str = "id") -> DataFrame:
    """Each row with a random id of its own."""
    return df.withColumn(name, F.uuid())


def sequence_changes(spark: SparkSession, program: str) -> list[DataFrame]:
    """Transactions from a small notation for tests: ``+A`` and ``-A`` add and remove a record tagged input.

    ``+A:1:x`` also gives it arg0 and arg1; transactions are separated by semicolons,
    changes by spaces or commas.
    """
    out = []
    for transaction in program.split(";"):
        rows = []
        for word in transaction.replace(",", " ").split():
            op, (e, *args) = {"+": "add", "-": "remove"}[word[0]], word[1:].split(":")
            rows.append((op, e, "tag", (None, "input")))
            for k, a in enumerate(args):
                try:
                    rows.append((op, e, f"arg{k}", (float(a), None)))
                except ValueError:
                    rows.append((op, e, f"arg{k}", (None, a)))
        out.append(spark.createDataFrame(rows, CHANGE))
    return out
