"""Transactions from streams: a micro-batch is a transaction."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.records import FACT
from ..plans.program import Program
from ..storage import fresh_path


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str | None = None, once: bool = True) -> StreamingQuery:
    """Call ``each`` with every micro-batch. With ``once`` all that is there is processed, then it stops."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint or fresh_path(stream.sparkSession, "stream")).foreachBatch(each)
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if once:
        query.awaitTermination()
    return query


def feed(stream: DataFrame, program: Program, to_changes: Callable[[DataFrame], DataFrame], **options) -> StreamingQuery:
    """Run a program on a stream, one transaction a batch.

    With a ``checkpoint`` the stored facts are written there after each batch. A new
    process goes on from the last of them, and a batch that comes again is skipped.
    """
    checkpoint = options.get("checkpoint")
    state = f"{checkpoint}/facts" if checkpoint else None
    done = -1
    if state and _exists(stream.sparkSession, state):
        kept = stream.sparkSession.read.schema(f"{FACT}, batch long").parquet(state)
        done = kept.agg(F.max("batch")).first()[0]
        program.restore(kept.filter((F.col("batch") == done) & F.col("e").isNotNull()))

    def each(batch: DataFrame, number: int) -> None:
        nonlocal done
        if number <= done:
            return
        program.input(to_changes(batch))
        if state:
            # A row without entity marks the batch, as there may be no facts.
            mark = stream.sparkSession.createDataFrame([(None, None, None)], FACT)
            rows = program.stored.select("e", "a", "v").unionByName(mark).withColumn("batch", F.lit(number).cast("long"))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(state)
        done = number

    return run_batches(stream, each, **options)


def _exists(spark: SparkSession, path: str) -> bool:
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(named.getFileSystem(spark._jsc.hadoopConfiguration()).exists(named))


def latest_of(spark: SparkSession, stream: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key over the whole stream, kept as a table that each batch replaces."""
    state: dict[str, str] = {}

    def each(batch: DataFrame, number: int) -> None:
        rows = batch if "path" not in state else batch.unionByName(spark.read.schema(batch.schema).parquet(state["path"]))
        best = rows.groupBy(*keys).agg(F.max(F.struct(*order, F.struct(*[c for c in batch.columns if c not in order]).alias("_rest"))).alias("_best"))
        rest = [F.col(f"_best.{c}").alias(c) if c in order else F.col(f"_best._rest.{c}").alias(c) for c in batch.columns]
        path = fresh_path(spark, "latest")
        best.select(*rest).write.parquet(path)
        state["path"] = path

    run_batches(stream, each)
    return spark.read.schema(stream.schema).parquet(state["path"])


def counts_of(spark: SparkSession, stream: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows of each key over the whole stream, by a running streaming aggregation."""
    state: dict[str, str] = {}

    def each(batch: DataFrame, number: int) -> None:
        path = fresh_path(spark, "counts")
        batch.write.parquet(path)
        state["path"] = path

    counted = stream.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    query = counted.writeStream.outputMode("complete").option("checkpointLocation", fresh_path(spark, "stream")).foreachBatch(each).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counted.schema).parquet(state["path"])


def in_windows(stream: DataFrame, time: str, size: str, late: str, keys: Sequence[str]) -> DataFrame:
    """Rows of each key in tumbling windows; rows later than ``late`` are dropped by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("n"))


__all__ = ["Window", "counts_of", "feed", "in_windows", "latest_of", "run_batches"]
