"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialize
from ._text import space_words

#: Documents in one stretch of a source's order, on average.
STRETCH = 5_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n, weight, target): a row for each source of ``sizes`` (source, size).

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``share`` times all words by weight. A target stops at ``most`` times the size of
    its source; the excess is shared again by weight until no target is above. That
    fixed point is found at once: sources are ordered by how soon they fill up, and
    the level is the first that the next source can take.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    # One row a source from here on, so windows over all of them are small.
    ranked = per.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * most).withColumn("fills", F.col("cap") / F.col("weight"))
    everything, before = Window.partitionBy(), Window.orderBy("fills", "place").rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.select(
        "*",
        (F.sum("source_size").over(everything) * share).alias("all"),
        F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
    )
    # The level if this source and all after it stay unfilled; it holds if this source has room for it.
    level = (F.col("all") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before"))
    held = filled.withColumn("level", F.when(level < F.col("fills"), level))
    first = F.min(F.when(F.col("level").isNotNull(), F.struct("fills", "place", "level"))).over(everything)
    held = held.withColumn("first", first)
    open_ = F.col("first").isNotNull() & (F.struct("fills", "place") >= F.struct("first.fills", "first.place"))
    target = F.when(open_, F.col("first.level") * F.col("weight")).otherwise(F.col("cap"))
    return held.select("source", "source_size", "n", "weight", target.alias("target"))


def uniform(seed: int, *of: Column) -> Column:
    """A number in (0, 1) that depends on the seed and the given columns only."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in of]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """How many words of each document a mix of all sources takes.

    A source whose target is at least its size is first taken whole, as often as
    that fits. What is left of the target is filled by weighted sampling without
    replacement (Efraimidis and Spirakis): documents stand in the order of
    -ln(u) / w, with u drawn from the doc_id and w the document's quality weight,
    and are taken until the budget is met; the last one gives only the words that
    are missing. The order is cut into stretches whose sizes are summed first, so
    a large source is never one task.

    ``quality`` has doc_id and weight (positive; 1 where absent). Returns doc_id,
    source, size, source_size, target, epochs, taken, a row for each input row.
    Null texts have size 0 and take 0. Null sources are one source. Rows that repeat
    a doc_id are documents of their own. Other columns are ignored.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(space_words(F.col("text"))).cast("long").alias("size"))
    sized = materialize(sized, "sizes")
    targets = source_targets(sized, weights, share, most)
    base = sized
    if quality is not None:
        # "w" only carries the weight; the documents' own columns are already fixed.
        best = quality.filter("doc_id is not null and weight > 0").groupBy("doc_id").agg(F.max(F.col("weight").cast("double")).alias("w"))
        base = base.join(best, "doc_id", "left")
    else:
        base = base.withColumn("w", F.lit(1.0))
    draw = uniform(seed, F.col("doc_id"), F.col("size"))
    base = base.withColumn("w", F.coalesce("w", F.lit(1.0))).withColumn("key", -F.log(draw) / F.col("w"))
    joined = base.join(targets.withColumnRenamed("source", "s"), base.source.eqNullSafe(F.col("s"))).drop("s")
    # exp(-key) is evenly spread for weight 1, and monotone in the key for any weight.
    cuts = F.greatest(F.lit(1), F.ceil(F.col("n") / STRETCH))
    placed = joined.withColumn("stretch", F.floor((1 - F.exp(-F.col("key"))) * cuts))
    placed = placed.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    placed = placed.withColumn("budget", F.floor(F.col("target")) - F.col("epochs") * F.col("source_size"))
    sums = placed.groupBy("source", "stretch").agg(F.sum("size").alias("size"))
    ahead = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s"), F.col("stretch").alias("t"), F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "stretch").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    summed = ordered.join(offsets, ordered.source.eqNullSafe(F.col("s")) & (F.col("stretch") == F.col("t")))
    part = F.greatest(F.lit(0), F.least("size", F.col("budget") - F.col("offset") - F.col("inner")))
    return summed.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """Documents labelled as good are twice as likely to be drawn early."""
    return labels.select(F.col("doc_id"), F.when(F.col("quality") == 1, 2.0).otherwise(1.0).alias("weight"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
