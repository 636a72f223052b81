"""Connected components of a link table, as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from ._joins import BROADCAST_ROWS

#: Rounds after which something must be wrong: paths shorten by half or more each round.
MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node can reach.

    ``links`` has two columns of one type, a and b, in any direction; nulls and
    self-links are ignored. Large-star and small-star rounds alternate until every
    node hangs on its root; each is one aggregation and one join, written to
    the shared folder. Nothing but two totals a round comes to the driver.
    """
    ends = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    ends = materialize(ends, "links")
    seen = (ends.count(), None)
    for _ in range(MOST_ROUNDS):
        few = seen[0] <= BROADCAST_ROWS
        larger = _large_star(ends, few)
        ends = materialize(_small_star(larger if few else materialize(larger, "stars"), few), "stars")
        # Stable when a round changes nothing; the sum of the hashes tells.
        now = ends.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == tuple(now):
            break
        seen = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = ends.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return ends.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots).distinct()


def _with_least(rows: DataFrame, least: DataFrame, few: bool) -> DataFrame:
    """Every link with its node's minimum, without dealing a hub's links to one task.

    Of few links (counted) the minima are broadcast; of more they are written first, so
    that the join reads plain inputs, which AQE splits where a node is hot.
    """
    return rows.join(F.broadcast(least) if few else materialize(least, "least"), "a")


def _large_star(ends: DataFrame, few: bool) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = ends.union(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return _with_least(both.filter("b > a"), least, few).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(ends: DataFrame, few: bool) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to its smallest neighbour."""
    least = ends.groupBy("a").agg(F.min("b").alias("m"))
    moved = _with_least(ends, least, few).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
