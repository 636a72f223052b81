"""Recursion to a fixpoint, evaluated on the newest rows only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

#: Rounds after which the parts found so far are written as one table.
COMPACT = 8


def fixpoint(seed: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], most_rounds: int = 1000) -> DataFrame:
    """All rows that ``seed`` and repeated steps derive, as a set.

    ``step(new, known)`` returns what the rows found last derive (together with all
    known ones, for rules that use the relation twice). A round that finds nothing
    new ends it; too many rounds are an error. Each round is written to the shared
    folder, which cuts its lineage.
    """
    new = materialize(seed.distinct(), "round")
    known = new
    for k in range(most_rounds):
        found = step(new, known).select(*known.columns).distinct()
        new = materialize(found.join(known, known.columns, "left_anti"), "round")
        if new.isEmpty():
            return known
        known = known.unionByName(new)
        if k % COMPACT == COMPACT - 1:  # many small parts become one table again
            known = materialize(known, "known")
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds")


def closure(edges: DataFrame, source: str = "source", target: str = "target", most_rounds: int = 1000) -> DataFrame:
    """(source, target): every pair joined by a path. A round doubles the length of the paths found."""
    pairs = edges.select(F.col(source).alias("source"), F.col(target).alias("target"))

    def step(new: DataFrame, known: DataFrame) -> DataFrame:
        ahead = new.select("source", F.col("target").alias("m")).join(known.select(F.col("source").alias("m"), "target"), "m")
        behind = known.select("source", F.col("target").alias("m")).join(new.select(F.col("source").alias("m"), "target"), "m")
        return ahead.select("source", "target").union(behind.select("source", "target"))

    return fixpoint(pairs, step, most_rounds)
