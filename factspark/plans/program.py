"""Rules over facts, run transaction by transaction.

A rule is a Python function from the facts (e, a, v) to a DataFrame, so it is an
ordinary Spark job. Bound rules derive facts that live as long as their support;
commits change the stored facts, on matches that were not there in the frame before;
watches hand additions and removals to Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import CHANGE, FACT, apply_changes
from ..operators.recursion import COMPACT
from ..storage import materialize

Rule = Callable[[DataFrame], DataFrame]


@dataclass
class Watch:
    rule: Rule
    handler: Callable[[DataFrame, DataFrame], None]
    seen: DataFrame | None = None


@dataclass
class Program:
    """Stored facts, rules in strata, commits and watches."""

    spark: SparkSession
    most_rounds: int = 10_000
    most_frames: int = 10
    binds: dict[str, tuple[int, bool | None, Rule]] = field(default_factory=dict)
    commits: dict[str, Rule] = field(default_factory=dict)
    watches: dict[str, Watch] = field(default_factory=dict)
    connectors: dict[str, Callable[[Program], None]] = field(default_factory=dict)
    stored: DataFrame | None = None
    matched: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.stored = self.spark.createDataFrame([], FACT)

    def bind(self, name: str, rule: Rule, stratum: int = 0, recursive: bool | None = None) -> Program:
        """Derive facts. A rule that negates, counts or ranks what other rules derive belongs into a later stratum.

        The rules of a stratum run until none finds anything new, whatever their order.
        ``recursive=False`` says that no rule of the stratum reads what its rules make,
        and saves the round that would find that out (if all of them say so).
        """
        if name in self.binds:
            raise ValueError(f"{name} is already bound")
        self.binds[name] = (stratum, recursive, rule)
        return self

    def unbind(self, name: str) -> Program:
        del self.binds[name]
        return self

    def commit(self, name: str, rule: Rule) -> Program:
        """Change stored facts: the rule returns changes (op, e, a, v).

        A change is made when its match is new. A match is the change itself, or what
        a further text column named match says.
        """
        self.commits[name] = rule
        return self

    def watch(self, name: str, rule: Rule, handler: Callable[[DataFrame, DataFrame], None]) -> Program:
        """After each transaction call ``handler`` with the rows that came and those that went."""
        self.watches[name] = Watch(rule, handler)
        return self

    def register(self, name: str, connector: Callable[[Program], None]) -> Program:
        """Name a connector: a function that adds rules, commits and watches to a program."""
        if name in self.connectors:
            raise ValueError(f"there is a connector {name} already")
        self.connectors[name] = connector
        return self

    def unregister(self, name: str) -> Program:
        """Forget a connector; what it added stays."""
        del self.connectors[name]
        return self

    def attach(self, name: str) -> Program:
        """Add the rules of a registered connector."""
        if name not in self.connectors:
            raise KeyError(f"no connector {name}; there are {sorted(self.connectors)}")
        self.connectors[name](self)
        return self

    def facts(self) -> DataFrame:
        """Stored and derived facts, as a set."""
        known = self.stored
        for stratum in sorted({s for s, _, _ in self.binds.values()}):
            rules = [(recursive, rule) for s, recursive, rule in self.binds.values() if s == stratum]
            for k in range(self.most_rounds + 1):
                found = reduce(lambda x, y: x.unionByName(y), [r(known).select("e", "a", "v") for _, r in rules]).distinct()
                if all(recursive is False for recursive, _ in rules):
                    known = materialize(known.unionByName(found).distinct(), "facts")
                    break
                new = materialize(found.join(known, ["e", "a", "v"], "left_anti"), "new")
                if new.isEmpty():
                    break
                if k == self.most_rounds:
                    raise RuntimeError(f"no fixpoint after {self.most_rounds} rounds")
                known = known.unionByName(new)
                if k % COMPACT == COMPACT - 1:
                    known = materialize(known, "known")
        return known

    def restore(self, stored: DataFrame) -> Program:
        """Go on from stored facts of an earlier run; commits and watches count what holds now as known."""
        self.stored = materialize(stored.select("e", "a", "v"), "stored")
        now = self.facts()
        self._fire(now)
        for watch in self.watches.values():
            watch.seen = materialize(watch.rule(now).distinct(), "watch")
        return self

    def input(self, changes: DataFrame) -> Program:
        """One transaction: changes (op, e, a, v), derivation, commits frame by frame, watches."""
        self.stored = materialize(apply_changes(self.stored, changes), "stored")
        for _ in range(self.most_frames + 1):
            now = self.facts()
            fired = self._fire(now)
            if fired is None or fired.isEmpty():
                break
            after = materialize(apply_changes(self.stored, fired), "stored")
            same = after.join(self.stored, ["e", "a", "v"], "left_anti").isEmpty() and self.stored.join(after, ["e", "a", "v"], "left_anti").isEmpty()
            self.stored = after
            if same:
                break
        else:
            raise RuntimeError(f"commits did not settle in {self.most_frames} frames")
        self._tell(now)
        return self

    def insert(self, facts: DataFrame) -> Program:
        return self.input(facts.select(F.lit("add").alias("op"), "e", "a", "v"))

    def delete(self, facts: DataFrame) -> Program:
        return self.input(facts.select(F.lit("remove").alias("op"), "e", "a", "v"))

    def _fire(self, now: DataFrame) -> DataFrame | None:
        """Changes of matches that the frame before did not have."""
        fired = None
        for name, rule in self.commits.items():
            found = rule(now)
            match = F.col("match").cast("string") if "match" in found.columns else F.lit("")
            matches = materialize(found.select("op", "e", "a", "v", match.alias("match")).distinct(), "matches")
            before = self.matched.get(name)
            self.matched[name] = matches
            if before is not None:
                matches = _not_in(matches, before)
            fired = matches if fired is None else fired.unionByName(matches)
        return None if fired is None else materialize(fired, "fired")

    def _tell(self, now: DataFrame) -> None:
        for watch in self.watches.values():
            rows = materialize(watch.rule(now).distinct(), "watch")
            before = watch.seen if watch.seen is not None else rows.limit(0)
            watch.seen = rows
            came, went = difference(before, rows)
            watch.handler(came, went)


def _not_in(rows: DataFrame, other: DataFrame) -> DataFrame:
    return rows.exceptAll(other.intersect(rows))


def difference(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that came and rows that went, as sets."""
    return after.exceptAll(before.intersect(after)).distinct(), before.exceptAll(after.intersect(before)).distinct()


def changes(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Changes from Python tuples (op, e, a, value)."""
    def value(v):
        if v is None:
            return None
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return (float(v), None)
        return (None, str(v).lower() if isinstance(v, bool) else v)

    return spark.createDataFrame([(op, str(e), a, value(v)) for op, e, a, v in rows], CHANGE)


def forward(destination: Program) -> Callable[[DataFrame, DataFrame], None]:
    """A watch handler that feeds another program."""

    def handler(came: DataFrame, went: DataFrame) -> None:
        destination.input(came.select(F.lit("add").alias("op"), "e", "a", "v").unionByName(went.select(F.lit("remove").alias("op"), "e", "a", "v")))

    return handler
