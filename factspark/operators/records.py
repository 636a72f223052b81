"""Making records and changing them: facts in, changes out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import NUMBERS, VALUE, record_id, value_of, value_text
from .relational import lookup

FACT = f"e string, a string, v {VALUE}"
#: A change adds or removes one fact, all values of an attribute, or a whole record.
CHANGE = f"op string, e string, a string, v {VALUE}"


def text(s) -> Column:
    """A text as a value."""
    return F.struct(F.lit(None).cast("double").alias("n"), (s if isinstance(s, Column) else F.lit(s)).cast("string").alias("s"))


def number(x) -> Column:
    """A number as a value."""
    return F.struct((x if isinstance(x, Column) else F.lit(x)).cast("double").alias("n"), F.lit(None).cast("string").alias("s"))


def make_records(df: DataFrame, tags: Sequence[str], identity: Sequence[str], others: Sequence[str] = (), entity: Column | None = None) -> DataFrame:
    """Facts of a record for each row: its tags, identity attributes and others.

    The id is made from tags and identity attributes, unless ``entity`` is given. An
    array column gives a fact for each element. Facts are distinct.
    """
    e = record_id(df, list(tags), list(identity)) if entity is None else entity
    named = df.withColumn("_e", e)
    singles = [c for c in [*identity, *others] if not isinstance(df.schema[c].dataType, T.ArrayType)]
    parts = [named.select(F.col("_e").alias("e"), F.lit("tag").alias("a"), text(t).alias("v")) for t in tags]
    if singles:
        parts.append(lookup(named, F.col("_e"), singles))
    for c in [*identity, *others]:
        if c not in singles:
            each = named.select("_e", F.explode(c).alias(c))
            parts.append(lookup(each, F.col("_e"), [c]))
    return reduce(lambda x, y: x.unionByName(y), parts).distinct()


def flatten(df: DataFrame, entity: str) -> DataFrame:
    """Facts of nested rows: structs and arrays of structs become records of their own.

    The id of a nested record is its parent's with the attribute and, in an array, the
    place; the parent's attribute holds that id, and a record in an array has its place
    as the attribute index.
    """
    parts: list[DataFrame] = []

    def walk(rows: DataFrame) -> None:
        for field in rows.schema.fields:
            name, kind = field.name, field.dataType
            if name == "_id":
                continue
            if isinstance(kind, T.StructType):
                child = rows.filter(F.col(name).isNotNull()).select(F.concat_ws("|", "_id", F.lit(name)).alias("_id"), F.col("_id").alias("_parent"), f"{name}.*")
                parts.append(child.select(F.col("_parent").alias("e"), F.lit(name).alias("a"), text(F.col("_id")).alias("v")))
                walk(child.drop("_parent"))
            elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
                each = rows.select("_id", F.posexplode(name).alias("_at", "_item"))
                child = each.select(F.concat_ws("|", "_id", F.lit(name), F.col("_at").cast("string")).alias("_id"), F.col("_id").alias("_parent"), (F.col("_at") + 1).alias("index"), "_item.*")
                parts.append(child.select(F.col("_parent").alias("e"), F.lit(name).alias("a"), text(F.col("_id")).alias("v")))
                walk(child.drop("_parent"))
            elif isinstance(kind, T.ArrayType):
                parts.append(lookup(rows.select("_id", F.explode(name).alias(name)), F.col("_id"), [name]))
            else:
                parts.append(lookup(rows, F.col("_id"), [name]))

    walk(df.withColumn("_id", F.col(entity).cast("string")).drop(*([entity] if entity != "_id" else [])))
    return reduce(lambda x, y: x.unionByName(y), parts).distinct()


def objects(facts: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """A row for each entity with its attributes as text columns; an attribute with several values is an error."""
    named = facts.filter(F.col("a").isin(list(attributes))).select("e", "a", value_text("v").alias("t"))
    many = F.assert_true(F.count("t") <= 1, F.lit("an attribute has several values"))
    checked = named.distinct().groupBy("e", "a").agg(F.first("t").alias("t"), many.alias("_ok")).filter(F.col("_ok").isNull())
    return checked.groupBy("e").pivot("a", list(attributes)).agg(F.first("t"))


def _change(op: str, df: DataFrame, e: Column, a: Column | None = None, v: Column | None = None) -> DataFrame:
    return df.select(F.lit(op).alias("op"), e.cast("string").alias("e"), (F.lit(None) if a is None else a).cast("string").alias("a"), (F.lit(None) if v is None else v).cast(VALUE).alias("v"))


def add_value(df: DataFrame, e: Column, a: Column, v: Column) -> DataFrame:
    return _change("add", df, e, a, v)


def remove_value(df: DataFrame, e: Column, a: Column, v: Column) -> DataFrame:
    return _change("remove", df, e, a, v)


def remove_attribute(df: DataFrame, e: Column, a: Column) -> DataFrame:
    return _change("erase", df, e, a)


def remove_record(df: DataFrame, e: Column) -> DataFrame:
    return _change("drop", df, e)


def set_value(df: DataFrame, e: Column, a: Column, v: Column) -> DataFrame:
    """Replace all values of an attribute by one."""
    return remove_attribute(df, e, a).unionByName(add_value(df, e, a, v))


def merge_values(df: DataFrame, e: Column, attributes: Sequence[str]) -> DataFrame:
    """Replace the listed attributes by the row's columns; a tag is added, not replaced."""
    parts = []
    for name in attributes:
        v = value_of(df, name) if dict(df.dtypes)[name] != VALUE else F.col(name)
        parts.append(add_value(df, e, F.lit(name), v) if name == "tag" else set_value(df, e, F.lit(name), v))
    return reduce(lambda x, y: x.unionByName(y), parts)


def apply_changes(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """The facts after the changes, which all look at the facts before.

    Attribute and record removals take away what was there; of equal adds and removes
    of one fact neither counts, but an add stays if only an attribute or a record was
    removed. Adding what is there, or removing what is not, changes nothing.
    """
    adds = changes.filter("op = 'add'").select("e", "a", "v").distinct()
    removes = changes.filter("op = 'remove'").select("e", "a", "v").distinct()
    erased, dropped = changes.filter("op = 'erase'").select("e", "a").distinct(), changes.filter("op = 'drop'").select("e").distinct()
    net_adds, net_removes = adds.join(removes, ["e", "a", "v"], "left_anti"), removes.join(adds, ["e", "a", "v"], "left_anti")
    kept = facts.join(net_removes, ["e", "a", "v"], "left_anti").join(erased, ["e", "a"], "left_anti").join(dropped, "e", "left_anti")
    return kept.select("e", "a", "v").unionByName(net_adds).distinct()


__all__ = ["CHANGE", "FACT", "NUMBERS", "add_value", "apply_changes", "flatten", "make_records", "merge_values", "number", "objects", "remove_attribute", "remove_record", "remove_value", "set_value", "text"]
