"""Ordered sets as relations (set_id, ord, item): unique items in order of first appearance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unique(rows: DataFrame) -> DataFrame:
    """Each item once, where it first appears."""
    return rows.groupBy("set_id", "item").agg(F.min("ord").alias("ord")).select("set_id", "ord", "item")


def indexed(rows: DataFrame) -> DataFrame:
    """With idx, the place of an item (from 0)."""
    return unique(rows).withColumn("idx", F.row_number().over(Window.partitionBy("set_id").orderBy("ord")) - 1)


def item_at(rows: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """Items with places from first up to last (one place without last); negative places count from the end."""
    n = F.count("*").over(Window.partitionBy("set_id"))
    own = indexed(rows).withColumn("n", n)
    at = lambda k: F.lit(k) if k >= 0 else F.col("n") + k
    test = F.col("idx") == at(first) if last is None else (F.col("idx") >= at(first)) & (F.col("idx") < at(last))
    return own.where(test).select("set_id", "ord", "item")


def add(rows: DataFrame, more: DataFrame) -> DataFrame:
    """Items of more (set_id, ord, item) appended in their order, unless they are there."""
    top = rows.groupBy("set_id").agg(F.max("ord").alias("_top"))
    shifted = more.join(top, "set_id", "left").select("set_id", (F.coalesce(F.col("_top"), F.lit(0)) + 1 + F.col("ord")).alias("ord"), "item")
    return unique(rows.select("set_id", "ord", "item").unionByName(shifted))


union = add


def keep(rows: DataFrame, *others: DataFrame) -> DataFrame:
    """Intersection: items that all others have, in the first one's order."""
    out = unique(rows)
    for o in others:
        out = out.join(o.select("set_id", "item"), ["set_id", "item"], "left_semi")
    return out.select("set_id", "ord", "item")


def except_any(rows: DataFrame, *others: DataFrame) -> DataFrame:
    """Items that none of the others has."""
    out = unique(rows)
    for o in others:
        out = out.join(o.select("set_id", "item"), ["set_id", "item"], "left_anti")
    return out.select("set_id", "ord", "item")


def except_all(rows: DataFrame, *others: DataFrame) -> DataFrame:
    """Items that not every one of the others has."""
    if not others:
        return unique(rows)
    return except_any(rows, keep(*others))


def symmetric_difference(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Items in exactly one of the two, the first one's first."""
    return add(except_any(rows, other), except_any(other, rows))


def discard(rows: DataFrame, items: DataFrame) -> DataFrame:
    return except_any(rows, items)


def size(rows: DataFrame) -> DataFrame:
    """set_id, n: the number of items."""
    return rows.groupBy("set_id").agg(F.count_distinct("item").alias("n"))


def contains(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """set_id, item, inside: whether each asked item (set_id, item) is in its set."""
    there = rows.select("set_id", "item").distinct().withColumn("_in", F.lit(True))
    return asked.select("set_id", "item").join(there, ["set_id", "item"], "left").select("set_id", "item", F.coalesce("_in", F.lit(False)).alias("inside"))


def backwards(rows: DataFrame) -> DataFrame:
    """With idx counted from the last item."""
    return unique(rows).withColumn("idx", F.row_number().over(Window.partitionBy("set_id").orderBy(F.desc("ord"))) - 1)


def clear(rows: DataFrame) -> DataFrame:
    return unique(rows).limit(0)


def popped(rows: DataFrame) -> DataFrame:
    """What pop() leaves: all items but the last."""
    return backwards(rows).where("idx > 0").select("set_id", "ord", "item")


def is_superset(rows: DataFrame, other: DataFrame) -> DataFrame:
    """set_id, superset: whether all items of other are in rows."""
    return is_subset(other, rows).withColumnRenamed("subset", "superset")


def last(rows: DataFrame) -> DataFrame:
    """set_id and the item that pop() would take."""
    return rows.groupBy("set_id").agg(F.max_by("item", "ord").alias("item"))


def is_subset(rows: DataFrame, other: DataFrame) -> DataFrame:
    """set_id, subset: whether all items are in other."""
    there = other.select("set_id", "item").distinct().withColumn("_in", F.lit(True))
    return unique(rows).join(there, ["set_id", "item"], "left").groupBy("set_id").agg(F.bool_and(F.coalesce("_in", F.lit(False))).alias("subset"))


def equals(rows: DataFrame, other: DataFrame, ordered: bool = True) -> DataFrame:
    """set_id, equal: whether both have the same items, and the same order if ordered."""
    by = (lambda df: F.sort_array(F.collect_list(F.struct("idx", "item")))) if ordered else (lambda df: F.sort_array(F.collect_set("item")))
    lists = lambda df, name: indexed(df).groupBy("set_id").agg(by(df).alias(name))
    return lists(rows, "a").join(lists(other, "b"), "set_id", "full").select("set_id", F.col("a").eqNullSafe(F.col("b")).alias("equal"))
