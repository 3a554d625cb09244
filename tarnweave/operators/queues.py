"""Queues as tables: a row per waiting item with its queue and ``seq``, the place in line.

A queue's first item is the one of smallest ``seq``. Leveled queues are queues with a level; their items
come out level by level, and of each level only the head is looked at. Lists of hosts or clients are queues as well.
All operators are aggregates or joins on the key; none gathers a queue in one task but for windows per queue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def push(queues: DataFrame, items: DataFrame, key: str = "item") -> tuple[DataFrame, DataFrame]:
    """(queues with the items (key, queue, seq) at their ends, items that were refused).

    An item stands in one queue only: later pushes, and pushes of items that wait already, are refused.
    """
    first = items.groupBy(key).agg(F.min("seq").alias("seq")).join(queues.select(key), key, "left_anti")
    taken = items.join(first, [key, "seq"], "left_semi").dropDuplicates([key])
    last = queues.groupBy("queue").agg(F.max("seq").alias("_last"))
    placed = taken.join(last, "queue", "left").withColumn("seq", F.col("seq") + F.greatest(F.coalesce("_last", F.lit(0)), F.lit(0)) + 1).drop("_last")
    return queues.unionByName(placed.select(*queues.columns)), items.join(taken.select(key, F.col("seq").alias("_s")), (items[key] == taken[key]) & (items["seq"] == F.col("_s")), "left_anti")


def pop(queues: DataFrame, n: int = 1, key: str = "item") -> tuple[DataFrame, DataFrame]:
    """(the first ``n`` items of every queue, what is left)."""
    place = F.row_number().over(Window.partitionBy("queue").orderBy("seq"))
    heads = queues.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")
    return heads, remove(queues, heads, key)


def pop_due(queues: DataFrame, due: Column, levels: str = "level", key: str = "item") -> tuple[DataFrame, DataFrame]:
    """(the next item of every leveled queue, what is left): the head of the lowest level whose head is due."""
    heads = queues.groupBy("queue", levels).agg(F.min("seq").alias("seq")).join(queues, ["queue", levels, "seq"]).where(due)
    lowest = heads.groupBy("queue").agg(F.min(levels).alias(levels))
    taken = heads.join(lowest, ["queue", levels]).select(*queues.columns)
    return taken, remove(queues, taken, key)


def remove(queues: DataFrame, items: DataFrame, key: str = "item") -> DataFrame:
    """The queues without some items, wherever they stand in line."""
    return queues.join(items.select(key), key, "left_anti").select(*queues.columns)


def clear(queues: DataFrame, *names: str) -> DataFrame:
    return queues.where(~F.col("queue").isin(*names))


def merge(queues: DataFrame, into: str, other: str) -> DataFrame:
    """All items of ``other`` behind those of ``into``."""
    last = queues.where(F.col("queue") == into).agg(F.max("seq").alias("_last"))
    first = queues.where(F.col("queue") == other).agg(F.min("seq").alias("_first"))
    moved = F.col("queue") == other
    shift = F.coalesce(F.col("_last"), F.lit(0)) - F.coalesce(F.col("_first"), F.lit(0)) + 1
    out = queues.join(F.broadcast(last.join(F.broadcast(first), F.lit(True), "inner")), F.lit(True), "inner")
    return out.select(*(F.when(moved, F.col("seq") + shift).otherwise(F.col("seq")).alias("seq") if c == "seq" else F.when(moved, F.lit(into)).otherwise(F.col("queue")).alias("queue") if c == "queue" else F.col(c) for c in queues.columns))


def ends(queues: DataFrame, key: str = "item") -> DataFrame:
    """Per queue: its first and last item and its length. Queues without a row are empty."""
    return queues.groupBy("queue").agg(F.min_by(key, "seq").alias("first"), F.max_by(key, "seq").alias("last"), F.count("*").alias("length"))
