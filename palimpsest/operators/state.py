"""Converged state of an op-log: one register for each key, tombstones, and views of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["identity", "section", "key"]
PAYLOAD = ["clock", "author", "value", "deleted", "at"]


def merge(ops: DataFrame) -> DataFrame:
    """The winner of every key: the write with the largest (clock, author, value).

    The order is total, so merging is commutative, associative and idempotent, and partial results
    combine before the shuffle.
    """
    best = F.max(F.struct("clock", "author", "value", "deleted", "at")).alias("w")
    return ops.groupBy(*KEY).agg(best).select(*KEY, "w.clock", "w.author", "w.value", "w.deleted", F.when(F.col("w.deleted"), F.col("w.at")).alias("deleted_at"))


def live(state: DataFrame) -> DataFrame:
    return state.filter(~F.coalesce("deleted", F.lit(False)))


def members(state: DataFrame, member: Column) -> DataFrame:
    """The live entries, of lists only those of which the item is a member."""
    return live(state).filter((F.col("section") != "lists") | F.coalesce(member, F.lit(False)))


def tombstones(state: DataFrame) -> DataFrame:
    return state.filter("deleted")


def foreign(state: DataFrame, me: str) -> DataFrame:
    """Entries of others; an entry without author counts as one of others."""
    return state.filter(~F.col("author").eqNullSafe(me))


def first_author(ops: DataFrame) -> DataFrame:
    return ops.groupBy(*KEY).agg(F.min(F.struct("clock", "author")).alias("f")).select(*KEY, F.col("f.author").alias("author"))


def tag_writes(ops: DataFrame) -> DataFrame:
    """The tag writes that take effect: a tag is written only if it is absent, deleted or of another
    colour, and deleted only if it is there and live. An ignored write leaves what was there, so the one
    before is enough to compare with."""
    tags = ops.filter("section = 'tags'").withColumn("key", F.lower("key"))
    w = Window.partitionBy(*KEY).orderBy("clock")
    before = tags.withColumn("was", F.lag("value").over(w)).withColumn("gone", F.coalesce(F.lag("deleted").over(w), F.lit(True)))
    return before.filter((~F.col("deleted") & (F.col("gone") | ~F.col("value").eqNullSafe(F.col("was")))) | (F.col("deleted") & ~F.col("gone"))).drop("was", "gone")


def lower_tag_keys(state: DataFrame) -> DataFrame:
    """One entry for each lower-cased tag key: a live one that is lower-case already, else the first live
    one by clock, else the first."""
    lower = F.lower("key")
    rank = F.struct(F.col("deleted").cast("int"), (F.col("key") != lower).cast("int"), "clock")
    best = state.groupBy("identity", "section", lower.alias("low")).agg(F.min_by(F.struct(*state.columns), rank).alias("e"))
    return best.select("e.identity", "e.section", F.col("low").alias("key"), F.col("e.key").alias("old_key"), "e.author", "e.value", "e.deleted")


def snapshot(state: DataFrame) -> DataFrame:
    """Each item's live entries of a section as a map from key to value."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))
    return live(state).groupBy("identity", "section").agg(entries.alias("entries"))
