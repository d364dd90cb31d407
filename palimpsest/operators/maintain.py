"""Maintenance: purging tombstones, orphaned identifiers, compaction, versioned backups."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.scalar import utf16_length
from palimpsest.operators.state import merge

DAY_MS = 86_400_000


def purge_plan(state: DataFrame, cutoff: int | None, server: bool = False) -> DataFrame:
    """The tombstones to remove. A client removes those without time, and all without a cutoff; a
    server only those with a time before it."""
    gone = state.filter("deleted")
    if server:
        return gone.filter(F.col("deleted_at") < cutoff)
    return gone if cutoff is None else gone.filter(F.col("deleted_at").isNull() | (F.col("deleted_at") < cutoff))


def purge_stats(state: DataFrame, plan: DataFrame) -> DataFrame:
    """items (all that were looked at) and purged (tombstones removed), as one row."""
    items = state.agg(F.countDistinct("identity").alias("items"), F.lit(None).cast("long").alias("purged"))
    both = items.unionByName(plan.agg(F.lit(None).cast("long").alias("items"), F.count("*").alias("purged")))
    return both.agg(F.max("items").alias("items"), F.max("purged").alias("purged"))


def orphans(registry: DataFrame, state: DataFrame, purged: DataFrame) -> DataFrame:
    """Registered (identity, key) that no entry has after the purge; tombstones not yet purged count."""
    left = state.join(purged.select("identity", "section", "key"), ["identity", "section", "key"], "left_anti")
    return registry.join(left.select("identity", "key").distinct(), ["identity", "key"], "left_anti")


def compact(ops: DataFrame, cutoff: int | None = None) -> DataFrame:
    """An op-log with the winners alone, without tombstones that a server purges."""
    state = merge(ops)
    if cutoff is not None:
        state = state.filter(~F.coalesce(F.col("deleted") & (F.col("deleted_at") < cutoff), F.lit(False)))
    return state.select("identity", "section", "key", "author", "clock", "value", "deleted", F.col("deleted_at").alias("at"))


def write_version(spark: SparkSession, df: DataFrame, path: str, kept: int = 10) -> str:
    """Writes a new version beside the others and removes all but the newest ``kept``."""
    jvm = spark.sparkContext._jvm
    name = f"{path}/v{time.time_ns():020d}"
    df.write.parquet(name)
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted((s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().startswith("v")), reverse=True)
    for old in names[kept:]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{old}"), True)
    return name


ENTRY = ["section", "key", "value"]


def item_hashes(entries: DataFrame) -> DataFrame:
    """room, identity, hash, size of every item's entries (room, identity, section, key, value).

    The hash adds up hashes of entries, so it needs no order and an item of any size is never gathered; the
    size is that of the entries as JSON in UTF-16 units, as limits count.
    """
    text = F.to_json(F.struct(*ENTRY))
    part = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return entries.groupBy("room", "identity").agg(F.sum(part).cast("string").alias("hash"), F.sum(utf16_length(text)).alias("size"))


def gated_snapshot(entries: DataFrame, last: DataFrame, max_size: int) -> tuple[DataFrame, DataFrame]:
    """What a snapshot before an apply writes, and what is remembered of it.

    entries: room, identity, section, key, value. last: room, identity, hash of the items as they were
    last written. An item whose hash is the last one is not written again; a room whose changed items have
    more than ``max_size`` units together is skipped, and remembers nothing, so it is tried again.
    The first result has the columns of ``entries``, the second room, identity, hash, action (write, skip_size, skip_same).
    """
    now = item_hashes(entries)
    same = now.join(last.select("room", "identity", "hash"), ["room", "identity", "hash"], "left_semi").withColumn("action", F.lit("skip_same"))
    changed = now.join(last.select("room", "identity", "hash"), ["room", "identity", "hash"], "left_anti")
    fits = changed.groupBy("room").agg(F.sum("size").alias("total"))
    changed = changed.join(fits, "room").withColumn("action", F.when(F.col("total") > max_size, "skip_size").otherwise("write")).drop("total")
    told = changed.unionByName(same).select("room", "identity", "hash", "action")
    rows = entries.join(told.filter("action = 'write'").select("room", "identity"), ["room", "identity"], "left_semi")
    return rows, told


def remembered(told: DataFrame, last: DataFrame) -> DataFrame:
    """room, identity, hash after a snapshot: what was written replaces what was remembered."""
    new = told.filter("action = 'write'").select("room", "identity", "hash")
    return last.select("room", "identity", "hash").join(new.select("room", "identity"), ["room", "identity"], "left_anti").unionByName(new)


def rollback(version: DataFrame, state: DataFrame, author: str, clock: int) -> DataFrame:
    """Compensating ops that bring the entries of a version back where the state differs."""
    keys = ["identity", "section", "key"]
    now = state.select(*keys, F.col("value").alias("now"), F.col("deleted").alias("gone"))
    d = version.join(now, keys, "left").filter(F.col("gone").isNull() | ~F.col("value").eqNullSafe(F.col("now")) | (F.col("gone") != F.col("deleted")))
    return d.select(*keys, F.lit(author).alias("author"), F.lit(clock).cast("long").alias("clock"), "value", "deleted", F.lit(None).cast("long").alias("at"))
