"""Three-way decisions: what we have, what the other has, and what we last pushed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field_hash(text: Column, kind: str = "http://www.w3.org/2001/XMLSchema#string") -> Column:
    return F.substring(F.sha2(F.concat(F.coalesce(text, F.lit("")), F.lit("|" + kind)), 256), 1, 16)


def push_action(local: Column, remote: Column, author: Column, pushed: Column, me: str) -> Column:
    """A field that was never pushed counts as edited here."""
    unchanged = field_hash(local) == pushed
    return (
        F.when((F.coalesce(local, F.lit("")) == "") & remote.isNull(), "skip_empty")
        .when(local.eqNullSafe(remote), "skip_equal")
        .when(remote.isNotNull() & ~author.eqNullSafe(me) & F.coalesce(unchanged, F.lit(False)), "conflict_remote")
        .otherwise("push")
    )


def apply_action(local: Column, remote: Column, author: Column, pushed: Column, me: str) -> Column:
    """A local value that differs from what was last pushed, or was never pushed, wins."""
    edited = pushed.isNull() | (field_hash(local) != pushed)
    return F.when(author.eqNullSafe(me), "skip_own").when(local.isNull(), "apply").when(local.eqNullSafe(remote), "skip_equal").when(edited, "conflict_local").otherwise("apply")


def tag_push_action(has_remote: Column, deleted: Column, author: Column, me: str, add_wins: bool = False) -> Column:
    """A tombstone of another author keeps a tag from coming back, unless additions win."""
    revive = F.lit(True) if add_wins else author.eqNullSafe(me)
    return F.when(~has_remote, "push").when(~deleted, "skip_equal").when(revive, "push").otherwise("blocked")


def conflicts(plan: DataFrame) -> DataFrame:
    """The log of conflicting fields, with shortened values."""
    return plan.filter("action like 'conflict%'").select(
        F.substring("identity", 1, 8).alias("identity"),
        "key",
        F.left(F.coalesce("local_text", F.lit("")), F.lit(50)).alias("local"),
        F.left(F.coalesce("remote_text", F.lit("")), F.lit(50)).alias("remote"),
        F.col("remote_author").alias("author"),
        F.when(F.col("action") == "conflict_local", "local-wins").otherwise("remote-wins").alias("resolution"),
    )


def deletions(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Keys of the last snapshot that are gone; tags compare in lower case."""
    low = lambda d: d.withColumn("k", F.when(F.col("section") == "tags", F.lower("key")).otherwise(F.col("key")))
    return low(previous).join(low(current).select("identity", "section", "k").distinct(), ["identity", "section", "k"], "left_anti").select("identity", "section", "key")


def stale(mine: DataFrame, pushed: DataFrame, previous: DataFrame) -> DataFrame:
    """My live entries that neither this push nor the one before it had."""
    keys = ["identity", "section", "key"]
    return mine.join(pushed, keys, "left_anti").join(previous, keys, "left_anti")


def accepts_tombstone(original: Column, author: Column) -> Column:
    """A note's tombstone counts if its first author wrote it, or none is known."""
    return original.isNull() | (original == author)


def is_dismissed(seq: Column, dismissed: Column) -> Column:
    return F.coalesce(seq <= dismissed, F.lit(False))


def skips_note(seq: Column, dismissed: Column, failures: Column, most: int = 3) -> Column:
    return is_dismissed(seq, dismissed) | (F.coalesce(failures, F.lit(0)) >= most)


def may_overwrite(local: Column, remote: Column) -> Column:
    """An empty remote value never replaces one that is not."""
    return ~((F.coalesce(remote, F.lit("")) == "") & (F.coalesce(local, F.lit("")) != ""))


def changed(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Items whose hash differs from that of the last push, or that were never pushed."""
    p = previous.select(F.col("identity"), F.col("hash").alias("last"))
    return current.join(p, "identity", "left").filter(~F.col("hash").eqNullSafe(F.col("last"))).drop("last")
