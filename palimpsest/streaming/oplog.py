"""The op-log as a stream: a change feed, and a state that is merged as ops arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.state import merge
from palimpsest.session import shared_dir
from palimpsest.sources import readers
from palimpsest.streaming.tiers import FAN, TieredState


def change_feed(ops: DataFrame, me: str) -> DataFrame:
    """identity, section of what others changed."""
    return foreign_ops(ops, me).select("identity", "section")


def foreign_ops(ops: DataFrame, me: str) -> DataFrame:
    """What others changed; a change without author is one of others."""
    return ops.filter(~F.col("author").eqNullSafe(me))


def replay_tiers(spark: SparkSession, ops: DataFrame, parts: int = 3, ttl_ms: int | None = None, fan: int = FAN) -> TieredState:
    """Writes an op-log in parts by time and streams it into a state in tiers, which is compacted at the end."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    a, b = ops.agg(F.min("at"), F.max("at")).first()
    state = TieredState(spark, f"{at}/state", ttl_ms, fan)
    if a is None:
        return state
    step = (b - a) // parts + 1
    for k in range(parts):
        ops.filter((F.col("at") >= a + k * step) & (F.col("at") < a + (k + 1) * step)).write.mode("append").parquet(f"{at}/log")
    stream = readers.op_stream(spark, f"{at}/log")
    stream.writeStream.foreachBatch(state.absorb).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    state.compact()
    return state


def replay(spark: SparkSession, ops: DataFrame) -> DataFrame:
    """The state after an op-log was streamed; every op of any time merges."""
    return replay_tiers(spark, ops).read()


def safety_poll(ops: DataFrame, applied: DataFrame) -> DataFrame:
    """The identities whose merged state holds an entry newer than what was applied (identity, clock): what a full
    poll finds when changes were missed."""
    now = merge(ops).groupBy("identity").agg(F.max("clock").alias("now"))
    return now.join(applied, "identity", "left").filter(F.col("clock").isNull() | (F.col("now") > F.col("clock"))).select("identity")


def activity(history: DataFrame, live: DataFrame) -> DataFrame:
    """History, then what is live: each event once, by its number (seq)."""
    return history.unionByName(live).dropDuplicates(["seq"])
