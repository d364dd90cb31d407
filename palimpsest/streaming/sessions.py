"""Quiet periods and silence in running queries: bursts of changes, and clients that come and go.

Both are session windows with a watermark, so the engine keeps one open window for each key and closes
it by the time of later rows, of any key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import shared_dir


def _timed(rows: DataFrame, late: str) -> DataFrame:
    return rows.withColumn("seen", F.timestamp_millis("at")).withWatermark("seen", late)


def bursts(changes: DataFrame, quiet: str, late: str = "0 seconds") -> DataFrame:
    """identity, first, last (ms), n of each burst of changes (identity, at): one row once nothing changed for ``quiet``.
    Changes without identity are those of one item. Nothing is filtered here: a filter would move below the
    watermark, and what it drops would no longer tell the time."""
    d = _timed(changes, late).groupBy("identity", F.session_window("seen", quiet).alias("w"))
    return d.agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n")).drop("w")


def presence(beats: DataFrame, silence: str, late: str = "0 seconds") -> DataFrame:
    """room, client, name, since, last, expired (ms) of each stay of a client (room, client, name, at): one row once it
    was silent for ``silence``; a client that comes back begins another. The name is the last one given."""
    d = _timed(beats, late).groupBy("room", "client", F.session_window("seen", silence))
    d = d.agg(F.min("at").alias("since"), F.max("at").alias("last"), F.max(F.when(F.col("name").isNotNull(), F.struct("at", "name"))).alias("named"))
    return d.select("room", "client", F.col("named.name").alias("name"), "since", "last", F.unix_millis("session_window.end").alias("expired"))


#: Time (ms) after the last row of a replay at which all of it is over: a year.
LATER = 365 * 86_400_000


def replay(spark: SparkSession, rows: DataFrame, build: Callable[[DataFrame], DataFrame], parts: int = 3) -> DataFrame:
    """What ``build`` gives of ``rows`` (with ``at``, ms) as a stream: the log is written in parts by time, and read back
    part by part by a running query. A last row without keys, ``LATER``, closes what is open."""
    at = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    a, b = rows.agg(F.min("at"), F.max("at")).first()
    if a is None:
        return build(rows)
    step = (b - a) // parts + 1
    for k in range(parts):
        rows.filter((F.col("at") >= a + k * step) & (F.col("at") < a + (k + 1) * step)).write.mode("append").parquet(f"{at}/log")
    tick = spark.range(1).select(*[F.lit(b + LATER if f.name == "at" else None).cast(f.dataType).alias(f.name) for f in rows.schema])
    tick.coalesce(1).write.mode("append").parquet(f"{at}/log")
    stream = build(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{at}/log"))
    stream.writeStream.format("parquet").outputMode("append").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
