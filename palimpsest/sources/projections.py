"""The driver's tables seen as replicated annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTIONS = ("tags", "notes", "selections", "selectionNotes", "transcriptions", "lists")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: str) -> F.Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The op-log: one row for each write of a key. An ``error`` event is a tombstone."""
    number = F.regexp_extract("props", "([0-9]+)", 1)
    section = F.element_at(F.array(*map(F.lit, SECTIONS)), (number.cast("int") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("item"), "user_id").alias("identity"),
        section.alias("section"),
        F.concat(F.lit("k"), number).alias("key"),
        F.concat(F.lit("u"), F.col("event_id") % 5).alias("author"),
        F.col("event_id").alias("clock"),
        F.col("event_type").alias("value"),
        (F.col("event_type") == "error").alias("deleted"),
        millis("ts").alias("at"),
    )


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """local_id, ordinal, checksum: orders are items, their lines are photos."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("local_id"), F.col("l_linenumber").alias("ordinal"), F.concat(F.lit("cs"), "l_partkey").alias("checksum"))


def remote_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identity_id, ordinal, checksum of every fourth item as another replica knows it: a third of them
    equal ours, a third lack their first photo, a third are known by an older identity only."""
    p = photos(spark, sf_dir).filter("local_id % 4 = 0")
    return p.filter("local_id % 3 <> 1 OR ordinal <> 1").select(F.col("local_id").alias("remote_id"), "ordinal", "checksum")


def reconcile_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field of each subject: what we have, what the other has, what we last pushed. Lines are dealt out once, by what
    they are joined by."""
    line = read(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_linestatus").alias("remote_text"), F.max("l_returnflag").alias("flag"), F.max(F.col("l_suppkey") % 3).alias("a"))
    order = read(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.max("o_orderstatus").alias("local_text"))
    d = order.join(line, F.col("o_orderkey") == F.col("l_orderkey"))
    return d.select(
        F.concat(F.lit("item"), "o_orderkey").alias("identity"),
        F.concat(F.lit("dc:field"), "l_linenumber").alias("key"),
        "local_text",
        "remote_text",
        F.when(F.col("l_linenumber") % 2 == 0, F.col("local_text")).otherwise(F.col("flag")).alias("pushed_text"),
        F.concat(F.lit("u"), "a").alias("remote_author"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("n_"), "doc_id").alias("uuid"), "doc_id", "text", F.concat(F.lit("u"), F.col("doc_id") % 5).alias("author"), F.concat(F.lit("cs"), F.col("doc_id") % 50).alias("photo"), F.col("doc_id").alias("clock"))


def transcriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.concat_ws("_", F.lit("t"), "conv_id", "turn").alias("uuid"), "conv_id", "turn", "text", F.col("role").alias("author"))


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.concat_ws("_", F.lit("s"), "l_orderkey", "l_linenumber").alias("uuid"),
        F.concat(F.lit("cs"), "l_partkey").alias("photo"),
        F.concat(F.lit("u"), F.col("l_suppkey") % 5).alias("author"),
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"),
        (F.col("l_discount") * 100).alias("w"),
        (F.col("l_tax") * 100).alias("h"),
    )


def list_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uuid, parent, name, ordinal of a forest: regions above nations."""
    r = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("uuid"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("ordinal"))
    n = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("uuid"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"), (F.col("n_nationkey") + 100).cast("long").alias("ordinal"))
    return r.unionByName(n)
