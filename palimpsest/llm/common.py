"""What the operators share: the scratch tables that cut lineage, and column hygiene."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import importable, shared_dir


def prepared(spark: SparkSession) -> None:
    """Workers find the package, and batches of long texts are small: the session's setting is lowered
    to ``BATCH_BYTES`` where it is larger."""
    importable(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


class Scratch:
    """Tables written to the shared folder in place of recomputed lineage.

    A table survives the loss of any executor. ``drop`` removes tables that no later plan reads;
    those behind a returned DataFrame stay until the folder is cleaned.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.at}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of the batches that go to Python workers, for the session. A batch is held by the executor and by its worker at once.
BATCH_BYTES = 4 << 20


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns with the types the operator works with, so that columns that the
    caller added cannot clash with the operator's own."""
    prepared(df.sparkSession)
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in columns.items()])


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of up to five numbers, 20 MB, that may be broadcast.
SMALL_ROWS = 500_000


def small(written: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A written table of numbers, to be broadcast if its counted rows are few; else Spark shuffles."""
    return F.broadcast(written) if written.count() <= rows else written


SLOTS, SLOT_BITS = 512, 32768


def _flagged(df: DataFrame, key: str, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    h = lambda: F.xxhash64(key, F.lit("bitmap"))
    slot, bit = F.pmod(h(), F.lit(SLOTS)), F.pmod(F.shiftrightunsigned(h(), 20), F.lit(SLOT_BITS))
    maps = wanted.select(slot.alias("slot_"), bit.alias("bit_")).groupBy("slot_").agg(F.bitmap_construct_agg("bit_").alias("map_"))
    maps = scratch.table(maps, "bitmap")
    d = df.withColumn("slot_", slot).withColumn("bit_", bit).join(F.broadcast(maps), "slot_", "left")
    byte = F.conv(F.hex(F.substring(F.col("map_"), F.floor(F.col("bit_") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.expr("shiftright(byte_, cast(bit_ % 8 as int)) & 1 = 1")
    return d.withColumn("byte_", byte).select(*df.columns, F.coalesce(there, F.lit(False)).alias("maybe_"))


def maybe_in(df: DataFrame, key: str, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in the column of the same name of ``wanted``, and few others.

    A bitmap of hashed keys stands for ``wanted``. It has ``SLOTS`` * ``SLOT_BITS`` bits, 2 MB, whatever
    the data, so it can be broadcast and ``df`` is not shuffled; with very many keys it only passes more.
    """
    return _flagged(df, key, wanted, scratch).filter("maybe_").drop("maybe_")


def not_in(df: DataFrame, key: str, gone: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``df`` whose ``key`` is not in ``gone``. Only rows that the bitmap cannot tell meet
    ``gone`` in a join."""
    d = _flagged(df, key, gone, scratch)
    sure = d.filter(~F.col("maybe_")).drop("maybe_")
    return sure.unionByName(d.filter("maybe_").drop("maybe_").join(gone, key, "left_anti").select(*df.columns))
