"""What a session needs to run the package."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> None:
    """Lets Python workers that start from now on import this package from where the driver has it.

    That is enough where executors see the same folder; elsewhere ship the package with ``--py-files``.
    """
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *known])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session on one machine that names none gets a folder of its own; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, which cuts its lineage. Tables of long values take small row groups: a
    reader holds up to 4,096 rows of a group at a time."""
    at, spark = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.sparkSession
    shred, was = "spark.sql.variant.inferShreddingSchema", spark.conf.get("spark.sql.variant.inferShreddingSchema", None)
    spark.conf.set(shred, "false")  # a VARIANT is put back together from all of its columns when it is read whole
    try:
        df.write.options(**({"parquet.block.size": str(group_bytes)} if group_bytes else {})).parquet(at)
    finally:
        spark.conf.unset(shred) if was is None else spark.conf.set(shred, was)
    return spark.read.schema(df.schema).parquet(at)
