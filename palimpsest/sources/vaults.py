"""A store of vaults: versions that are swapped in whole, each user's own vault before the room's shared one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.scalar import room_name
from palimpsest.sources import files
from palimpsest.sources.readers import parse_vault

STORED = "name string, value string"


def vault_name(room: Column, user: Column) -> Column:
    """What a vault is stored under: the room, and the user if it is theirs alone."""
    return F.concat(room_name(room), F.when(F.coalesce(user, F.lit("")) != "", F.concat(F.lit("_"), room_name(user))).otherwise(F.lit("")))


class VaultStore:
    """Vaults by name under ``path``. A save writes a version beside the others and then swaps the pointer, so one that
    stops before leaves the old version in place; the last ``kept`` versions stay for readers."""

    def __init__(self, spark: SparkSession, path: str, kept: int = 2):
        self.spark, self.path, self.kept = spark, path.rstrip("/"), kept

    def current(self) -> str | None:
        return files.read_text(self.spark, f"{self.path}/current")

    def stored(self) -> DataFrame:
        """name, value (JSON text) of all vaults of the current version."""
        now = self.current()
        return self.spark.createDataFrame([], STORED) if now is None else self.spark.read.schema(STORED).parquet(f"{self.path}/{now}")

    def write(self, vaults: DataFrame) -> str:
        """Writes the next version: vaults (room, user, value) replace those of the same name, others stay. It is
        not the current one before ``swap``. Of vaults with the same name the largest text counts."""
        new = vaults.groupBy(vault_name(F.col("room"), F.col("user")).alias("name")).agg(F.max("value").alias("value"))
        whole = new.unionByName(self.stored().join(new.select("name"), "name", "left_anti"))
        now = self.current()
        name = f"v{int(now[1:]) + 1 if now else 1:012d}"
        whole.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return name

    def swap(self, name: str) -> None:
        files.swap_text(self.spark, f"{self.path}/current", name)
        old = [n for n in files.names(self.spark, self.path) if n.startswith("v") and n < name]
        for n in old[: -self.kept + 1 or None]:
            files.remove(self.spark, f"{self.path}/{n}")

    def save(self, vaults: DataFrame) -> None:
        self.swap(self.write(vaults))

    def load(self, asked: DataFrame) -> DataFrame:
        """room, user, origin, vault for every row of ``asked`` (room, user).

        origin is ``user`` for a vault of the user's own, ``shared`` for the room's where the user has none, else
        null. An own vault that is broken or of another version is not replaced by the shared one: vault is null.
        """
        texts = self.stored()
        own = texts.select(F.col("name").alias("own"), F.col("value").alias("mine"))
        shared = texts.select(F.col("name").alias("shared"), F.col("value").alias("theirs"))
        d = asked.withColumn("own", vault_name(F.col("room"), F.col("user"))).withColumn("shared", room_name(F.col("room")))
        d = d.join(own, "own", "left").join(shared, "shared", "left")
        has_own = F.col("mine").isNotNull()
        origin = F.when(has_own & (F.col("own") != F.col("shared")), "user").when(F.col("theirs").isNotNull(), "shared")
        return d.select("room", "user", origin.alias("origin"), parse_vault(F.when(has_own, F.col("mine")).otherwise(F.col("theirs"))).alias("vault"))
