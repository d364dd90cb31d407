"""Merged state in tiers: a micro-batch writes what it changed, and tombstones expire.

Each batch's winners are a run of their own. When a level has ``FAN`` runs they become one of the next
level, so an entry is rewritten once a level and not once a batch. A manifest names the runs that make
up the state; it is swapped in whole, after its runs are there.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.state import KEY, merge
from palimpsest.sources import files

ENTRY = "identity string, section string, key string, clock long, author string, value string, deleted boolean, deleted_at long"
OP = ["clock", "author", "value", "deleted", "at"]
FAN = 8


class TieredState:
    """The state of an op-log under ``path``, kept by ``absorb`` as a foreachBatch sink.

    Tombstones from more than ``ttl_ms`` before the latest op go when the runs that hold them meet the
    oldest run: only there can nothing older be hidden by them. Any late op merges; one that is older
    than an expired tombstone brings its key back, as on a peer that purged it.
    """

    def __init__(self, spark: SparkSession, path: str, ttl_ms: int | None = None, fan: int = FAN):
        self.spark, self.path, self.ttl_ms, self.fan = spark, path.rstrip("/"), ttl_ms, fan

    def manifest(self, before: int | None = None) -> dict:
        """The newest manifest, or the newest of batches before ``before``."""
        for name in reversed(files.names(self.spark, f"{self.path}/manifests")):
            if name.endswith(".json"):
                m = json.loads(files.read_text(self.spark, f"{self.path}/manifests/{name}"))
                if before is None or m["batch"] < before:
                    return m
        return {"seq": 0, "batch": -1, "high": None, "runs": []}

    def _read(self, runs: list[dict]) -> DataFrame:
        d = self.spark.read.schema(ENTRY).parquet(*[f"{self.path}/runs/{r['name']}" for r in runs])
        return d if len(runs) == 1 else merge(d.withColumnRenamed("deleted_at", "at"))

    def _write(self, entries: DataFrame, name: str, level: int) -> dict:
        entries.write.mode("overwrite").parquet(f"{self.path}/runs/{name}")
        return {"name": name, "level": level}

    def _merge(self, runs: list[dict], name: str, level: int, high: int | None, oldest: bool) -> dict:
        d = self._read(runs)
        if oldest and self.ttl_ms is not None and high is not None:
            d = d.filter(~F.coalesce(F.col("deleted") & (F.col("deleted_at") < high - self.ttl_ms), F.lit(False)))
        return self._write(d, name, level)

    def _commit(self, before: dict, batch: int, high: int | None, runs: list[dict]) -> None:
        last = self.manifest()["seq"]
        m = {"seq": last + 1, "batch": batch, "high": high, "runs": runs}
        files.swap_text(self.spark, f"{self.path}/manifests/{m['seq']:012d}.json", json.dumps(m))

    def absorb(self, batch: DataFrame, number: int) -> None:
        """Merges a micro-batch. One that runs again starts from what was before it and writes the same."""
        m = self.manifest(before=number)
        ops = batch.select(*KEY, *OP)
        high = ops.agg(F.max("at")).first()[0]
        high = max((h for h in (high, m["high"]) if h is not None), default=None)
        runs = [*m["runs"], self._write(merge(ops), f"{number:012d}-0", 0)]
        level = 0
        while sum(r["level"] == level for r in runs) >= self.fan:
            met = [r for r in runs if r["level"] == level]
            above = [r for r in runs if r["level"] > level]
            runs = [*above, self._merge(met, f"{number:012d}-{level + 1}", level + 1, high, not above), *[r for r in runs if r["level"] < level]]
            level += 1
        self._commit(m, number, high, runs)
        named = {r["name"] for r in [*m["runs"], *runs]}  # those of the manifest before serve its readers
        for name in files.names(self.spark, f"{self.path}/runs"):
            if name not in named and name < f"{number:012d}":
                files.remove(self.spark, f"{self.path}/runs/{name}")

    def compact(self) -> None:
        """All runs as one, without expired tombstones: between batches, by hand or by a schedule."""
        m = self.manifest()
        if m["runs"]:
            level = max(r["level"] for r in m["runs"])
            self._commit(m, m["batch"], m["high"], [self._merge(m["runs"], f"{m['batch']:012d}-c{m['seq']:012d}", level, m["high"], True)])

    def read(self) -> DataFrame:
        """The state as of the newest manifest; empty before the first batch."""
        runs = self.manifest()["runs"]
        return self._read(runs) if runs else self.spark.createDataFrame([], ENTRY)
