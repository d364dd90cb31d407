"""A cycle of synchronisation: stages that need one another, planned by the options, committed once.

What a mode or an option turns off is not planned at all, and neither is what needs it: no table of it is
read. Each planned stage is written before those that need it read it; a cycle that stopped goes on
after the stages that it wrote, and counts only once its manifest is there.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.config import SyncConfig
from palimpsest.sources import files

APPLY, PUSH = "apply", "push"
ROW = "stage string, item string, key string, action string"


@dataclass(frozen=True)
class Stage:
    """``build`` gets the written results of the stages in ``needs`` by name and gives item, key, action."""

    name: str
    side: str
    build: Callable[[dict[str, DataFrame]], DataFrame]
    option: str | None = None
    needs: tuple[str, ...] = ()


def planned(stages: Sequence[Stage], config: SyncConfig) -> list[Stage]:
    """The stages to run, each after what it needs and else in their order: remote changes are applied before ours are
    pushed. A need that is not among ``stages`` is an error, and so are stages that need each other."""
    by_name = {s.name: s for s in stages}
    if unknown := sorted({n for s in stages for n in s.needs} - set(by_name)):
        raise ValueError(f"no such stage: {', '.join(unknown)}")
    on = {APPLY: config.applies, PUSH: config.pushes}
    out: list[Stage] = []
    state: dict[str, bool | None] = {}

    def visit(s: Stage) -> bool:
        if s.name in state:
            if state[s.name] is None:
                raise ValueError(f"stages need each other: {s.name}")
            return bool(state[s.name])
        state[s.name] = None
        wanted = on[s.side] and (s.option is None or getattr(config, s.option))
        state[s.name] = wanted and all([visit(by_name[n]) for n in s.needs])
        if state[s.name]:
            out.append(s)
        return bool(state[s.name])

    for side in (APPLY, PUSH):
        for s in stages:
            if s.side == side:
                visit(s)
    return out


class Cycles:
    """The cycles under ``path``: their stages as tables, and a manifest for each that is complete."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, number: int) -> str:
        return f"{self.path}/cycle-{number:012d}"

    def run(self, number: int, stages: Sequence[Stage], config: SyncConfig) -> DataFrame:
        """The rows of a cycle. One that is committed is read, not run again; one that stopped goes on."""
        if self.committed(number) is None:
            done: dict[str, DataFrame] = {}
            todo = planned(stages, config)
            for s in todo:
                at = f"{self._at(number)}/{s.name}"
                if not files.exists(self.spark, f"{at}/_SUCCESS"):
                    rows = s.build({n: done[n] for n in s.needs})
                    rows.select(F.lit(s.name).alias("stage"), *[F.col(c).cast("string").alias(c) for c in ("item", "key", "action")]).write.mode("overwrite").parquet(at)
                done[s.name] = self.spark.read.schema(ROW).parquet(at)
            files.swap_text(self.spark, f"{self._at(number)}/committed.json", json.dumps({"mode": config.mode, "stages": [s.name for s in todo]}))
        return self.read(number)

    def committed(self, number: int) -> dict | None:
        text = files.read_text(self.spark, f"{self._at(number)}/committed.json")
        return None if text is None else json.loads(text)

    def last(self) -> int | None:
        """The number of the last committed cycle."""
        numbers = [int(n[6:]) for n in files.names(self.spark, self.path) if n.startswith("cycle-")]
        return max((n for n in numbers if self.committed(n) is not None), default=None)

    def read(self, number: int) -> DataFrame:
        """stage, item, key, action of a committed cycle; no rows of another, however much of it is written."""
        found = self.committed(number)
        if not found or not found["stages"]:
            return self.spark.createDataFrame([], ROW)
        return self.spark.read.schema(ROW).parquet(*[f"{self._at(number)}/{s}" for s in found["stages"]])


def reports(rows: DataFrame) -> DataFrame:
    """stage, action, n of a cycle: what its statistics tell."""
    return rows.groupBy("stage", "action").agg(F.count(F.lit(1)).alias("n"))
