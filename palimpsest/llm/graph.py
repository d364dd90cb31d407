"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch
from palimpsest.session import importable

ROUNDS = 60
#: Up to so many distinct edges (some 30 MB) one task joins them; beyond, rounds over all tasks do.
ONE_TASK = 1_000_000


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            root.setdefault(a, a)
            root.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "component"])


def connected_components(edges: DataFrame, scratch: Scratch, one_task: int = ONE_TASK) -> DataFrame:
    """node, component (the smallest node reachable) of every node that an edge (a, b) names.

    Up to ``one_task`` edges go through one union-find. More alternate large-star and small-star steps: every node sends its neighbours to the smallest of
    them. Each step is a minimum for each node, made before the shuffle, and a join back, so that a
    node of very many edges is never gathered. Edges between equal nodes and repeated edges change
    nothing; an empty table has no components. What a step writes is dropped once the next is written.
    """
    importable(scratch.spark)
    edges = scratch.table(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct(), "edges")
    if edges.count() <= one_task:
        return scratch.table(edges.coalesce(1).mapInArrow(_in_one_task, "node long, component long"), "components")
    loops = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    now = scratch.table(edges.filter("a <> b"), "edges")
    before = None
    for _ in range(ROUNDS):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        large = scratch.table(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # a node sends its smaller neighbours, and itself, to the smallest of them
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        small = scratch.table(small.filter("a > b").distinct(), "small")
        scratch.drop(now, large)
        now = small
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("the components did not converge")
    return scratch.table(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct()).union(loops.select("node", "node")).groupBy("node").agg(F.min("component").alias("component")), "components")
