"""The forest of lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import written

#: Up to so many levels the steps are one plan; beyond, each is written and looked at.
CUT = 8

def depths(nodes: DataFrame) -> DataFrame:
    """Adds depth: 0 for a node whose parent is null or not in the set; members of a cycle without root,
    and what hangs below them, come last with the depth -1.

    Parents are followed in doubling steps (each node points ever farther up), so a chain of n nodes
    takes log2(n) joins. Steps end once every pointer has reached a root, or has gone as many levels as there
    are nodes, which only cycles do.
    """
    total = nodes.count()
    up = nodes.alias("c").join(nodes.select(F.col("uuid").alias("p")), F.col("parent") == F.col("p"), "left").select(F.col("uuid").alias("node"), F.col("p").alias("up"), F.when(F.col("p").isNotNull(), 1).otherwise(0).alias("depth"))
    step = 1
    while step <= total:
        far = up.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        up = up.join(far, "up", "left").select("node", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        step *= 2
        if step >= CUT:  # from here on each step would repeat all of the steps before
            up = written(up, "depths")
            if up.filter("up is not null").isEmpty():
                break
    out = nodes.join(up, nodes["uuid"] == up["node"]).drop("node")
    return out.withColumn("depth", F.when(F.col("up").isNull(), F.col("depth")).otherwise(-1)).drop("up")


def in_order(nodes: DataFrame) -> DataFrame:
    """Parents before children, otherwise as they came; cycles last."""
    return depths(nodes).orderBy(F.col("depth") < 0, "depth", "ordinal")


def apply_plan(nodes: DataFrame, mapped: DataFrame, local: DataFrame, me: str) -> DataFrame:
    """uuid, action, local_parent of live foreign nodes: skip (mapped already), map (a local list has the
    name, whatever its parent) or create below the mapped parent, or the root 0."""
    d = nodes.filter(~F.coalesce("deleted", F.lit(False)) & ~F.col("author").eqNullSafe(me))
    names = local.groupBy("name").agg(F.min("local_id").alias("by_name"))
    d = d.join(mapped.select(F.col("uuid"), F.col("local_id").alias("by_uuid")), "uuid", "left").join(names, "name", "left")
    d = d.join(mapped.select(F.col("uuid").alias("parent"), F.col("local_id").alias("at")), "parent", "left")
    action = F.when(F.col("by_uuid").isNotNull(), "skip").when(F.col("by_name").isNotNull(), "map").otherwise("create")
    return d.select("uuid", "name", action.alias("action"), F.when(action == "create", F.coalesce("at", F.lit(0))).alias("local_parent"))
