"""Mixing sources to target weights by entropy balancing.

Documents get rates that stay as close as possible, in relative entropy over tokens, to one copy each
while the tokens taken from every source meet its target. The dual of that problem is convex and its
solution tilts rates exponentially: rate = exp(lambda . features). Newton iterations solve the dual;
each adds up gradient and curvature over all documents. Rates are then rounded into whole copies.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch, only, small

MAX_COPIES = 3
ITERATIONS, TOLERANCE = 60, 1e-10
BUCKETS = 1024
FLIPS = 16
#: Bytes of a table of sources, names included, that may be broadcast; larger ones are left to Spark's joins.
SENT = 16 << 20


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the words of the text, which spaces and \\t to \\r divide; null: 0."""
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return only(docs, doc_id="long", source="string", text="string").select("doc_id", "source", F.coalesce(F.size(words), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("text_hash"))


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = (1, 2, 3), most: float = MAX_COPIES) -> dict[str | None, float]:
    """Targets of all sources from their sizes. Sources by code point, null last, get the weights in
    turn; the sum of all sizes is shared by weight. A target stops at ``most`` times the source's
    size, and its excess is shared again by weight until none is above."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    cap = {s: float(most * n) for s, n in order}
    total, fixed = float(sum(n for _, n in order)), {}
    while True:
        free = [s for s, _ in order if s not in fixed]
        rest, parts = total - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: rest * weight[s] / parts for s in free}
        above = [s for s in free if share[s] > cap[s]]
        if not above:
            return fixed | share
        fixed |= {s: cap[s] for s in above}


def dual(docs: DataFrame, goal: dict[str | None, float], sizes: dict[str | None, int], iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> dict[str | None, float]:
    """The multipliers of the sources by damped Newton iterations on the dual

        sum of size * exp(lambda_source) - sum of target_source * lambda_source.

    Each iteration adds up the tokens that the present rates take from every source: the gradient is
    that sum less the target, and as each document belongs to one source, the curvature is diagonal
    with the same sums. Only one row a source comes back. A source without words or target stays out.
    """
    lam = {s: 0.0 for s in goal if goal[s] > 0 and sizes[s] > 0}
    spark = docs.sparkSession
    for _ in range(iterations):
        if not lam:
            break
        now = spark.createDataFrame([(s, v) for s, v in lam.items()], "source string, lambda double")
        now = F.broadcast(now) if sum(len(s or "") * 4 + 64 for s in lam) <= SENT else now
        sums = docs.join(now, docs["source"].eqNullSafe(now["source"])).groupBy(docs["source"]).agg(F.sum(F.col("size") * F.exp("lambda")).alias("taken"))
        worst = 0.0
        for r in sums.collect():
            s, taken = r["source"], r["taken"]
            step = (goal[s] - taken) / taken
            worst = max(worst, abs(taken - goal[s]) / goal[s])
            lam[s] += max(-1.0, min(1.0, step))
        if worst < tolerance:
            break
    return lam


def _placed(docs: DataFrame) -> DataFrame:
    """Adds order (a hash that stands for chance), class (log2 of the size; -1 without words) and bucket."""
    order = F.xxhash64("doc_id", "text_hash", F.lit("copies"))
    size_class = F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(-1).cast("int")
    return docs.withColumn("order", order).withColumn("class", size_class).withColumn("bucket", F.shiftright("order", 64 - BUCKETS.bit_length() + 1))


def _sent(sources: DataFrame) -> DataFrame:
    """A table with a column source, to be broadcast if its measured size is at most ``SENT``."""
    n = sources.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + F.lit(64))).first()[0]
    return F.broadcast(sources) if (n or 0) <= SENT else sources


def _with(docs: DataFrame, rates: DataFrame) -> DataFrame:
    return docs.join(rates.withColumnRenamed("source", "r_source"), docs["source"].eqNullSafe(F.col("r_source"))).drop("r_source")


def thresholds(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """source, class, last: of a class of a source the documents whose order is at most ``last`` get
    one copy more than floor(rate), so that these hold the class's share of the rest.

    Sizes are summed by hash bucket first; only the bucket that holds the end of the share is then
    summed document by document, and it is a ``BUCKETS``-th of a class.
    """
    placed = _with(_placed(docs), rates)
    cells = placed.filter("class >= 0").groupBy("source", "class", "bucket").agg(F.sum("size").alias("tokens"), F.first("part").alias("part"))
    group = Window.partitionBy("source", "class")
    cells = cells.withColumn("upto", F.sum("tokens").over(group.orderBy("bucket"))).withColumn("share", F.col("part") * F.sum("tokens").over(group))
    edge = cells.filter("upto >= share").groupBy("source", "class").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("before"), "share")).alias("edge"))
    edge = edge.select(F.col("source").alias("e_source"), F.col("class").alias("e_class"), "edge.*").withColumnRenamed("bucket", "e_bucket")
    at = placed["source"].eqNullSafe(F.col("e_source")) & (placed["class"] == F.col("e_class")) & (placed["bucket"] == F.col("e_bucket"))
    inside = placed.join(edge, at).withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source", "class").orderBy("order")))
    inside = inside.groupBy("source", "class").agg(
        F.max(F.when(F.col("upto") - F.col("size") / 2 <= F.col("share"), F.col("order"))).alias("found"),
        F.first("e_bucket").alias("e_bucket"),
    )
    # where no document of the bucket is taken, the end is just before the bucket
    shift = 64 - BUCKETS.bit_length() + 1
    lowest = F.col("e_bucket") == -(BUCKETS // 2)
    before = F.when(lowest, F.lit(-(1 << 63))).otherwise(F.shiftleft(F.col("e_bucket"), shift) - F.when(lowest, 0).otherwise(1))
    return inside.select("source", "class", F.coalesce("found", before).alias("last"))


def apply_copies(docs: DataFrame, plan: Plan) -> DataFrame:
    """``docs`` (with source, size, doc_id, text_hash) and n_copies. The plan's tables have a few rows for
    each source; ``docs`` is not shuffled while these are small enough to be broadcast."""
    d = _with(_placed(docs), plan.rates)
    ends = plan.ends.select(F.col("source").alias("e_source"), F.col("class").alias("e_class"), "last")
    d = d.join(ends, d["source"].eqNullSafe(F.col("e_source")) & (d["class"] == F.col("e_class")), "left")
    chance = (F.col("order") / F.lit(2.0**64)) + 0.5
    extra = F.when(F.col("part") <= 0, 0).when(F.col("size") > 0, (F.col("order") <= F.col("last")).cast("int")).otherwise((chance < F.col("part")).cast("int"))
    d = d.withColumn("n_copies", F.col("whole") + F.coalesce(extra, F.lit(0)))
    if plan.flips is not None:
        flips = plan.flips.select(F.col("doc_id").alias("f_doc"), F.col("text_hash").alias("f_hash"), "flip")
        d = d.join(flips, d["doc_id"].eqNullSafe(F.col("f_doc")) & d["text_hash"].eqNullSafe(F.col("f_hash")), "left")
        d = d.withColumn("n_copies", F.col("n_copies") + F.coalesce("flip", F.lit(0))).drop("f_doc", "f_hash", "flip")
    return d.drop("e_source", "e_class", "last", "order", "class", "bucket", "whole", "part", "rate")


@dataclass
class Plan:
    """How a mix is taken. rates: source, source_size, target, rate, whole, part; ends: see
    ``thresholds``; flips: doc_id, text_hash, flip (1 or -1 copy) of at most ``FLIPS`` documents
    of each source and size class."""

    rates: DataFrame
    ends: DataFrame
    flips: DataFrame | None


def _flips(docs: DataFrame, plan: Plan) -> DataFrame:
    """Closes what rounding by classes leaves of each source's target, by single documents.

    For each source, size class and direction a few documents that could change by one copy are
    found by sums of their hash buckets; from the largest down, each one that fits into what is left
    changes, and at last one more if that brings the source nearer to its target.
    """
    taken = _placed(apply_copies(docs, plan)).filter("size > 0")
    gap = taken.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("n_copies"))).alias("gap"))
    one = F.struct("order", "doc_id", "text_hash", "size")
    can = taken.groupBy("source", "class", F.pmod("bucket", F.lit(FLIPS)).alias("slot")).agg(
        F.min(F.when(F.col("n_copies") < MAX_COPIES, one)).alias("more"), F.min(F.when(F.col("n_copies") > 0, one)).alias("less")
    )
    gap = gap.withColumnRenamed("source", "g_source")
    can = can.join(gap, can["source"].eqNullSafe(gap["g_source"])).drop("g_source")
    can = can.withColumn("one", F.when(F.col("gap") > 0, F.col("more")).otherwise(F.col("less"))).filter("one is not null and gap <> 0")
    can = can.select("source", "gap", "one.*")

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "order"], ascending=[False, True])
        sizes, left, chosen = pdf["size"].tolist(), abs(pdf["gap"].iloc[0]), []
        for i, size in enumerate(sizes):
            if size <= left:
                left -= size
                chosen.append(i)
        over = min((i for i in range(len(sizes)) if i not in set(chosen)), key=lambda i: abs(left - sizes[i]), default=None)
        if over is not None and abs(left - sizes[over]) < left:
            chosen.append(over)
        out = pdf.iloc[chosen]
        return pd.DataFrame({"doc_id": out["doc_id"], "text_hash": out["text_hash"], "flip": (out["gap"] > 0).astype("int64") * 2 - 1})

    return can.groupBy("source").applyInPandas(close, "doc_id long, text_hash long, flip long")


def plan_mix(spark: SparkSession, docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (1, 2, 3)) -> Plan:
    """The mix of ``docs`` as ``sized`` gives them, which should be a written table."""
    totals = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    goal = targets(list(totals.items()), weights)
    lam = dual(docs, goal, totals)
    rows = []
    for s, n in totals.items():
        rate = min(float(MAX_COPIES), math.exp(lam[s])) if s in lam else 0.0
        whole = min(MAX_COPIES, math.floor(rate + 1e-9))
        rows.append((s, n, goal[s], rate, whole, max(0.0, rate - whole)))
    rates = spark.createDataFrame(rows, "source string, source_size long, target double, rate double, whole long, part double")
    rates = _sent(rates)
    plan = Plan(rates, _sent(scratch.table(thresholds(docs, rates), "ends")), None)
    plan.flips = small(scratch.table(_flips(docs, plan), "flips"))
    return plan


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, source, size, source_size, target, n_copies, taken of every row of ``docs``.

    A null or empty text has size 0 and takes 0 words. A null source is a source of its own, the
    last. Rows that are equal in doc_id and text get equal copies. An empty table gives no rows.
    Other columns are ignored.
    """
    scratch = Scratch(spark, "mixing")
    d = scratch.table(sized(docs), "sized")
    out = apply_copies(d, plan_mix(spark, d, scratch, weights))
    return out.select("doc_id", "source", "size", "source_size", "target", "n_copies", (F.col("n_copies") * F.col("size")).alias("taken"))


def repeat_documents(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The rows of ``docs`` (columns of ``documents``), each as often as the mix takes it."""
    scratch = Scratch(spark, "mixing")
    plan = plan_mix(spark, scratch.table(sized(docs), "sized"), scratch, weights)
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    # whole rows travel in a struct, so that no column of theirs can clash
    d = docs.select(F.struct("*").alias("row"), "doc_id", "source", F.coalesce(F.size(words), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("text_hash"))
    d = apply_copies(d, plan).filter("n_copies > 0")
    return d.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies")))).select("row.*")
