"""Nearest neighbours by multi-index hashing of learned binary codes.

Unit vectors are turned by learned rotations (principal axes, then the rotation that loses least by taking
signs) and become codes of ``BITS`` bits. A code is cut into bytes, and each byte has an index of its own.
If two codes differ in at most r bits, some byte differs in at most r // bytes bits, so probing each index
for all near bytes retrieves every code within the radius; what it retrieves is then compared as floats.

The radius is learned with the rotations on a bounded sample: it holds nearly all of the sample's nearest
neighbours, which are farther than those of the whole table. Every vector is indexed. The recall is
audited against brute force on a fixed number of queries, and the radius grows while it is too low.
Vectors are dealt to blocks by hash, and queries go to every block, so no list and no block depends on how
vectors cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch
from palimpsest.llm.neighbours import matrix

BITS, FIT_ROWS, FIT_QUERIES, TURNS = 256, 4096, 256, 25
NEAREST, COVER, AUDIT, RECALL = 5, 0.97, 64, 0.94
BLOCK, QUERIES = 8192, 2048
_POP = np.array([[bin(a ^ b).count("1") for b in range(256)] for a in range(256)], np.uint8)
_NEAR = [np.flatnonzero(_POP[0] <= d).astype(np.uint8) for d in range(9)]


@dataclass
class Codes:
    """``planes``: a column for each bit of a code; ``radius``: in bits."""

    planes: np.ndarray
    radius: int

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes of unit vectors, a row of ``BITS`` // 8 bytes each."""
        return np.packbits(x @ self.planes > 0, axis=1) if len(x) else np.zeros((0, BITS // 8), np.uint8)


def learn(x: np.ndarray, k: int = NEAREST, cover: float = COVER) -> Codes:
    """Rotations and radius from a sample of unit vectors (one or more rows)."""
    rng = np.random.default_rng(11)
    dim = x.shape[1]
    axes = np.linalg.svd(x, full_matrices=True)[2].T
    y, planes = x @ axes, []
    while sum(p.shape[1] for p in planes) < BITS:
        turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(TURNS):
            u, _, v = np.linalg.svd(np.where(y @ turn > 0, 1.0, -1.0).T @ y)
            turn = (u @ v).T
        planes.append(axes @ turn)
    codes = Codes(np.concatenate(planes, axis=1)[:, :BITS], BITS)
    q = x[: min(len(x), FIT_QUERIES)]
    s = q @ x.T
    s[np.arange(len(q)), np.arange(len(q))] = -2
    top = np.argsort(-s, axis=1)[:, : min(k, len(x) - 1)]
    c = codes.of(x)
    far = np.bitwise_count(c[: len(q), None, :] ^ c[top]).sum(axis=2, dtype=np.int64)
    if far.size:
        codes.radius = int(np.quantile(far, cover, method="higher"))
    return codes


class MultiIndex:
    """Indexes of the bytes of some codes."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.n = codes, len(codes)
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.start = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code differs in at most ``radius`` bits.

        Of m bytes, the first radius % m + 1 are probed up to radius // m bits, the others up to one less:
        a code that passes none differs in more than ``radius`` bits.
        """
        m = self.codes.shape[1]
        near, extra = divmod(min(radius, 8 * m), m)
        seen = np.zeros(self.n, bool)
        for j in range(m):
            d = near if j <= extra else near - 1
            if d < 0:
                continue
            probes = _NEAR[min(d, 8)] ^ code[j]
            low = self.start[j][probes]
            n = self.start[j][probes.astype(np.int64) + 1] - low
            ends = np.cumsum(n)
            seen[self.order[j][np.repeat(low - (ends - n), n) + np.arange(ends[-1])]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1, dtype=np.int64) <= radius]


def measure(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of one vector with rows, each added up in its own row, so that equal rows have equal ones."""
    return np.sum(x * q, axis=1) / (np.sqrt(np.sum(x * x, axis=1)) * np.sqrt(np.sum(q * q)))


def best(q_id: int, q: np.ndarray, ids: np.ndarray, x: np.ndarray, unit: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    rows = rows[ids[rows] != q_id]
    if len(rows) > k:
        rough = unit[rows] @ (q / np.sqrt(np.sum(q * q)))
        rows = rows[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9]
    s = measure(q, x[rows])
    first = np.lexsort((ids[rows], -s))[:k]
    return [(q_id, int(ids[rows[i]]), float(s[i])) for i in first]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, x of vectors that take part, one row for each vec_id and vector."""
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).filter("vec_id is not null and x is not null and size(x) > 0")
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("x", lambda c: c != 0)
    return d.filter(fine)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    return x / np.sqrt(np.sum(x * x, axis=1, keepdims=True)) if len(x) else x


def search(data: DataFrame, queries: DataFrame, codes, k: int, radius: int, n: int, n_queries: int) -> DataFrame:
    """query_id, vec_id, score, rank: the ``k`` nearest that the radius retrieves for each query."""
    blocks, parts = max(1, -(-n // BLOCK)), max(1, -(-n_queries // QUERIES))
    mine = lambda m, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(m))
    spread = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    d = data.select(mine(blocks, 1).alias("i"), spread(parts).alias("j"), F.lit(False).alias("asks"), "vec_id", "x")
    q = queries.select(spread(blocks).alias("i"), mine(parts, 2).alias("j"), F.lit(True).alias("asks"), "vec_id", "x")

    def run(t: pa.Table) -> pa.Table:
        asks, ids, x = t["asks"].to_numpy(), t["vec_id"].to_numpy(), matrix(t["x"])
        order = np.argsort(ids, kind="stable")
        asks, ids, x = asks[order], ids[order], x[order]
        unit, out = _unit(x), []
        c = codes.value.of(unit)
        index = MultiIndex(c[~asks])
        rows_x, rows_u, rows_id = x[~asks], unit[~asks], ids[~asks]
        for q_id, q, code in zip(ids[asks].tolist(), x[asks], c[asks], strict=True):
            out += best(q_id, q, rows_id, rows_x, rows_u, index.within(code, radius), k)
        return pa.table([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    found = d.unionByName(q).groupBy("i", "j").applyInArrow(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(f"rank <= {k}")


def brute_force(spark: SparkSession, data: DataFrame, queries: list, k: int) -> DataFrame:
    """query_id, vec_id, score of the ``k`` nearest of a bounded list of queries, over all vectors."""
    asked = spark.sparkContext.broadcast([(r["vec_id"], np.array(r["x"])) for r in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b["vec_id"].to_numpy(), matrix(b["x"])
            unit, out = _unit(x), []
            for q_id, q in asked.value if len(ids) else []:
                out += best(q_id, q, ids, x, unit, np.arange(len(ids)), k)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    found = data.select("vec_id", "x").mapInArrow(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(f"rank <= {k}")


def nearest(spark: SparkSession, vectors: DataFrame, queries, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score, recall: for the rows of ``vectors`` (vec_id, embedding) that satisfy
    the condition ``queries`` their ``k`` nearest other vectors by cosine, ties to the smaller vec_id.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, and neither do
    those of another length than the first, or without vec_id. Repeated rows count once; of rows that
    repeat a vec_id with another vector, each is searched and each may be found, by its best score. A query
    for which the radius holds fewer than ``k`` vectors is searched with the full radius. An empty table
    gives no rows. Other columns are ignored.
    """
    scratch = Scratch(spark, "hamming")
    data = scratch.table(usable(vectors).distinct(), "vectors")
    first = data.select(F.min(F.struct("vec_id", F.size("x").alias("n"))).alias("m")).first()["m"]
    schema = "query_id long, rank int, vec_id long, score double, recall double"
    if first is None:
        return spark.createDataFrame([], schema)
    data = data.filter(F.size("x") == first["n"])
    asked = data.filter(queries)
    n, n_queries = data.count(), asked.count()
    sample = data.orderBy(F.xxhash64("vec_id", F.lit("fit")), "vec_id").limit(FIT_ROWS).collect()
    fitted = learn(_unit(np.array([r["x"] for r in sample])), k)
    codes = spark.sparkContext.broadcast(fitted)
    audited = asked.orderBy(F.xxhash64("vec_id", F.lit("audit")), "vec_id").limit(AUDIT).collect()
    radius, recall = fitted.radius, 1.0
    true = {(r["query_id"], r["vec_id"]) for r in brute_force(spark, data, audited, k).collect()}
    while True:
        found = scratch.table(search(data, asked, codes, k, radius, n, n_queries), "found")
        ids = [r["vec_id"] for r in audited]
        got = {(r["query_id"], r["vec_id"]) for r in found.filter(F.col("query_id").isin(ids)).select("query_id", "vec_id").collect()} if ids else set()
        recall = len(true & got) / len(true) if true else 1.0
        if recall >= RECALL or radius >= BITS:
            break
        radius += 8
        scratch.drop(found)
    enough = found.groupBy("query_id").count().filter(f"count >= {k}")
    short = asked.join(enough, asked["vec_id"] == enough["query_id"], "left_anti")
    n_short = short.count() if radius < BITS else 0
    if n_short:
        rest = scratch.table(search(data, scratch.table(short, "short"), codes, k, BITS, n, n_short), "rest")
        found = found.join(rest.select("query_id").distinct(), "query_id", "left_anti").unionByName(rest)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", F.lit(float(recall)).alias("recall"))
