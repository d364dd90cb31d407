"""Near-duplicate embeddings by NN-descent.

Every vector keeps a list of its nearest neighbours so far. A round sends each vector to the vectors in
whose lists it is, compares the neighbours of each vector with each other there (neighbours of neighbours),
and keeps the nearest. A vector whose whole list is at or above the threshold has a longer list in the next
round. Rounds end when few lists change. Every pair at or above the threshold that was met joins components,
whether a list has room for it or not; links inside a component are counted exactly, so that lists need not
be as long as the largest group.

Lists full of a vector's own component hide what is near it outside. So turns follow in which only vectors
of other components are listed, compared and met, along new projections, with a few of the vector's own
component to hear from. They end when nothing more joins and the recall is high enough; if ``TURNS`` turns do
not reach that, products of all pairs of blocks do. The recall is audited against
brute force on vectors chosen by hash before anything is found: on more of them, up to ``AUDIT_MOST``, until
``AUDIT_LINKS`` links are among theirs.

Equal vectors are one node. Lists hold no vectors farther than ``FLOOR``, twice the threshold's angle: those that link with
a common vector are within it. Lists begin from neighbours along sorted random projections, which have windows
of a fixed width whatever the data. There are as many projections as it takes to put a lone pair at the
threshold, in a table without other structure, into one of the windows with a probability of ``RECALL``.

Vectors travel as bytes: as halves while neighbours are searched, and as doubles where a product is so near
the threshold that halves cannot tell, and where links are counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch, only, width
from palimpsest.llm.graph import connected_components

COSINE = 0.9
FLOOR = 2 * COSINE**2 - 1
LIST, LONGEST, SORTS, WINDOW = 8, 64, 6, 4
ROUNDS, CHANGED = 6, 0.01
AUDIT, AUDIT_MOST, AUDIT_LINKS, RECALL = 64, 4096, 200, 0.98
BLOCK = 512
#: Neighbours of the own component that a vector hears from, and turns at most; then all pairs are compared.
KIN, TURNS = 4, 10
#: Products of unit vectors rounded to halves (a part of 2**-11 each at most) are off by less.
SLACK = 2**-9


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v (unit length, the bytes of doubles) of the usable vectors: not null or zero, all components finite."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, ids = b["embedding"], b["vec_id"].to_numpy()
            size = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            first, flat = np.cumsum(size) - size, column.flatten().to_numpy(zero_copy_only=False)
            for n in np.unique(size[size > 0]).tolist():
                rows = np.flatnonzero(size == n)
                x = flat[first[rows][:, None] + np.arange(n)]
                top = np.abs(x).max(axis=1)
                fine = np.isfinite(x).all(axis=1) & (top > 0)
                x = x[fine] / top[fine, None]  # no overflow of squares
                x = x / np.sqrt(np.sum(x * x, axis=1, keepdims=True)) + 0.0  # no negative zeros
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows][fine]), packed(x)], names=["vec_id", "v"])

    return only(vectors, vec_id="long", embedding="array<double>").filter("vec_id is not null").mapInArrow(scale, "vec_id long, v binary")


def matrix(column) -> np.ndarray:
    """A list column as a matrix; all lists have the same length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def packed(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of bytes."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def dense(column, kind: type = np.float64) -> np.ndarray:
    """A column of ``packed`` rows, all of the same length, as a matrix; halves as single precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    x = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1)
    return x.astype(np.float32) if kind is np.float16 else x


def with_halves(nodes: DataFrame) -> DataFrame:
    """id, size, v and x, the vector as the bytes of halves."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            half = pa.array([np.frombuffer(v.as_buffer(), np.float64).astype(np.float16).tobytes() for v in b["v"]], pa.binary())
            yield pa.RecordBatch.from_arrays([b["id"], b["size"], b["v"], half], names=["id", "size", "v", "x"])

    return nodes.select("id", "size", "v").mapInArrow(add, "id long, size long, v binary, x binary")


def runs(batches: Iterator[pa.RecordBatch], keys: int, column: str, kind: type) -> Iterator[tuple[list[np.ndarray], list[int]]]:
    """Of batches sorted by their first ``keys`` columns: the columns, ``column`` as a matrix, and where
    whole runs of equal keys begin and end."""
    held: list[np.ndarray] | None = None
    for b in batches:
        if not len(b):
            continue
        now = [dense(b[c], kind) if c == column else b[c].to_numpy(zero_copy_only=False) for c in b.schema.names]
        if held is not None:
            now = [np.concatenate([h, n]) for h, n in zip(held, now, strict=True)]
        differs = np.zeros(len(now[0]) - 1, bool)
        for k in range(keys):
            differs |= now[k][1:] != now[k][:-1]
        edges = [0, *(np.flatnonzero(differs) + 1).tolist()]
        held = [c[edges[-1] :] for c in now]
        if len(edges) > 1:
            yield now, edges
    if held is not None:
        yield held, [0, len(held[0])]


def projections(n: int) -> int:
    """How many projections of ``n`` vectors find a pair at the threshold with a probability of ``RECALL``.

    Two vectors are on one side of a random plane with a probability of 1 - angle / pi, and some
    log2(n / WINDOW) planes cut the table down to a window.
    """
    one = (1 - math.acos(COSINE) / math.pi) ** math.log2(max(2.0, n / WINDOW))
    return math.ceil(math.log(1 - RECALL) / math.log(1 - one))


def _initial(spark: SparkSession, nodes: DataFrame, dim: int, n: int, turn: int = 0, floor: float = FLOOR) -> DataFrame:
    """Pairs (a, b, s) of different components, with s of at least ``floor``, near each other along random projections: each projection
    sorts the vectors by the signs of some directions and by one more, and pairs those within ``WINDOW``
    places. Every turn has projections of its own."""
    rng = np.random.default_rng(7 + turn)
    bits = max(16, math.ceil(math.log2(max(2, n))))
    planes = [rng.normal(size=(dim, bits + 1)) for _ in range(SORTS)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = dense(b["x"], np.float16).astype(np.float64)
            for k, p in enumerate(planes):
                y = x @ p if len(x) else np.zeros((0, bits + 1))
                sign = (y[:, :bits] > 0) @ (1 << np.arange(bits))
                key = k * 2.0**bits + sign + 0.5 + np.arctan(y[:, bits]) / np.pi
                yield pa.RecordBatch.from_arrays([pa.array(key), b["id"], b["part"], b["x"]], names=["key", "id", "part", "x"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_id, last_part, last_x = np.zeros(0, np.int64), None, None
        for b in batches:
            ids, part, x = b["id"].to_numpy(), b["part"].to_numpy(), dense(b["x"], np.float16)
            if not len(ids):
                continue
            fresh = len(last_id)
            if fresh:
                ids, part, x = np.concatenate([last_id, ids]), np.concatenate([last_part, part]), np.concatenate([last_x, x])
            out = []
            for d in range(1, WINDOW + 1):
                lo = max(0, fresh - d)
                a, c = np.arange(lo, len(ids) - d), np.arange(lo + d, len(ids))
                a, c = a[part[a] != part[c]], c[part[a] != part[c]]
                s = np.einsum("ij,ij->i", x[a], x[c]).astype(np.float64)
                out.append((ids[a][s >= floor], ids[c][s >= floor], s[s >= floor]))
            a, c, s = (np.concatenate([o[i] for o in out]) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(s)], names=["a", "b", "s"])
            last_id, last_part, last_x = ids[-WINDOW:], part[-WINDOW:], x[-WINDOW:]

    keyed = nodes.select("id", "part", "x").mapInArrow(project, "key double, id long, part long, x binary")
    return keyed.repartitionByRange(width(spark), "key").sortWithinPartitions("key").mapInArrow(windows, "a long, b long, s double").filter("a <> b")


def _nearest(pairs: DataFrame, lists: DataFrame | None, longest: int) -> DataFrame:
    """id, k, nb (array of struct s, b, nearest first): the best of pairs (a, b, s), and of the lists.

    k is the length a list may have: ``LIST`` at first, twice as much once all of a list is at or above
    the threshold, up to ``longest``.
    """
    both = pairs.select(F.col("a").alias("id"), F.struct(F.col("s"), F.col("b")).alias("e")).union(pairs.select("b", F.struct("s", F.col("a").alias("b"))))
    if lists is not None:
        both = both.union(lists.select("id", F.explode("nb")))
    both = both.groupBy("id", F.col("e.b").alias("b")).agg(F.max("e.s").alias("s")).select("id", F.struct("s", "b").alias("e"))
    best = Window.partitionBy("id").orderBy(F.desc("e.s"), "e.b")
    top = both.withColumn("r", F.row_number().over(best)).filter(f"r <= {longest}").groupBy("id").agg(F.sort_array(F.collect_list("e"), asc=False).alias("nb"))
    if lists is None:
        top = top.withColumn("k", F.lit(LIST))
    else:
        top = top.join(lists.select("id", "k"), "id", "left").withColumn("k", F.coalesce("k", F.lit(LIST)))
    full = (F.size("nb") >= F.col("k")) & (F.element_at("nb", F.least(F.size("nb"), F.col("k")))["s"] >= COSINE)
    top = top.withColumn("k", F.when(full, F.least(F.col("k") * 2, F.lit(longest))).otherwise(F.col("k")))
    return top.select("id", "k", F.slice("nb", 1, F.col("k")).alias("nb"))


def trees(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a symmetric matrix of links: the upper half of a mask of links that join what all of them join,
    and of each row a row that stands for what it is joined with."""
    out, root = np.zeros(hit.shape, bool), np.arange(len(hit))
    new = hit.any(axis=1)
    while new.any():
        front = [int(np.argmax(new))]
        new[front[0]] = False
        top = front[0]
        while front:
            x = front.pop()
            root[x] = top
            y = np.flatnonzero(hit[x] & new)
            new[y] = False
            out[np.minimum(x, y), np.maximum(x, y)] = True
            front.extend(y.tolist())
    return out, root


def forest(hit: np.ndarray) -> np.ndarray:
    return trees(hit)[0]


def _round(nodes: DataFrame, lists: DataFrame, longest: int, kin: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, s, link) of neighbours of a common vector, of different components, that may enter a
    list of either, or join components (link). Neighbours are those of the lists and of ``kin`` (id, to)."""
    worst = F.when(F.size("nb") < F.col("k"), F.lit(-2.0)).otherwise(F.element_at("nb", -1)["s"])
    sent = lists.select("id", F.explode("nb.b").alias("to"))
    sent = sent if kin is None else sent.union(kin)
    # both directions: a vector goes to those in its list, and to those in whose list it is
    reach = sent.select("to", F.col("id").alias("of")).union(sent.select(F.col("id").alias("to"), F.col("to").alias("of"))).distinct()
    # a vector in very many lists is met in parts of a bounded size, dealt by a hash
    sizes = reach.groupBy("to").agg(F.ceil(F.count(F.lit(1)) / (4 * longest)).alias("parts"))
    reach = reach.join(sizes, "to").withColumn("part", F.pmod(F.xxhash64("of"), F.col("parts")))
    lone = nodes.select(F.col("id").alias("of"), F.col("part").alias("own"), "x")
    worsts = lists.select(F.col("id").alias("of"), worst.alias("worst"))
    met = reach.join(lone, "of").join(worsts, "of", "left").select("to", "part", "of", "x", F.coalesce("worst", F.lit(-2.0)).alias("worst"), "own")
    spark = nodes.sparkSession
    met = met.repartition(width(spark), "to", "part").sortWithinPartitions("to", "part", "of")

    def join(ids: np.ndarray, x: np.ndarray, worst: np.ndarray, own: np.ndarray) -> tuple:
        s = (x @ x.T).astype(np.float64)
        apart = own[:, None] != own[None, :]
        sure, root = trees(apart & (s >= COSINE + SLACK))
        # what halves cannot tell matters only between vectors that nothing sure joins here
        link = sure | np.triu(apart & (np.abs(s - COSINE) < SLACK) & (root[:, None] != root[None, :]), 1)
        i, j = np.nonzero(np.triu(apart & (s >= FLOOR) & (s > np.minimum(worst[:, None], worst[None, :])), 1) | link)
        return ids[i], ids[j], s[i, j], link[i, j]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, edges in runs(batches, 2, "x", np.float16):
            rows = [join(*(c[p:q] for c in now[2:])) for p, q in zip(edges[:-1], edges[1:], strict=True)]
            a, b, s, link = (np.concatenate([r[i] for r in rows]) for i in range(4))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s), pa.array(link)], names=["a", "b", "s", "link"])

    found = met.mapInArrow(local, "a long, b long, s double, link boolean")
    return found.groupBy("a", "b").agg(F.max("s").alias("s"), F.max("link").alias("link"))


def _counts(nodes: DataFrame, parts: DataFrame, dim: int) -> DataFrame:
    """id, links: how many rows each node of a component links with, itself included.

    A component of at most ``BLOCK`` nodes is one exact product. Of larger ones, vectors within half the
    threshold's angle of their component's mean direction, its core, all link with each other and are
    counted by sums. Only vectors outside of it meet their whole component, by exact products of blocks.
    """
    spark = nodes.sparkSession
    of = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n_all"))
    d = parts.join(of, "component").join(nodes, F.col("node") == F.col("id")).select("component", "id", "v", "size", "n_all")
    few = d.filter(F.col("n_all") <= BLOCK).drop("n_all").repartition(width(spark), "component").sortWithinPartitions("component")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, ids, x, size), edges in runs(batches, 1, "v", np.float64):
            links = [(cosines(x[p:q], x[p:q]) >= COSINE) @ size[p:q] for p, q in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[edges[0] : edges[-1]]), pa.array(np.concatenate(links).astype(np.int64))], names=["id", "links"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, at = np.unique(b["component"].to_numpy(), return_inverse=True)
            x = dense(b["v"])
            sums = np.zeros((len(which), dim))
            np.add.at(sums, at, x if len(x) else np.zeros((0, dim)))
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(list(sums), pa.list_(pa.float64()))], names=["component", "s"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, mean = dense(b["v"]), matrix(b["mean"])
            norm = np.sqrt(np.sum(mean * mean, axis=1))
            core = (np.sum(x * mean, axis=1) >= math.cos(math.acos(COSINE) / 2 - 1e-7) * norm) & (norm > 1e-3) if len(x) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([b["component"], b["id"], b["v"], b["size"], pa.array(core)], names=["component", "id", "v", "size", "core"])

    many = d.filter(F.col("n_all") > BLOCK)
    means = many.select("component", "v").mapInArrow(total, "component long, s array<double>")
    means = means.groupBy("component").agg(F.array(*[F.sum(F.col("s")[k]) for k in range(dim)]).alias("mean"))
    means = means.join(of, "component").select("component", F.transform("mean", lambda c: c / F.col("n_all")).alias("mean"))
    m = many.drop("n_all").join(means, "component").mapInArrow(place, "component long, id long, v binary, size long, core boolean")
    blocks = m.groupBy("component").agg(
        F.ceil(F.sum((~F.col("core")).cast("int")) / BLOCK).alias("n_rim"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("n"), F.sum(F.when(F.col("core"), F.col("size")).otherwise(0)).alias("of_core")
    )
    m = m.join(blocks, "component")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    at = lambda i, j, row: F.struct(i.alias("i"), j.alias("j"), F.lit(row).alias("row"))
    as_rim = F.transform(upto("n"), lambda j: at(F.pmod(F.xxhash64("id", F.lit("rim")), F.col("n_rim")), j, True))
    as_member = F.transform(upto("n_rim"), lambda i: at(i, F.pmod(F.xxhash64("id"), F.col("n")), False))
    every = F.when(F.col("core"), as_member).otherwise(F.concat(as_rim, as_member))
    met = m.filter("n_rim > 0").select("component", "id", "v", "size", "core", F.explode(every).alias("at")).select("component", "id", "v", "size", "core", "at.*")

    def product(t: pa.Table) -> pa.Table:
        row, ids, x, size = t["row"].to_numpy(), t["id"].to_numpy(), dense(t["v"]), t["size"].to_numpy()
        core = t["core"].to_numpy()[~row]
        hit = cosines(x[row], x[~row]) >= COSINE
        links = np.concatenate([hit @ size[~row], size[row] @ hit[:, core]])
        return pa.table({"id": pa.array(np.concatenate([ids[row], ids[~row][core]])), "links": pa.array(links.astype(np.int64))})

    outside = met.groupBy("component", "i", "j").applyInArrow(product, "id long, links long")
    large = m.filter("core").select("id", F.col("of_core").alias("links")).unionByName(outside).groupBy("id").agg(F.sum("links").alias("links"))
    return few.select("component", "id", "v", "size").mapInArrow(whole, "id long, links long").unionByName(large)


def _all_pairs(nodes: DataFrame, n: int) -> DataFrame:
    """Links (a, b) that join what all links of ``n`` nodes join, by products of all pairs of blocks."""
    upto, mine = F.sequence(F.lit(0).cast("long"), F.lit(-(-n // BLOCK) - 1).cast("long")), F.pmod(F.xxhash64("id"), F.lit(-(-n // BLOCK)))
    d = nodes.select("id", "v", F.explode(F.transform(upto, lambda o: F.struct(F.least(o, mine).alias("i"), F.greatest(o, mine).alias("j")))).alias("at")).select("id", "v", "at.*")

    def product(t: pa.Table) -> pa.Table:
        ids, x = t["id"].to_numpy(), dense(t["v"])
        hit = cosines(x, x) >= COSINE
        np.fill_diagonal(hit, False)
        a, b = np.nonzero(forest(hit))
        return pa.table({"a": pa.array(ids[a]), "b": pa.array(ids[b])})

    return d.groupBy("i", "j").applyInArrow(product, "a long, b long")


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of unit vectors, each added up in the order of its components, so that no value depends
    on the block that it is computed in."""
    out = np.zeros((len(x), len(y)))
    for k in range(x.shape[1] if len(x) and len(y) else 0):
        out += np.multiply.outer(x[:, k], y[:, k])
    return out


def truth(spark: SparkSession, nodes: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) of vectors a chosen by hash, by brute force over all ``n`` vectors in batches. As many
    are chosen, from ``AUDIT`` to ``AUDIT_MOST``, as it takes to have ``AUDIT_LINKS`` links."""
    most = AUDIT
    while True:
        chosen = nodes.select("id", "v").orderBy(F.xxhash64("id", F.lit("audit"))).limit(most).collect()
        asked = spark.sparkContext.broadcast((np.array([r["id"] for r in chosen]), np.array([np.frombuffer(r["v"]) for r in chosen])))

        def search(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            ids, q = asked.value
            for b in batches:
                x, found = dense(b["v"]), b["id"].to_numpy()
                for k in range(0, len(found), BLOCK):
                    i, j = np.nonzero(q @ x[k : k + BLOCK].T >= COSINE)
                    a, c = ids[i], found[k : k + BLOCK][j]
                    yield pa.RecordBatch.from_arrays([pa.array(a[a != c]), pa.array(c[a != c])], names=["a", "b"])

        true = scratch.table(nodes.select("id", "v").mapInArrow(search, "a long, b long"), "truth")
        if most >= min(n, AUDIT_MOST) or true.count() >= AUDIT_LINKS:
            return true
        most *= 4


def audit(true: DataFrame, parts: DataFrame) -> float:
    """The share of the links (a, b) of ``true`` that are inside of components; the least of it and of
    its mean over vectors a, so that a large group does not speak for lone pairs. 1.0 without links."""
    at = lambda d, k: d.join(parts.select(F.col("node").alias(k), F.col("component").alias(f"{k}_")), k, "left")
    hit = F.coalesce((F.col("a_") == F.col("b_")).cast("int"), F.lit(0))
    each = at(at(true, "a"), "b").groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hit"))
    got = each.agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"), F.avg(F.col("hit") / F.col("n")).alias("mean")).first()
    return min(got["hit"] / got["n"], got["mean"]) if got["n"] else 1.0


def _descend(placed: DataFrame, pairs: DataFrame, kin: DataFrame | None, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The lists that rounds from ``pairs`` end with, and links (a, b) that join what all met pairs join."""
    longest, links = LIST, [pairs.filter(F.col("s") >= COSINE - SLACK).select("a", "b", "s")]
    lists = scratch.table(_nearest(pairs, None, LIST), "lists")
    for _ in range(ROUNDS):
        met = scratch.table(_round(placed, lists, longest, kin), "met")
        longest = min(LONGEST, longest * 2)
        new = scratch.table(_nearest(met.select("a", "b", "s"), lists, longest), "lists")
        links.append(scratch.table(met.filter("link").select("a", "b", "s"), "links"))
        near = lambda d: d.select("id", F.explode("nb").alias("e")).filter(F.col("e.s") >= COSINE - 0.02).select("id", "e.b")
        fresh = near(new).join(near(lists), ["id", "b"], "left_anti").count()
        scratch.drop(lists, met)
        lists = new
        if fresh <= CHANGED * near(new).count():
            break
    found = links[0]
    for more in links[1:]:
        found = found.union(more)
    return lists, scratch.table(_exact(found, placed), "edges")


def near_duplicates(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept, recall of every row of ``vectors`` (vec_id, embedding).

    Two vectors link at a cosine of 0.9 or more, in double precision. Vectors that are null, empty, zero
    or hold null or non-finite components link with nothing, and are components of their own. A row with
    a null vec_id has a null component and kept = null. Vectors of another length than most link with nothing
    (of lengths that are as frequent, the smallest counts). Rows that repeat a vec_id with an equal vector
    are one vector; with different vectors, each is compared and the row's figures are those of its
    vec_id's first vector by the bytes of its doubles. An empty table gives no rows. Other columns, labels among them, are ignored.
    """
    scratch = Scratch(spark, "neighbours")
    rows = only(vectors, vec_id="long", embedding="array<double>").select("vec_id")
    ones = scratch.table(unit_vectors(vectors).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    nodes = scratch.table(with_halves(ones.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("size"))), "nodes")
    first = nodes.groupBy((F.length("v") / 8).cast("int").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    groups, recall = nodes, 1.0
    if first is None:
        parts = spark.createDataFrame([], "node long, component long")
    else:
        dim = first["dim"]
        nodes = nodes.filter(F.length("v") == 8 * dim)
        n = nodes.count()
        true = truth(spark, nodes, n, scratch)
        placed, parts, kin, links = nodes.withColumn("part", F.col("id")), None, None, None
        ahead = math.ceil(projections(n) / SORTS) - 1
        for turn in range(TURNS):
            pairs = scratch.table(_initial(spark, placed, dim, n, turn), "pairs")
            for extra in range(ahead if not turn else 0):  # of the others, only near pairs
                pairs = pairs.union(scratch.table(_initial(spark, placed, dim, n, TURNS + extra, COSINE - 0.1), "pairs"))
            lists, more = _descend(placed, pairs, kin, scratch)
            links = more if links is None else scratch.table(links.union(more), "links")
            joined = more.count()
            parts = connected_components(links, scratch) if joined or parts is None else parts
            recall = audit(true, parts)
            full = F.element_at("nb", -1)["s"] >= COSINE  # what is near may be hidden
            if recall >= RECALL and (not joined if turn else lists.filter((F.size("nb") >= LONGEST) & full).isEmpty()):
                break
            at = lambda k: parts.select(F.col("node").alias(k), F.col("component").alias(f"{k}_"))
            if kin is None:
                near = lists.select("id", F.explode(F.slice("nb", 1, KIN)).alias("e")).filter(F.col("e.s") >= COSINE).select("id", F.col("e.b").alias("to"))
                kin = scratch.table(near.join(at("id"), "id").join(at("to"), "to").filter("id_ = to_").select("id", "to"), "kin")
            placed = scratch.table(nodes.join(at("id"), "id", "left").select("id", "x", "v", F.coalesce("id_", "id").alias("part")), "placed")
        else:
            parts = connected_components(scratch.table(_all_pairs(nodes, n), "pairs"), scratch)
            recall = audit(true, parts)
    counted = _counts(nodes, parts, 0 if first is None else dim)
    mark = lambda d: d.withColumn("one", F.xxhash64("v")).withColumn("two", F.xxhash64("v", F.lit("again")))  # noqa: E731  128 bits for equal vectors
    found = mark(ones).select("vec_id", "one", "two").join(mark(groups).select("one", "two", "id", "size"), ["one", "two"]).select("vec_id", "id", "size")
    found = found.join(parts.withColumnRenamed("node", "id"), "id", "left").join(counted, "id", "left")
    found = found.select("vec_id", (F.coalesce("links", F.col("size")) - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.join(found, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id")).withColumn("recall", F.lit(float(recall)))


def _exact(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (a, b) of pairs (a, b, s) whose cosine in double precision reaches the threshold."""
    one = lambda k: nodes.select(F.col("id").alias(k), F.col("v").alias(f"v_{k}"))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, s = dense(b["v_a"]), dense(b["v_b"]), np.zeros(len(b))
            for k in range(x.shape[1]):
                s += x[:, k] * y[:, k]
            yield b.select(["a", "b"]).filter(pa.array(s >= COSINE))

    e = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("s").alias("s"))
    sure = e.filter(F.col("s") >= COSINE + SLACK).select("a", "b")
    near = e.filter(F.abs(F.col("s") - COSINE) < SLACK).join(one("a"), "a").join(one("b"), "b").select("a", "b", "v_a", "v_b")
    return sure.union(near.mapInArrow(reached, "a long, b long"))
