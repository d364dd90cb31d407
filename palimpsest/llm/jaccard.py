"""Similarity join of word-shingle sets by multiple global orders.

Two sets of Jaccard similarity t share more than a share t of the larger one, so under any order of
all tokens they share one of the first n - ceil(t n) + 1 tokens of either. Candidates must do so under
several orders at once. Each order puts tokens by how frequent they are, rare ones first, as a sketch of
all counts tells, and differs from the others in how fine it tells frequencies apart and in how it
breaks ties.

Steps, each over whole tables:

1. Sets of all documents; equal sets are one class. A document can only have a partner if enough of its
   first quarter of tokens, in one hashed order, occur in another set. Tokens and documents travel as
   packed arrays, one entry a token and batch, so that a token of very many documents stays small.
2. For what is left: the sketch, the orders, and posting lists of the first order's prefixes.
3. Stars: the smallest set of each posting list against the others of the list; components of the links.
4. Only pairs between components are still open. Lists with several components are grouped by the
   component of their smallest set; its outliers are compared with everything of the group, in blocks.

Only links that join components are kept, which loses no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch, maybe_in, not_in, only, prepared, small, width
from palimpsest.llm.graph import connected_components
from palimpsest.llm.words import give_back, mix, shingle_sets, slices

SHINGLE, PERCENT = 5, 80
#: Of each order, how many quarters of a logarithm of a frequency count as equal.
ORDERS = {1: 1, 2: 6, 3: 24}
SKETCH_BITS, SLICES = 20, 64
#: Tokens of the outliers and of the members of a block, on average, and matches looked at together.
OUTLIERS, MEMBERS, MATCHES = 400_000, 800_000, 500_000


def allowance(n, percent: int = PERCENT):
    """How many of a set's ``n`` tokens a linked set may lack."""
    return n * (100 - percent) // 100


def first_tokens(n):
    """How many of a set's ``n`` tokens the first pass looks at, in the hashed order."""
    return np.minimum(n, n // 4 + 2)


def needed(n, percent: int = PERCENT):
    """How many of the first tokens of a set of ``n`` are among those of any set that it links with.

    The first tokens of A hold the first ``first_tokens(|A|) - |A - B|`` common ones at least, those of B
    the first ``first_tokens(|B|) - |B - A|``. The one is least if B is the smallest subset of A that
    links, the other if B is the largest superset; 0 or less asks for nothing.
    """
    more = n * (100 - percent) // percent
    return np.minimum(first_tokens(n) - allowance(n, percent), first_tokens(n + more) - more)


def linked(both, a, b, percent: int = PERCENT):
    return 100 * both >= percent * (a + b - both)


def _class(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def _scan(docs: DataFrame, shingle: int, percent: int, buckets: int) -> DataFrame:
    """Of each batch: one row with its documents, and a row a bucket with the tokens it saw.

    Tokens that several classes of the batch have are counted here and travel once, without document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                sets = shingle_sets(b.column("text"), shingle)
                ids = b.column("doc_id").to_numpy(zero_copy_only=False)
                sizes = np.array([len(s) for s in sets], np.int64)
                classes = np.array([_class(s) for s in sets], np.int64)
                _, first = np.unique(classes, return_index=True)
                first = first[sizes[first] > 0]
                take = first_tokens(sizes)
                tokens = [np.zeros(0, np.uint64)]
                for i in first.tolist():
                    h = mix(sets[i], 99)
                    tokens.append(sets[i][np.argpartition(h, take[i] - 1)[: take[i]]])
                owner, token = np.repeat(first, take[first]), np.concatenate(tokens)
                order = np.argsort(token)
                token, owner = token[order], owner[order]
                new = np.ones(len(token), bool)
                new[1:] = token[1:] != token[:-1]
                count = np.bincount(np.cumsum(new) - 1) if len(token) else np.zeros(0, int)
                shared = np.repeat(count > 1, count)
                here = np.bincount(owner[shared], minlength=len(sets))
                same = dict(zip(classes[first].tolist(), here[first].tolist(), strict=True))
                keep = new  # one entry a token: shared ones without document
                doc = np.where(shared, np.iinfo(np.int64).min, ids[owner])[keep]
                token = token[keep]
                at = (token % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                at, token, doc = at[order], token[order], doc[order]
                cuts = np.flatnonzero(np.diff(at, prepend=-1)).tolist() + [len(at)]
                rows = [(int(at[x]), token[x:y].tobytes(), doc[x:y].tobytes(), None) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                meta = np.stack([ids, sizes, classes, needed(sizes, percent), [same.get(c, 0) for c in classes.tolist()]]).astype(np.int64)
                rows.append((int(abs(classes[0]) % buckets), None, None, meta.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 3), strict=True)], names=["bucket", "tokens", "docs", "meta"])

    return docs.mapInArrow(run, "bucket int, tokens binary, docs binary, meta binary")


def _count(scanned: DataFrame) -> DataFrame:
    """Rows of documents (doc_id, n, class, need, shared) and of tokens that they share with other
    batches (doc_id, shared)."""

    def reduce(t: pa.Table) -> pa.Table:
        tokens = np.concatenate([np.frombuffer(x, np.uint64) for x in t["tokens"].to_pylist() if x] or [np.zeros(0, np.uint64)])
        docs = np.concatenate([np.frombuffer(x, np.int64) for x in t["docs"].to_pylist() if x] or [np.zeros(0, np.int64)])
        order = np.argsort(tokens)
        tokens, docs = tokens[order], docs[order]
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        run = np.cumsum(new) - 1
        hit = (np.bincount(run)[run] > 1 if len(run) else np.zeros(0, bool)) & (docs != np.iinfo(np.int64).min)
        doc, n = np.unique(docs[hit], return_counts=True)
        metas = [np.frombuffer(x, np.int64).reshape(5, -1) for x in t["meta"].to_pylist() if x]
        meta = np.concatenate(metas, axis=1) if metas else np.zeros((5, 0), np.int64)
        give_back()
        none = pa.nulls(len(doc), pa.int64())
        cols = [pa.chunked_array([pa.array(meta[i]), none]) for i in (1, 2, 3)]
        return pa.table([pa.array(np.concatenate([meta[0], doc])), *cols, pa.array(np.concatenate([meta[4], n]))], names=["doc_id", "n", "class", "need", "shared"])

    return scanned.groupBy("bucket").applyInArrow(reduce, "doc_id long, n long, class long, need long, shared long")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, class, n, tokens (sorted, packed) of documents that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                got = [(i, _class(s), len(s), s.tobytes()) for i, s in zip(b.column("doc_id").to_pylist(), shingle_sets(b.column("text"), shingle), strict=True) if len(s)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)], names=["doc_id", "class", "n", "tokens"])

    return docs.mapInArrow(run, "doc_id long, class long, n long, tokens binary")


def _one_each(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """One row of each class. Sets travel only where a document repeats with an equal text."""
    names = sets.select("class", "doc_id")
    twice = names.groupBy("class").agg(F.min("doc_id").alias("keep"), F.max("doc_id").alias("other"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    twice = scratch.table(twice, "twice")
    if twice.isEmpty():
        return sets
    gone = names.join(twice, "class").filter("doc_id <> keep").select("class", "doc_id").distinct()
    sets = sets.join(scratch.table(gone, "gone"), ["class", "doc_id"], "left_anti")
    if twice.join(names.groupBy("class", "doc_id").count().filter("count > 1"), "class").isEmpty():
        return sets
    return sets.groupBy("class").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))


def _sketch(spark: SparkSession, sets: DataFrame, bits: int) -> np.ndarray:
    """How frequent the tokens of each of 2**bits hash cells are, as a logarithm in quarters.

    Counts cover all sets. The result has one byte a cell, so its size does not depend on the data.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, np.int64)
        for b in batches:
            for x in b.column("tokens"):
                np.add.at(cells, (np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(64 - bits)).astype(np.int64), 1)
        parts = np.minimum(cells, 65535).astype("<u2").reshape(SLICES, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts])], names=["part", "cells"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros((1 << bits) // SLICES, np.int64)
        for x in t["cells"]:
            total += np.frombuffer(x.as_buffer(), "<u2")
        return pa.table({"part": t["part"].slice(0, 1), "cells": pa.array([np.floor(4 * np.log2(np.maximum(total, 1))).astype(np.uint8).tobytes()])})

    parts = sets.select("tokens").mapInArrow(count, "part int, cells binary").groupBy("part").applyInArrow(add, "part int, cells binary").collect()
    out = np.zeros((SLICES, (1 << bits) // SLICES), np.uint8)
    for r in parts:
        out[r["part"]] = np.frombuffer(r["cells"], np.uint8)
    return out.ravel()


def prefix(tokens: np.ndarray, cells: np.ndarray, order: int, percent: int = PERCENT) -> np.ndarray:
    """The tokens of a set of which a linked set has one, under one of the global orders."""
    k = allowance(len(tokens), percent) + 1
    if k >= len(tokens):
        return tokens
    bits = len(cells).bit_length() - 1
    often = (cells[(tokens >> np.uint64(64 - bits)).astype(np.int64)] // ORDERS[order]).astype(np.uint64)
    key = often << np.uint64(56) | mix(tokens, order) >> np.uint64(8)
    return tokens[np.argpartition(key, k - 1)[:k]]


def _postings(sets: DataFrame, cells, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [prefix(np.frombuffer(x.as_buffer(), np.uint64), cells.value, min(ORDERS), percent) for x in b.column("tokens")]
            k = [len(f) for f in found]
            token = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(b.column("class").to_numpy(), k)), pa.array(np.repeat(b.column("n").to_numpy(), k))], names=["token", "class", "n"])

    return sets.mapInArrow(run, "token long, class long, n long")


class _Index:
    """Which of some sets have a token."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        token = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(token, kind="stable")
        self.token, self.owner = token[order], owner[order]

    def count(self, s: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.token, s, "left"), np.searchsorted(self.token, s, "right")
        n = high - low
        ends = np.cumsum(n)
        out = np.zeros(self.n, np.int64)
        cuts = np.searchsorted(ends, np.arange(MATCHES, ends[-1], MATCHES)).tolist() if len(ends) and ends[-1] > MATCHES else []
        for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True):
            m, stops = n[a:b], np.cumsum(n[a:b])
            at = np.repeat(low[a:b] - (stops - m), m) + np.arange(stops[-1] if len(stops) else 0)
            out += np.bincount(self.owner[at], minlength=self.n)
        return out


def compare_block(outliers: list[tuple[int, np.ndarray]], members: list[tuple[int, np.ndarray]], cells: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (a, b) that join the outliers with the members of a block and each other.

    A pair is verified only if it shares a prefix token under each order. Pairs that earlier links
    of the block join already are left out.
    """
    names = [c for c, _ in members]
    sets = [s for _, s in members]
    sizes = np.array([len(s) for s in sets], np.int64)
    filters = [(o, _Index([prefix(s, cells, o, percent) for s in sets])) for o in ORDERS]
    whole = _Index(sets)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for name, s in outliers:
        low, high = percent * len(s) <= 100 * sizes, percent * sizes <= 100 * len(s)
        maybe = low & high
        for o, index in filters:
            if not maybe.any():
                break
            maybe &= index.count(prefix(s, cells, o, percent)) > 0
        if not maybe.any():
            continue
        for j in np.flatnonzero(maybe & linked(whole.count(s), len(s), sizes, percent)).tolist():
            a, b = find(name), find(names[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((name, names[j]))
    return out


def _compare(groups: DataFrame, sets: DataFrame, cells, percent: int, scratch: Scratch) -> DataFrame:
    """Links between the outliers of groups (g, class, n, outlier) and everything of the same group.

    Outliers and members are cut into blocks by hash, and every pair of blocks is a task's group.
    """
    sizes = groups.groupBy("g").agg(F.ceil(F.sum(F.when(F.col("outlier"), F.col("n")).otherwise(0)) / OUTLIERS).alias("n_out"), F.ceil(F.sum("n") / MEMBERS).alias("n_in"))
    d = groups.drop("n").join(sizes, "g")
    block_in, block_out = F.pmod(F.xxhash64("class", F.lit(1)), F.col("n_in")), F.pmod(F.xxhash64("class", F.lit(2)), F.col("n_out"))
    place = lambda o, i, out, member: F.struct(o.alias("o"), i.alias("i"), out.alias("out"), member.alias("member"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    as_member = F.transform(upto("n_out"), lambda o: place(o, block_in, F.col("outlier") & (o == block_out), F.lit(True)))
    as_outlier = F.transform(F.filter(upto("n_in"), lambda i: i != block_in), lambda i: place(block_out, i, F.lit(True), F.lit(False)))
    every = F.when(F.col("outlier"), F.concat(as_member, as_outlier)).otherwise(as_member)
    d = d.filter("n_out > 0").select("g", "class", F.explode(every).alias("at")).select("g", "class", "at.*")
    d = small(scratch.table(d, "placed")).join(maybe_in(sets.select("class", "tokens"), "class", groups, scratch), "class")

    def run(t: pa.Table) -> pa.Table:
        out, members = [], []
        for name, is_out, is_member, tokens in zip(*(t[c].to_pylist() for c in ("class", "out", "member", "tokens")), strict=True):
            one = (name, np.frombuffer(tokens, np.uint64))
            out += [one] * is_out
            members += [one] * is_member
        found = compare_block(sorted(out, key=lambda x: x[0]), sorted(members, key=lambda x: x[0]), cells.value, percent)
        if sum(len(s) for _, s in members) > MEMBERS // 4:
            give_back()
        return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return d.groupBy("g", "o", "i").applyInArrow(run, "a long, b long")


def _members(postings: DataFrame, scratch: Scratch) -> DataFrame:
    """list, class, n, hub, hub_n: the members of posting lists of two or more, and the smallest of each.

    Tokens with the same members are one list, told by two xors of hashes of the members: copies share
    most of their tokens.
    """
    marks = [F.bit_xor(F.xxhash64("class", F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)]
    lists = postings.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("n", "class")).alias("first"), *marks).filter("k > 1")
    lists = lists.groupBy("k", "first", "x1", "x2").agg(F.min("token").alias("token"))
    lists = scratch.table(lists.select("token", F.col("first.class").alias("hub"), F.col("first.n").alias("hub_n")), "lists")
    found = maybe_in(postings, "token", lists, scratch).join(lists, "token")
    return scratch.table(found.select(F.col("token").alias("list"), "class", "n", "hub", "hub_n"), "members")


def _open_groups(members: DataFrame, parts: DataFrame, scratch: Scratch) -> DataFrame:
    """g, class, n, outlier: what is still to be compared once the components ``parts`` are known.

    The stars settled every pair of a list with its hub. A list is open only if its other members are
    in several components. Components that such lists bring together form one group, in which all but the
    largest component are outliers; every class is in one group. Where that would be larger than a
    block, lists are grouped by their smallest component instead, and its outliers are those outside.
    """
    other = members.filter("class <> hub").select("list", "class", "n")
    placed = other.join(small(parts).withColumnRenamed("node", "class"), "class", "left").select("list", "class", "n", F.coalesce("component", "class").alias("part"))
    placed = scratch.table(placed, "placed")
    split = placed.groupBy("list").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("list", "low")
    placed = scratch.table(placed.join(split, "list").select("low", "part", "class", "n").distinct(), "split")
    together = connected_components(placed.select(F.col("low").alias("a"), F.col("part").alias("b")).distinct(), scratch)
    one = placed.select("part", "class", "n").distinct().join(small(together).withColumnRenamed("node", "part"), "part")
    sizes = one.groupBy("component", "part").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("tokens"))
    sizes = scratch.table(sizes.groupBy("component").agg(F.max(F.struct("k", "part")).getField("part").alias("largest"), F.sum("tokens").alias("tokens")), "sizes")
    whole = one.join(sizes.filter(F.col("tokens") <= MEMBERS), "component").select(F.col("component").alias("g"), "class", "n", (F.col("part") != F.col("largest")).alias("outlier"))
    large = sizes.filter(F.col("tokens") > MEMBERS).select("component").join(together, "component").select(F.col("node").alias("part"))
    large = placed.join(large, "part").select(F.col("low").alias("g"), "class", "n", (F.col("part") != F.col("low")).alias("outlier")).distinct()
    # a group of either kind may bear the same number; the kinds must not mix
    return scratch.table(whole.withColumn("kind", F.lit(0)).unionByName(large.withColumn("kind", F.lit(1))).withColumn("g", F.xxhash64("g", "kind")).drop("kind"), "groups")


def jaccard_components(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Two documents link when 100 * |A & B| >= percent * |A | B| over their sets of ``shingle``-word
    shingles; component_id is the smallest doc_id reachable. A null or empty text, or one without
    words, has no shingles and no links: its component is itself. Rows with a null doc_id get
    n_shingles and a null component_id, and link with nothing. Repeated rows are as many rows; a doc_id
    with several texts is in the component of each, and each row has the one of its text. An empty
    table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(spark, "jaccard")
    docs = only(docs, doc_id="long", text="string")
    known = docs.filter("doc_id is not null")
    counted = scratch.table(_count(_scan(known, shingle, percent, 8 * width(spark))), "counted")
    meta = counted.filter("n is not null")
    enough = counted.groupBy("doc_id").agg(F.sum("shared").alias("shared"), F.min("need").alias("need")).filter("shared >= need").select("doc_id")
    wanted = meta.filter("n > 0").join(enough, "doc_id").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    wanted = scratch.table(wanted, "wanted")
    sets = scratch.table(_sets(maybe_in(known, "doc_id", wanted, scratch), shingle), "sets")
    sets = _one_each(sets, scratch).select("class", "n", "tokens")
    cells = spark.sparkContext.broadcast(_sketch(spark, sets, SKETCH_BITS))
    postings = scratch.table(_postings(sets, cells, percent), "postings")
    members = _members(postings, scratch)
    stars = members.filter(f"class <> hub and 100 * hub_n >= {percent} * n").select(F.col("hub").alias("g"), "class", "n", "hub_n").distinct()
    stars = scratch.table(stars.drop("hub_n").withColumn("outlier", F.lit(False)).union(stars.select("g", F.col("g").alias("class"), "hub_n", F.lit(True)).distinct()), "stars")
    links = scratch.table(_compare(stars, sets, cells, percent, scratch), "links")
    groups = _open_groups(members, connected_components(links, scratch), scratch)
    more = scratch.table(_compare(groups, sets, cells, percent, scratch), "more")
    parts = connected_components(links.union(more), scratch)
    classes = meta.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    classes = classes.join(small(parts).withColumnRenamed("node", "class"), "class", "left").select("class", "low", "high", F.coalesce("component", "class").alias("root"))
    least = classes.groupBy("root").agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least <> most").select("root", "least")
    found = classes.join(least, "root").select("class", "least")
    out = meta.join(found, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("least")), F.col("doc_id")).alias("component_id"))
    return out.unionByName(_nameless(docs, shingle))


def _nameless(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                n = [len(s) for s in shingle_sets(b.column("text"), shingle)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int64())], names=["doc_id", "n_shingles", "component_id"])

    return docs.filter("doc_id is null").mapInArrow(run, "doc_id long, n_shingles long, component_id long")


#: Numbers from here on stand for rows that their doc_id does not tell apart.
STAND_IN = 1 << 62


def _keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """key, text, row (all columns): rows equal in doc_id and text once. The key is the doc_id, or where
    that is null or has several rows, a number from ``STAND_IN`` on by hash of doc_id and text."""
    prepared(scratch.spark)
    d = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    odd = scratch.table(d.groupBy("key").count().filter("count > 1 or key is null").select("key"), "odd")
    if odd.isEmpty():
        return d
    named = d.filter("key is not null")
    several = named.join(small(odd), "key", "left_semi").unionByName(d.filter("key is null"))
    stand_in = F.xxhash64(F.coalesce("key", F.lit(0)), F.col("key").isNull(), "text").bitwiseAND(F.lit(STAND_IN - 1)) + F.lit(STAND_IN)
    several = several.withColumn("key", stand_in).groupBy("key").agg(F.first("text").alias("text"), F.first("row").alias("row"))
    return not_in(named, "key", odd.filter("key is not null"), scratch).unionByName(scratch.table(several, "several"), allowMissingColumns=False)


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: the one of the smallest doc_id.

    Rows equal in doc_id and text are one row. Rows with a null doc_id, or with a doc_id that other texts
    have too, take part like others, and stay only where their component has no row with a doc_id of its
    own. Null and empty texts and those without words link with nothing and stay. An empty table gives no rows.
    """
    scratch = Scratch(spark, "keep")
    keyed = _keyed(docs, scratch)
    found = jaccard_components(spark, keyed.select(F.col("key").alias("doc_id"), "text"), shingle, percent)
    gone = scratch.table(found.filter("component_id <> doc_id").select(F.col("doc_id").alias("key")).distinct(), "gone")
    return not_in(keyed, "key", gone, scratch).select("row.*")
