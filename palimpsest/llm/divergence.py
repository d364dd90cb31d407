"""Source divergence audit: how the terms of a source differ from those of the other sources of its language.

Terms are counted in tasks by length-bucketed packing: terms of up to 8 bytes are one 64-bit word
each and those of up to 16 bytes two, radix-sorted and counted by runs; longer ones lie in
byte-sorted buckets of their own, by length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch, only
from palimpsest.llm.words import give_back

#: Bytes of text that are packed and sorted at once. A longer text is cut between terms.
CHUNK = 4_000_000

_BYTES = np.arange(256, dtype=np.uint8)
_CAPITAL = (_BYTES >= 65) & (_BYTES <= 90)
IN_TERM = _CAPITAL | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
LOWER = np.where(_CAPITAL, _BYTES + 32, _BYTES).astype(np.uint8)


def radix_order(*words: np.ndarray) -> np.ndarray:
    """The stable order of rows by their unsigned words, the first the most significant: least digits of 16 bits first.
    Digits that all rows share are passed over."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in range(0, word.dtype.itemsize * 8, 16):
            digit = (word >> word.dtype.type(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]  # of 16 bits: numpy's radix sort
    return order


def _runs(changes: list[np.ndarray], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs of sorted rows begin, how long they are, and how many documents each has."""
    n = len(docs)
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce(changes)
    starts = np.flatnonzero(new)
    first = new.copy()
    first[1:] |= docs[1:] != docs[:-1]
    return starts, np.diff(np.append(starts, n)), np.add.reduceat(first.astype(np.int64), starts) if n else np.zeros(0, np.int64)


def term_runs(data: np.ndarray, groups: np.ndarray, docs: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """Runs of equal (group, term) of texts that lie one behind the other in ``data``, a bucket of lengths at a time:
    groups, terms, occurrences, documents. ``groups``, ``docs`` (ascending) and ``ends`` are of each text."""
    inside = IN_TERM[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return
    of = np.searchsorted(ends, starts, side="right")
    groups, docs = groups[of].astype(np.uint32), docs[of]
    data = np.concatenate([LOWER[data], np.zeros(16, np.uint8)])
    for most, width in ((8, 1), (16, 2)):
        picked = np.flatnonzero((lengths <= most) & (lengths > most - 8))
        if len(picked):
            at, size = starts[picked], lengths[picked]
            words = [np.zeros(len(picked), np.uint64) for _ in range(width)]
            for k in range(most):  # no term holds a zero byte, so what follows a term can be zero
                words[k // 8] |= np.where(k < size, data[at + k], 0).astype(np.uint64) << np.uint64(56 - 8 * (k % 8))
            order = radix_order(groups[picked], *words)
            g, d, words = groups[picked][order], docs[picked][order], [w[order] for w in words]
            first, n, n_docs = _runs([g[1:] != g[:-1], *[w[1:] != w[:-1] for w in words]], d)
            packed = np.stack([w[first] for w in words], axis=1).astype(">u8").tobytes()
            yield g[first], np.frombuffer(packed, f"S{most}").tolist(), n, n_docs
    most = 16
    while most < lengths.max():
        picked = np.flatnonzero((lengths > most) & (lengths <= 2 * most))
        most *= 2
        if len(picked):  # rows of at most twice the bytes of their terms
            at, size = starts[picked], lengths[picked]
            rows = np.zeros((len(picked), most), np.uint8)
            for k in range(len(picked)) if most > 512 else ():
                rows[k, : size[k]] = data[at[k] : at[k] + size[k]]
            for k in range(most) if most <= 512 else ():
                rows[:, k] = np.where(k < size, data[np.minimum(at + k, len(data) - 1)], 0)
            rows = rows.view(f"S{most}").ravel()
            order = np.argsort(rows, kind="stable")
            order = order[np.argsort(groups[picked][order], kind="stable")]
            g, d, rows = groups[picked][order], docs[picked][order], rows[order]
            first, n, n_docs = _runs([g[1:] != g[:-1], rows[1:] != rows[:-1]], d)
            yield g[first], rows[first].tolist(), n, n_docs


def _chunks(text: np.ndarray) -> Iterator[np.ndarray]:
    """A text in parts of about ``CHUNK`` bytes, cut where no term is."""
    at = 0
    while len(text) - at > CHUNK:
        gaps = np.flatnonzero(~IN_TERM[text[at + CHUNK :]])
        stop = at + CHUNK + int(gaps[0]) if len(gaps) else len(text)
        yield text[at:stop]
        at = stop
    yield text[at:]


def _long_text(text: np.ndarray, group: int) -> tuple[list[int], list[bytes], list[int], list[int]]:
    """The runs of one text that is longer than a chunk: each of its terms is of one document."""
    total: dict[bytes, int] = {}
    zero = np.zeros(1, np.int64)
    for part in _chunks(text):
        for _, terms, n, _ in term_runs(part, zero, zero, np.array([len(part)])):
            for term, k in zip(terms, n.tolist(), strict=True):
                total[term] = total.get(term, 0) + k
    return [group] * len(total), list(total), list(total.values()), [1] * len(total)


_COUNTS = "lang string, source string, term string, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _COUNTS.split(", ")]
    for b in batches:
        pairs: dict[tuple[str, str], int] = {}
        codes = np.array([pairs.setdefault(k, len(pairs)) for k in zip(b["lang"].to_pylist(), b["source"].to_pylist(), strict=True)], np.int64)
        langs, sources = (pa.array([k[i] for k in pairs], pa.string()) for i in (0, 1))

        def told(groups: np.ndarray | list[int], terms: list[bytes] | None, n: np.ndarray | list[int], docs: np.ndarray | list[int]) -> pa.RecordBatch:
            at = pa.array(groups, pa.int64())
            term = pa.nulls(len(at), pa.string()) if terms is None else pa.array(terms, pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([langs.take(at), sources.take(at), term, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=names)

        none = np.zeros(len(pairs), np.int64)
        yield told(np.arange(len(pairs)), None, none, none)  # groups occur without terms too
        texts = b["text"].cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
            if offsets[last] - offsets[first] > CHUNK:
                yield told(*_long_text(data[offsets[first] : offsets[last]], int(codes[first])))
            else:
                # a separator behind each text, so that no term runs on into the next
                sizes = np.diff(offsets[first : last + 1])
                apart = np.insert(data[offsets[first] : offsets[last]], np.cumsum(sizes), 32)
                ends = np.cumsum(sizes + 1)
                for runs in term_runs(apart, codes[first:last], np.arange(first, last), ends):
                    yield told(*runs)
            first = last
        give_back()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences of every term and its rows in every group, and a row
    with a null term for every group. A term that all rows share moves as one row a task and group."""
    texts = only(docs, text="string", lang="string", source="string").fillna("")
    return texts.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


#: Documents of a language that a kept term is in; the unit of shares; ranks of terms that are told.
LEAST, UNIT, RANKS = 3, 1_000_000_000, 200


def share(n: str, total: str) -> Column:
    """``1 + floor(UNIT * (n + 1) / total)`` of whole columns, exactly; null if there is nothing to share."""
    return F.expr(f"1 + CAST({UNIT} AS DECIMAL(10, 0)) * CAST({n} + 1 AS DECIMAL(19, 0)) div nullif(CAST({total} AS DECIMAL(20, 0)), 0)")


def distance(p: Column, q: Column) -> Column:
    """``floor((p - q) ** 2 / q)``. The square of shares, and its sum over the terms of a group, is below 2 ** 62."""
    return F.call_function("div", (p - q) * (p - q), q)


#: Pairs of sources that a task holds at once.
PAIRS = 500_000


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms that both sources of a pair have add to the sums that take each as absent from the other."""
    f = lambda p, q: (p - q) ** 2 // q
    for b in batches:
        items = b["items"]
        flat, size = items.flatten(), np.diff(items.offsets.to_numpy())
        p, absent = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("p", "absent"))
        langs, sources = b["lang"].dictionary_encode(), flat.field("source").dictionary_encode()
        n_sources = len(sources.dictionary)
        code = np.repeat(langs.indices.to_numpy().astype(np.int64), size) * n_sources + sources.indices.to_numpy()
        partners, start = np.repeat(size, size), np.repeat(np.cumsum(size) - size, size)
        # every item meets the others of its term; as many items at once as have PAIRS partners
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(partners) // PAIRS)) + 1).tolist(), len(partners)]
        sums: dict[tuple[int, int], int] = {}
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            k = partners[a:z]
            i = np.repeat(np.arange(a, z), k)
            j = np.repeat(start[a:z], k) + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
            other = i != j
            i, j = i[other], j[other]
            value = f(p[i], p[j]) - f(p[i], absent[j]) - f(absent[i], p[j]) + f(absent[i], absent[j])
            order = radix_order(code[i].astype(np.uint64), code[j].astype(np.uint64))
            i, j, value = i[order], j[order], value[order]
            first, _, _ = _runs([code[i][1:] != code[i][:-1], code[j][1:] != code[j][:-1]], np.zeros(len(i), np.int64)) if len(i) else (np.zeros(0, np.int64),) * 3
            for x, y, v in zip(code[i[first]].tolist(), code[j[first]].tolist(), np.add.reduceat(value, first).tolist() if len(first) else [], strict=True):
                sums[x, y] = sums.get((x, y), 0) + v
        left, right = (np.array([k[side] for k in sums], np.int64) for side in (0, 1))
        of = lambda codes: sources.dictionary.take(pa.array(codes % max(n_sources, 1)))
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(left // max(n_sources, 1))), of(left), of(right), pa.array(list(sums.values()), pa.int64())], names=["lang", "source", "item", "value"])


def _pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value: the distance summed over all kept terms.

    A sum has three parts, none of which meets a source with a term that it lacks: terms of one of the
    two, by how often they occur, taken as absent from the other; terms of neither, by number; and a
    correction for terms of both.
    """
    other = groups.select("lang", F.col("source").alias("item"), F.col("absent").alias("absent_"), F.col("n_terms").alias("n_terms_"))
    pairs = groups.join(other, "lang").filter("source <> item")
    neither = pairs.select("lang", "source", "item", ((F.col("kept") - F.col("n_terms") - F.col("n_terms_")) * distance(F.col("absent"), F.col("absent_"))).alias("value"))
    one = terms.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k")).join(other, "lang").filter("source <> item")
    ways = F.inline(F.array(*[F.struct(a.alias("s"), b.alias("i"), (F.col("k") * v).alias("value")) for a, b, v in (
        (F.col("source"), F.col("item"), distance(F.col("p"), F.col("absent_"))), (F.col("item"), F.col("source"), distance(F.col("absent_"), F.col("p"))))]))
    one = one.select("lang", ways).select("lang", F.col("s").alias("source"), F.col("i").alias("item"), "value")
    met = terms.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "absent")).alias("items")).filter("size(items) > 1")
    both = met.select("lang", "items").mapInArrow(_both, "lang string, source string, item string, value long")
    sums = [t.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) for t in (neither, one, both)]
    return sums[0].unionByName(sums[1]).unionByName(sums[2]).groupBy("lang", "source", "item").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))


def divergence(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """For every (lang, source) of ``docs`` its distance from every other source of the language (part
    ``pair``), and the terms that it has more of than the language (``term``): item, value, rank.

    Null texts, languages and sources are ''. Groups without terms, and languages without kept terms,
    count: the former have every term as absent, pairs of the latter have the value 0. Each row is a
    document, also if it repeats. Ties go by the item's bytes. An empty table gives no rows; columns
    of other names are ignored.

    One task holds what one term, or one group, has for each source, and no more; the result has a
    row for each pair of sources anyway.
    """
    scratch = Scratch(spark, "divergence")
    counts = scratch.table(term_counts(docs), "counts")
    of_term = Window.partitionBy("lang", "term")
    terms = counts.filter("term IS NOT NULL").withColumn("total", F.sum("n").over(of_term)).withColumn("of", F.sum("docs").over(of_term)).filter(F.col("of") >= LEAST)
    terms = scratch.table(terms.select("lang", "source", "term", "n", "total"), "terms")
    sums = terms.groupBy("lang", "source").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("n_terms"))
    langs = terms.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("of_lang"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    groups = scratch.table(groups.withColumn("absent", share("0", "occurrences + kept")), "groups")
    terms = terms.join(groups, ["lang", "source"]).withColumn("p", share("n", "occurrences + kept")).withColumn("q", share("total", "of_lang + kept"))
    more = terms.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    pairs = _pairs(terms, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    ranked = lambda t: t.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked(pairs).unionByName(ranked(more).filter(F.col("rank") <= RANKS))
