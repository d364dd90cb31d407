"""Packing documents into token sequences by Karmarkar-Karp multiway differencing.

Each document becomes its BPE ids and an end id. What fills whole windows on its own is cut off
first. The rests, shorter than a window, are collected in groups of ``GROUP`` documents as they come;
a rest above half a window is cut in two, as windows of whole rests would hold one each and padding.
Each group is divided by multiway differencing into windows of near-equal sums. Their count begins at
the group's tokens over the capacity and rises by one whenever a window exceeds the capacity, so
nothing else is cut, and windows end up alike and almost full.

Groups never leave the task that encoded them, so nothing is shuffled and memory is bounded by one
batch and one group, whatever the skew of keys.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from palimpsest.llm import bpe
from palimpsest.llm.common import only

CAPACITY, GROUP, END = 1024, 512, 0
#: A rest above a window's this part is cut.
PIECES = 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _merge(a: tuple, b: tuple, k: int) -> tuple[np.ndarray, list]:
    """Two partial partitions (sums above 0 in ascending order, members) as one: the largest part of the
    one meets the smallest of the other. Where the parts fit side by side, each meets an empty one."""
    (x, s), (y, t) = a, b
    if len(x) + len(y) <= k:
        if len(y) == 1:  # one number: put in its place
            at = int(np.searchsorted(x, y[0], side="right"))
            return np.insert(x, at, y[0]), s[:at] + t + s[at:]
        sums, members = np.concatenate([x, y]), s + t
    else:
        shared = len(x) + len(y) - k
        joined = [(p, q) for p, q in zip(s[:shared], reversed(t[:shared]), strict=True)]
        sums, members = np.concatenate([x[:shared] + y[:shared][::-1], x[shared:], y[shared:]]), joined + s[shared:] + t[shared:]
    order = np.argsort(sums, kind="stable")
    return sums[order], [members[i] for i in order.tolist()]


def multiway_difference(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` (above 0) in ``k`` parts of near-equal sums (largest differencing).

    Every number starts as a partition of itself and k - 1 empty parts; the two partitions with the
    largest spread merge, until one is left. Ties go to the earlier partition, so reruns agree.
    """
    if k <= 1:
        return [list(range(len(sizes)))] * max(0, k)
    heap = [(-s, i, np.array([s], np.int64), [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, *a = heapq.heappop(heap)
        _, _, *b = heapq.heappop(heap)
        a, b = (a, b) if len(a[0]) >= len(b[0]) else (b, a)
        sums, members = _merge(a, b, k)
        least = int(sums[0]) if len(sums) == k else 0
        heapq.heappush(heap, (least - int(sums[-1]), n, sums, members))
        n += 1
    parts: list[list[int]] = []
    for tree in heap[0][3] if heap else []:
        out, stack = [], [tree]
        while stack:
            t = stack.pop()
            if isinstance(t, tuple):
                stack += t
            else:
                out.append(t)
        parts.append(out)
    return parts + [[] for _ in range(k - len(parts))]


def windows_for(sizes: list[int], capacity: int) -> list[list[int]]:
    """Whole items in near-equal windows: the window count rises whenever capacity is exceeded.

    An item above the capacity has no window: ValueError.
    """
    if sizes and max(sizes) > capacity:
        raise ValueError("an item exceeds the capacity")
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = multiway_difference(sizes, k)
        if max((sum(sizes[i] for i in p) for p in parts), default=0) <= capacity:
            return [p for p in parts if p]
        k += 1


def pack_group(sizes: list[int], capacity: int, pieces: int = PIECES) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length) of items of 1 to ``capacity`` tokens. Items above
    ``capacity`` // ``pieces`` are cut into pieces of that size and a smaller one."""
    bound = max(1, capacity // pieces)
    cut = []
    for i, size in enumerate(sizes):
        cut += [(i, a, min(bound, size - a)) for a in range(0, size, bound)]
    windows = windows_for([n for _, _, n in cut], capacity)
    return [[cut[i] for i in sorted(w)] for w in windows]


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, group: int = GROUP, end: int = END) -> DataFrame:
    """One row for each piece of each row of ``docs`` (doc_id, text): see ``SCHEMA``.

    A null text is empty: its document is the end id alone. Repeated rows are packed as often as
    they occur. A null doc_id stays null. An empty table gives no rows. Other columns are ignored.
    """
    vocabulary = vocabulary or bpe.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = (TaskContext.get().partitionId() << 40) - 1
        enc = bpe.encoder(vocabulary)
        rows: list[tuple] = []
        waiting: list[tuple] = []

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        def close() -> None:
            nonlocal sequence
            for pieces in pack_group([len(w[3]) for w in waiting], capacity):
                sequence += 1
                offset = 0
                for i, start, n in pieces:
                    doc, total, base, ids = waiting[i]
                    rows.append((doc, base + start, n, zlib.crc32(ids[start : start + n]), total, sequence, offset))
                    offset += n
            waiting.clear()

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = np.append(enc(text.as_py()), np.uint32(end)).astype("<u4", copy=False)
                total = len(ids)
                cut = total - total % capacity
                for start in range(0, cut, capacity):
                    sequence += 1
                    rows.append((doc, start, capacity, zlib.crc32(ids[start : start + capacity]), total, sequence, 0))
                if cut < total:
                    waiting.append((doc, total, cut, ids[cut:].copy()))
                    if len(waiting) == group:
                        close()
                if len(rows) >= 20_000:
                    yield flush()
        close()
        if rows:
            yield flush()

    return only(docs, doc_id="long", text="string").mapInArrow(run, SCHEMA)
