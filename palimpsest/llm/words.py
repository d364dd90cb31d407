"""Words and word shingles of whole texts, a column of texts at a time."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_32, _29 = np.uint64(32), np.uint64(29)
TEXT_BYTES = 2_000_000


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random; another one for each seed."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _32)) * _MIX
    x = (x ^ (x >> _32)) * _MIX
    return x ^ (x >> _32)


def give_back() -> None:
    """Returns freed memory to the system: workers outlive their tasks and share a budget."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``TEXT_BYTES``, so that long texts don't multiply memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    part = np.cumsum(sizes) // TEXT_BYTES
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
        # copied: ascii_lower of pyarrow reads past the values of a slice that does not begin at 0
        yield batch if b - a == len(sizes) else batch.take(pa.array(range(a, b)))
    give_back()


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets for each text, and all its words: A-Z lower-cased, cut at ``[\\x20\\x09-\\x0D]+``.

    A null text has no words, like an empty one.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pc.ascii_lower(pc.ascii_trim_whitespace(texts))
    parts = pc.ascii_split_whitespace(texts)
    offsets, flat = parts.offsets.to_numpy(), parts.flatten()
    base = offsets[0]
    offsets = offsets - base
    if pc.any(pc.equal(texts, "")).as_py():  # the split of an empty text is one empty word
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    return offsets, flat


def word_hashes(flat: pa.Array) -> np.ndarray:
    coded = flat.dictionary_encode()
    hashes = pd.util.hash_array(np.asarray(coded.dictionary.to_pandas(), dtype=object), categorize=False)
    return hashes.astype(np.uint64)[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``width``-word shingles; of a text
    with fewer words, the one of its whole sequence; of a text without words, none."""
    offsets, flat = words(texts)
    h = word_hashes(flat)
    n = len(h)
    rolled = h[: max(0, n - width + 1)].copy()
    for k in range(1, width):
        rolled = (rolled * _ODD) ^ (rolled >> _29)
        rolled += h[k : n - width + 1 + k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            x = np.uint64(b - a)
            for w in h[a:b]:
                x = mix(np.array([x]) ^ w, 7)[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
