"""Vectorised word kernels over Arrow string buffers.

Texts arrive as Arrow arrays; everything here works on their UTF-8 bytes with
numpy, so no Python object is made per word.  Bytes of 0x80 and above only occur
inside non-ASCII code points, hence a class of ASCII characters can be tested
byte by byte.  A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds the temporaries of one step (a single longer text is one step).
CHUNK_BYTES = 1 << 19

_ALL = np.arange(256)
#: Members of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` among lower-cased bytes.
ALNUM = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
#: Members of `[^\x20\x09-\x0D]`.
SOLID = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
LOWER = _ALL.astype(np.uint8)
LOWER[65:91] += 32
ASIS = _ALL.astype(np.uint8)

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POW = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        size = max(n, 256, 2 * len(_POW))
        steps = np.full(size, _BASE, np.uint64)
        steps[0] = 1
        _POW = np.multiply.accumulate(steps)
    return _POW


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), so that near inputs give unrelated outputs."""
    z = x.astype(np.uint64) + np.uint64((salt * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


class Chunk(NamedTuple):
    """Rows [lo, hi) of a batch: their bytes, end to end, and each row's bounds in them."""

    lo: int
    hi: int
    raw: np.ndarray  # uint8
    at: np.ndarray  # int64, hi - lo + 1


class Words(NamedTuple):
    start: np.ndarray  # byte offset in the chunk
    end: np.ndarray
    row: np.ndarray  # row in the chunk
    first: np.ndarray  # row -> its first word, len rows + 1
    hash: np.ndarray  # uint64


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    return pc.fill_null(column.cast(pa.large_string()), "")


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    column = plain(column)
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield Chunk(lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes, never across a row's bounds: start, end, row, first."""
    n = len(inside)
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        cut = at[1:-1]
        before[cut[cut < n]] = False
        after[cut[cut > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return start, end, row, first


def hash_spans(folded: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of disjoint, ascending spans of bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    total = int(size.sum())
    if total == 0:
        return mix(np.zeros(len(start), np.uint64))
    begin = np.cumsum(size) - size
    inner = np.arange(total) - np.repeat(begin, size)
    body = _BYTE[folded[inner + np.repeat(start, size)]]
    body *= _powers(int(size.max()))[inner]
    out = np.zeros(len(start), np.uint64)
    full = size > 0
    out[full] = np.add.reduceat(body, begin[full])
    return mix(out + size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def words(chunk: Chunk, member: np.ndarray = ALNUM, fold: np.ndarray = LOWER) -> Words:
    folded = fold[chunk.raw]
    start, end, row, first = runs(member[folded], chunk.at)
    return Words(start, end, row, first, hash_spans(folded, start, end))


def lines(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The `\\n`-split pieces of every row, empty ones included (an empty text is one empty line): start, end, row, first."""
    breaks = np.flatnonzero(chunk.raw == 10)
    rows = len(chunk.at) - 1
    own = np.searchsorted(chunk.at, breaks, "right") - 1
    row = np.concatenate([np.arange(rows), own])
    start = np.concatenate([chunk.at[:-1], breaks + 1])
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    last = np.searchsorted(row, np.arange(rows), "right") - 1
    end[last] = chunk.at[1:]
    return start, end, row, np.concatenate([[0], last + 1])


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n hashes from each position on; len(hashes) - n + 1 of them, whatever row they cross."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9FB21C651E98DF25) + hashes[k : k + count]
    return mix(out, n)


def spell(chunk: Chunk, start: int, end: int) -> str:
    return chunk.raw[start:end].tobytes().decode("utf-8", "replace")


def seed_of(text: str) -> np.uint64:
    """The hash that words() gives to one word."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return hash_spans(raw, np.array([0]), np.array([len(raw)]))[0]
