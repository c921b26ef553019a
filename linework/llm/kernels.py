"""NumPy kernels over Arrow text columns: words, word hashes and shingle hashes of many documents at once.

Words are maximal runs of bytes other than blank, tab, LF, VT, FF and CR; A-Z count as a-z. Hashes have 64 bits.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
import sys
import types
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa

T = TypeVar("T")

#: Bytes of text that one NumPy pass takes, unless one document alone is longer.
CHUNK_BYTES = 1 << 18

_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _shelf() -> dict:
    return sys.modules.setdefault("_linework_worker", types.ModuleType("_linework_worker")).__dict__


def kept_by_worker(name: str, make: Callable[[], T]) -> T:
    """What make() gave first in this Python process: workers serve many tasks, and tables learnt in one help the next.

    Only one thing is kept at a time, so what a stage learnt goes when another stage's tasks come.
    """
    shelf = _shelf()
    if shelf.get("name") != name:
        shelf["name"] = shelf["value"] = None
        shelf["value"] = make()
        shelf["name"] = name
    return shelf["value"]


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives freed memory back: idle workers stay, and share a machine with what runs next.

    Unless run keeps something by kept_by_worker, what other stages kept goes first.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _shelf().clear()
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x + _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: Seeds of two independent hash functions.
LANES = (0x1234567, 0xA24BAED4963EE407)
#: The lowest bytes of a block, by their number.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
#: Longer spans are hashed one by one by a digest.
LONG_SPAN = 512


def blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; beyond the end are zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of about limit bytes. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~_BLANK[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (~before | first))
    ends = np.flatnonzero(before & (~inside | first))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, doc


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, lane: int = 0) -> np.ndarray:
    """64-bit hash of each span of data: its length, then eight bytes at a time through a bijective mixer.

    Nothing is linear in it, so no texts collide by their structure; the two lanes are independent of each other.
    """
    if lower:
        data = _LOWER[data]
    eight = blocks(data)
    left = ends - starts
    out = mixed(left.astype(_U) ^ _U(LANES[lane]))
    live = np.flatnonzero((left > 0) & (left <= LONG_SPAN))
    at, left, state = starts[live], left[live], out[live]
    while len(live):
        state = mixed(state ^ (eight[at] & _LOWEST[np.minimum(left, 8)]))
        more = left > 8
        out[live[~more]] = state[~more]
        live, at, left, state = live[more], at[more] + 8, left[more] - 8, state[more]
    for i in np.flatnonzero(ends - starts > LONG_SPAN).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, salt=LANES[lane].to_bytes(8, "little")).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def same_spans(one: np.ndarray, at: np.ndarray, other: np.ndarray, place: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes of `one` from each at on equal those of `other` from place on, for sizes bytes."""
    same = np.ones(len(at), bool)
    x, y = blocks(one), blocks(other)
    live = np.flatnonzero((sizes > 0) & (sizes <= LONG_SPAN))
    k = 0
    while len(live):
        mask = _LOWEST[np.minimum(sizes[live] - k, 8)]
        same[live] = (x[at[live] + k] ^ y[place[live] + k]) & mask == 0
        k += 8
        live = live[same[live] & (sizes[live] > k)]
    for i in np.flatnonzero(sizes > LONG_SPAN).tolist():
        same[i] = np.array_equal(one[at[i] : at[i] + sizes[i]], other[place[i] : place[i] + sizes[i]])
    return same


def window_hashes(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of the `width` bytes from each place on, and that of the 64 bytes (or the most below width) it is made of.

    Hashes of 8 bytes join to those of 16, 32 and so on, as nodes of a tree; width is a multiple of 8.
    """
    level, size = mixed(blocks(data)[: max(0, len(data) - 7)].astype(_U)), 8
    levels = {8: level}
    while size * 2 <= min(width, 64):
        level = joined(level[:-size], level[size:])
        size *= 2
        levels[size] = level
    return windows_at(levels, np.arange(max(0, len(data) - width + 1)), width), levels


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> _U(29))) * _U(0xBF58476D1CE4E5B9) + (b << _U(23) | b >> _U(41))
    x ^= x >> _U(32)
    x *= _U(0x94D049BB133111EB)
    return x ^ x >> _U(29)


def windows_at(levels: dict[int, np.ndarray], at: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` bytes from each of some places on, from hashes of smaller windows at all places."""
    out, done = None, 0
    while done < width:
        size = max(s for s in levels if s <= width - done)
        part = levels[size][at + done]
        out = part if out is None else joined(out, part)
        done += size
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, lane: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document, start and end of each word."""
    starts, ends, doc = words(data, offsets)
    return span_hashes(data, starts, ends, lane=lane), doc, starts, ends


def _shingled(h: np.ndarray, doc: np.ndarray, counts: np.ndarray, width: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all shingles of words, those of documents with fewer than width words last."""
    n = len(h)
    weights = [int(x) | 1 for x in mixed(np.arange(1, width + 1, dtype=_U) ^ _U(LANES[lane]))]
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out_doc, out = [], []
    if n >= width:
        total = np.zeros(n - width + 1, _U)
        for k in range(width):
            total += h[k : n - width + 1 + k] * _U(weights[k])
        same = doc[: n - width + 1] == doc[width - 1 :]
        out_doc.append(doc[: n - width + 1][same])
        out.append(mixed(total[same]))
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        total = counts[short].astype(_U)
        for k in range(width - 1):
            some = counts[short] > k
            total[some] += h[first[short[some]] + k] * _U(weights[k])
        out_doc.append(short)
        out.append(mixed(total))
    return np.concatenate(out_doc), np.concatenate(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, second hash) of the distinct shingles of width words, sorted by document, then hash.

    A document with fewer words has its whole sequence as one shingle, one without words none. Shingles are the same if
    both hashes, of independent lanes, are.
    """
    starts, ends, doc = words(data, offsets)
    docs = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U)
    counts = np.bincount(doc, minlength=docs)
    all_doc, all_hash = _shingled(span_hashes(data, starts, ends), doc, counts, width, 0)
    _, second = _shingled(span_hashes(data, starts, ends, lane=1), doc, counts, width, 1)
    order = np.lexsort((all_hash, all_doc))

    def distinct() -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        d, h, g = all_doc[order], all_hash[order], second[order]
        again = np.zeros(len(d), bool)
        again[1:] = (d[1:] == d[:-1]) & (h[1:] == h[:-1])
        same = again.copy()
        same[1:] &= g[1:] == g[:-1]
        return d[~same], h[~same], g[~same], bool((again & ~same).any())

    d, h, g, met = distinct()
    if met:  # two shingles with one hash: their second hashes tell them apart
        order = np.lexsort((second, all_hash, all_doc))
        d, h, g, _ = distinct()
    return d, h, g
