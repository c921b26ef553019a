"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

A bin is filled greedily with the longest piece that fits. Where a gap is left, its smallest piece makes way for the two
unpacked pieces whose lengths together fill the expanded gap most tightly. Pieces are dealt into groups of a bounded size
by hash, so groups pack in parallel and each wastes part of a few bins at most.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.llm.common import documents, stored
from linework.llm.kernels import _LOWER, chunks, kept_by_worker, same_spans, span_hashes, tidied, words

SEQUENCE = 2048
#: Pieces that one task packs.
GROUP_ROWS = 32_768
#: Parts of words that a worker keeps the ids of, and the bytes of one such part, at most.
CACHED_WORDS, CACHED_BYTES = 400_000, 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


_KIND = np.zeros(256, np.uint8)  # 1: ASCII letter, 2: ASCII digit, 3: ASCII sign but the apostrophe
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[[x for x in range(33, 127) if not chr(x).isalnum() and x != 39]] = 3


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of parts of words that the vocabulary never joins.

    Words are parted where an ASCII letter, digit or sign meets one of another kind. An apostrophe takes letters after
    it, and what is beyond ASCII may compose or run on with its neighbours, so nothing is parted beside them.
    """
    starts, ends, doc = words(data, offsets)
    kind = _KIND[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    cut[starts] = cut[ends] = False
    inner = np.flatnonzero(cut)
    if not len(inner):
        return starts, ends, doc
    owner = np.searchsorted(starts, inner, side="right") - 1
    all_starts, all_ends, all_doc = np.concatenate([starts, inner]), np.concatenate([ends, inner]), np.concatenate([doc, doc[owner]])
    order = np.argsort(all_starts, kind="stable")
    return all_starts[order], np.sort(all_ends), all_doc[order]


class HashTable:
    """Places of distinct 64-bit keys, looked up by whole arrays: open addressing, a third full at most."""

    def __init__(self) -> None:
        self.count = 0
        self._make(1 << 14)

    def _make(self, slots: int) -> None:
        self.mask = slots - 1
        self.keys, self.values = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, or -1."""
        at = (keys & np.uint64(self.mask)).astype(np.int64)
        out = self.values[at].astype(np.int64)
        open_ = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            out[open_] = self.values[at[open_]]
            open_ = open_[(out[open_] >= 0) & (self.keys[at[open_]] != keys[open_])]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that the table lacks."""
        self.count += len(keys)
        if 3 * self.count > self.mask:
            old, used = (self.keys, self.values), self.values >= 0
            self._make(1 << (6 * self.count).bit_length())
            self._put(old[0][used], old[1][used])
        self._put(keys, values)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = (keys & np.uint64(self.mask)).astype(np.int64)
        while len(keys):
            free = self.values[at] < 0
            _, first = np.unique(at, return_index=True)
            put = np.zeros(len(at), bool)
            put[first] = True
            put &= free
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & self.mask


class Pool:
    """Consecutive arrays in one that grows."""

    def __init__(self, dtype: type):
        self.flat, self.used = np.zeros(4096, dtype), 0
        self.start, self.size, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int32), 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        for name, used, more in (("flat", self.used, len(flat)), ("start", self.count, len(sizes)), ("size", self.count, len(sizes))):
            have = getattr(self, name)
            if used + more > len(have):
                grown = np.zeros(max(2 * len(have), used + more), have.dtype)
                grown[:used] = have[:used]
                setattr(self, name, grown)
        self.flat[self.used : self.used + len(flat)] = flat
        at = slice(self.count, self.count + len(sizes))
        self.start[at], self.size[at] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.count = self.used + len(flat), self.count + len(sizes)


class WordEncoder:
    """Token ids of whole texts, part of word by part of word, each known one from a table.

    The table is looked up by hashes and holds each part's bytes, which are compared: a part that only shares its hash with
    a known one is encoded by itself, as are long parts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        #: Texts with these are not parted, as they are matched across kinds and by case.
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.table, self.ids, self.bytes = HashTable(), Pool(np.uint32), Pool(np.uint8)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.fromiter(map(len, found), np.int64, len(found)), np.array([x for ids in found for x in ids], np.uint32)

    def _learn(self, keys: np.ndarray, parts: list[bytes]) -> None:
        """Ids of new parts. Parts of letters alone are one unit to the tokenizer, so many are encoded as one text."""
        texts = [x.decode("utf-8", "replace") for x in parts]
        plain = [i for i, x in enumerate(texts) if x.isalpha() and "İ" not in x]
        sized = []
        if plain:
            ids = np.array(self.tokenizer.encode(" ".join([texts[i] for i in plain]), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(plain):
                sized.append((plain, np.diff(ends, prepend=0), ids))
            else:  # a word that normalising parts: one by one
                plain = []
        left = set(plain)
        rest = [i for i in range(len(texts)) if i not in left]
        if rest:
            sized.append((rest, *self._encoded([texts[i] for i in rest])))
        for some, sizes, ids in sized:
            raw = [parts[i] for i in some]
            self.table.add(keys[some], np.arange(self.ids.count, self.ids.count + len(some), dtype=np.int32))
            self.ids.add(ids, sizes)
            self.bytes.add(np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk's documents, and where each document's begin."""
        raw = data.tobytes()
        whole = any(x in raw for x in self.special)
        starts, ends, doc = words(data, offsets) if whole else units(data, offsets)
        if not whole:  # the vocabulary is of lower case
            data = _LOWER[data]
            raw = data.tobytes()
        hashes = span_hashes(data, starts, ends, lower=False)
        if whole:
            hashes ^= np.uint64(0x5DEECE66D)
        long = ends - starts > CACHED_BYTES
        entry = self.table.find(hashes)
        new = np.flatnonzero((entry < 0) & ~long)
        if len(new):
            keys, first = np.unique(hashes[new], return_index=True)
            if self.ids.count and self.ids.count + len(keys) > CACHED_WORDS:  # all of this chunk's parts are learnt anew
                self.clear()
                new = np.flatnonzero(~long)
                keys, first = np.unique(hashes[new], return_index=True)
            at = new[first]
            self._learn(keys, [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            entry[new] = self.table.find(hashes[new])
        entry[long] = -1
        known = np.flatnonzero(entry >= 0)
        of = entry[known]
        same = self.bytes.size[of] == (ends - starts)[known]
        same[same] = same_spans(data, starts[known[same]], self.bytes.flat[: self.bytes.used], self.bytes.start[of[same]], (ends - starts)[known[same]])
        flat, begin, sizes = self.ids.flat, np.zeros(len(entry), np.int64), np.zeros(len(entry), np.int64)
        begin[known], sizes[known] = self.ids.start[of], self.ids.size[of]
        entry[known[~same]] = -1
        alone = np.flatnonzero(entry < 0)
        if len(alone):
            n, ids = self._encoded([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[alone].tolist(), ends[alone].tolist(), strict=True)])
            begin[alone], sizes[alone] = self.ids.used + np.cumsum(n) - n, n
            flat = np.concatenate([flat[: self.ids.used], ids])
        until = np.cumsum(sizes)
        total = int(until[-1]) if len(until) else 0
        ids = flat[np.repeat(begin - (until - sizes), sizes) + np.arange(total)]
        per_doc = np.bincount(doc, weights=sizes, minlength=len(offsets) - 1).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_doc)])


def _cut(path: str, length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_by_worker(f"words:{path}", lambda: WordEncoder(path))
        for batch in batches:
            names = batch.column("doc_id")
            for first, data, offsets in chunks(batch.column("text")):
                ids, begin = encoder.encode(data, offsets)
                docs = len(offsets) - 1
                closed = np.zeros(len(ids) + docs, np.uint32)  # a 0 after each document's ids
                closed[np.arange(len(ids)) + np.repeat(np.arange(docs), np.diff(begin))] = ids
                begin = begin + np.arange(docs + 1)
                parts = -(-np.diff(begin) // length)
                doc = np.repeat(np.arange(docs), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                at = begin[doc] + piece * length
                sizes = np.minimum(begin[doc + 1] - at, length)
                raw = memoryview(closed.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), sizes.tolist(), strict=True)]
                columns = [names.take(pa.array(first + doc)), pa.array(piece.astype(np.int32)), pa.array(piece * length), pa.array(sizes), pa.array(sums, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(closed)).astype(np.int32)), pa.array(closed.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return run


def pieces(docs: DataFrame, tokenizer: str, length: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Each document's ids and a closing 0, cut only where longer than length. Null and empty texts are the 0 alone."""
    return documents(docs).mapInArrow(tidied(_cut(tokenizer, length, with_ids), keeps=True), PIECES + (", ids array<long>" if with_ids else ""))


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (1 to capacity)."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in np.argsort(lengths, kind="stable")[::-1].tolist():
        stacks[lengths[i]].append(i)
    have = back = 0  # bit l, or bit capacity - l: a piece of length l is unpacked
    for size, stack in enumerate(stacks):
        if stack:
            have |= 1 << size
            back |= 1 << capacity - size

    def take(size: int) -> int:
        nonlocal have, back
        item = stacks[size].pop()
        if not stacks[size]:
            have ^= 1 << size
            back ^= 1 << capacity - size
        return item

    def give(size: int, item: int) -> None:
        nonlocal have, back
        if not stacks[size]:
            have |= 1 << size
            back |= 1 << capacity - size
        stacks[size].append(item)

    def two(room: int, over: int) -> tuple[int, int] | None:
        """The lengths of two unpacked pieces with the largest sum in (over, room]."""
        for total in range(room, over, -1):
            both = have & (back >> capacity - total)
            if both:
                a = both.bit_length() - 1
                if 2 * a != total or len(stacks[a]) > 1:
                    return a, total - a
                both ^= 1 << a
                if both:
                    a = both.bit_length() - 1
                    return a, total - a
        return None

    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0
    while have:
        inside: list[tuple[int, int]] = []
        gap = capacity
        while True:
            while gap and (fits := have & (1 << gap + 1) - 1):
                size = fits.bit_length() - 1
                inside.append((size, take(size)))
                gap -= size
            if not gap or not have:
                break
            k = min(range(len(inside)), key=inside.__getitem__)
            size, item = inside[k]
            if (pair := two(gap + size, size)) is None:
                break
            inside.pop(k)
            inside += [(x, take(x)) for x in pair]
            give(size, item)
            gap += size - sum(pair)
        at = 0
        for size, item in inside:
            bins[item], offsets[item] = number, at
            at += size
        number += 1
    return bins, offsets


def _packed(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = best_two_fit(table.column("length").to_numpy(), capacity)
        group = table.column("_group").to_numpy()
        return table.drop_columns(["_group"]).append_column("sequence_id", pa.array((group.astype(np.int64) << 32) + bins)).append_column("offset", pa.array(offsets))

    return run


def pack(cut: DataFrame, capacity: int = SEQUENCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """cut (of pieces(), stored) with sequence_id and offset. Full pieces take a sequence each; the rest are packed by groups.

    Rows are dealt by their place in the stored table, so that rows that repeat, however often, spread over the groups.
    """
    short = cut.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group_rows))
    dealt = short.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    packed = dealt.groupBy("_group").applyInArrow(_packed(capacity), schema)
    full = cut.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the closing 0; rows that repeat a doc_id, null ones too, are packed each. Of pieces
    of equal length, which are alike for packing, the one of the smallest doc_id and piece goes first. A very long text is
    cut into as many pieces as it needs, and a very long word is encoded by itself. Extra columns are ignored; an empty table
    gives no rows. with_ids adds the token ids of each piece, for writing the sequences out.
    """
    return pack(stored(pieces(docs, tokenizer, capacity, with_ids), "pieces"), capacity)
