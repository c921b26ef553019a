"""Token ids as shards compressed by Re-Pair.

A shard holds whole documents in ascending doc_id order. Pairs of neighbouring ids that are frequent in it are replaced by
nonterminals, again and again; the shard stores the rules, how many ids each nonterminal stands for, and what is left of
each document. So any stretch of a document is found by adding lengths, and only the symbols that cover it are expanded.

A shard is one binary value (`pack()` tells its layout), a row of a Parquet table in the shared folder: Spark's writer commits
it, so a lost executor leaves no part of a shard behind, and its readers reach it in any store.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linework.llm.common import documents, stored, text_key
from linework.llm.kernels import chunks, kept_by_worker, tidied
from linework.llm.packing import WordEncoder

#: The id that ends a document.
END = 1
#: Ids after which a shard closes; its last document is whole.
SHARD_IDS = 1 << 20
#: A round replaces the pairs that occur at least LEAST times; rounds end when one takes away no more than 1 / GAIN of the symbols.
LEAST, GAIN = 16, 30
#: Bits of the hash that pairs are counted and looked up by.
BITS = 18
MAGIC = b"RPR1"
SHARDS = "part int, shard int, start long, n_docs int, n_tokens long, n_symbols long, n_rules int, data binary"
_HEAD = "<4s4I2Q"
_U = np.uint64
_NONE = _U((1 << 64) - 1)


def _slots(keys: np.ndarray) -> np.ndarray:
    return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - BITS)).view(np.int64)


def _frequent(keys: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The pairs to replace in this round; none when no pair is frequent. Those in slots that are frequent are counted exactly."""
    ordered = np.sort(keys[(np.bincount(slots, minlength=1 << BITS) >= LEAST)[slots]])
    if not len(ordered):
        return ordered
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first[np.diff(np.append(first, len(ordered))) >= LEAST]]


def _alternate(hit: np.ndarray) -> np.ndarray:
    """Which places are the first, third and so on of a run of consecutive ones: occurrences that share no symbol."""
    run = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
    place = np.arange(len(hit))
    return (place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0


def repair(ids: np.ndarray, begin: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, where each document's begin, and rules (left, right): rule i makes symbol base + i. No rule spans documents."""
    seq, begin = ids.astype(np.uint32), begin.astype(np.int64)
    rules: list[np.ndarray] = []
    made = base
    taken = len(seq)
    while len(seq) > 1 and taken * GAIN > len(seq):
        last = begin[(begin > 0) & (begin < len(seq))] - 1  # a document's last symbol pairs with nothing
        keys = seq[:-1].astype(_U)
        keys <<= _U(32)
        keys |= seq[1:]
        keys[last] = _NONE
        slots = _slots(keys)
        chosen = _frequent(keys, slots)
        chosen = chosen[: len(chosen) - int(len(chosen) > 0 and chosen[-1] == _NONE)]
        if not len(chosen):
            break
        table = np.full(1 << BITS, -1, np.int32)  # of chosen pairs in one slot the last is taken now, the others in a later round
        table[_slots(chosen)] = np.arange(len(chosen))
        rank = table[slots]
        hit = np.flatnonzero(rank >= 0)
        hit = hit[chosen[rank[hit]] == keys[hit]]
        rank = rank[hit]
        some = _alternate(hit)
        hit, rank = hit[some], rank[some]
        used = np.bincount(rank, minlength=len(chosen))
        keep = used >= 2  # what other pairs took away
        if not keep[rank].any():
            break
        hit, rank = hit[keep[rank]], (np.cumsum(keep) - 1)[rank[keep[rank]]]
        pairs = chosen[keep]
        rules.append(np.stack([(pairs >> _U(32)).astype(np.uint32), pairs.astype(np.uint32)], 1))
        seq[hit] = (made + rank).astype(np.uint32)
        made, taken = made + len(pairs), len(hit)
        left = np.ones(len(seq), bool)
        left[hit + 1] = False
        begin = begin - np.searchsorted(hit + 1, begin)  # how many symbols before each document went
        seq = seq[left]
    return seq, begin, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each nonterminal stands for. A rule's parts are made before it."""
    lengths: list[int] = []
    for a, b in rules.tolist():
        lengths.append((lengths[a - base] if a >= base else 1) + (lengths[b - base] if b >= base else 1))
    return np.array(lengths, np.uint32)


def pack(names: list[int | None], begin: np.ndarray, ids: np.ndarray, base: int) -> tuple[bytes, int, int]:
    """A shard's bytes, and how many symbols and rules it has.

    Little-endian: MAGIC, base, documents, rules, bytes of a symbol's high part, symbols, ids; doc_ids (int64) and whether each is
    one (uint8); symbols and ids of each document (uint32); rules (2 uint32 each) and their lengths (uint32); the symbols' low 16
    bits, then their high parts (uint8, or uint16 for over 2^24 symbols); the crc32 of all that.
    """
    seq, at, rules = repair(ids, begin, base)
    wide = 1 if base + len(rules) <= 1 << 24 else 2
    high = (seq >> np.uint32(16)).astype(f"<u{wide}")
    parts = [
        struct.pack(_HEAD, MAGIC, base, len(names), len(rules), wide, len(seq), len(ids)),
        np.array([x or 0 for x in names], "<i8"), np.array([x is not None for x in names], "<u1"),
        np.diff(at).astype("<u4"), np.diff(begin).astype("<u4"), rules.astype("<u4"), rule_lengths(rules, base).astype("<u4"),
        (seq & np.uint32(0xFFFF)).astype("<u2"), high,
    ]
    data = b"".join(x if isinstance(x, bytes) else x.tobytes() for x in parts)
    return data + zlib.crc32(data).to_bytes(4, "little"), len(seq), len(rules)


class Shard:
    """A shard's bytes, read: documents and any stretch of one."""

    def __init__(self, data: bytes):
        body = memoryview(data)[:-4]
        if data[:4] != MAGIC or zlib.crc32(body) != int.from_bytes(data[-4:], "little"):
            raise ValueError("not a shard of token ids, or a damaged one")
        _, self.base, docs, rules, wide, symbols, self.n_tokens = struct.unpack_from(_HEAD, body)
        at = struct.calcsize(_HEAD)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, n, at)
            at += out.nbytes
            return out

        names, is_name = take("<i8", docs), take("<u1", docs)
        self.names = [int(x) if ok else None for x, ok in zip(names, is_name, strict=True)]
        self.begin = np.concatenate([[0], np.cumsum(take("<u4", docs), dtype=np.int64)])
        self.sizes = take("<u4", docs).astype(np.int64)
        self.rules = take("<u4", 2 * rules).reshape(-1, 2).astype(np.int64)
        self.lengths = np.concatenate([np.ones(self.base, np.int64), take("<u4", rules).astype(np.int64)])
        self.symbols = take("<u2", symbols).astype(np.int64) | take(f"<u{wide}", symbols).astype(np.int64) << 16

    @functools.cached_property
    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """Every symbol's ids one after the other, and where each symbol's begin."""
        at = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        flat = np.zeros(int(self.lengths.sum()), np.uint32)
        flat[: self.base] = np.arange(self.base)
        where, sizes = at.tolist(), self.lengths.tolist()
        for i, (a, b) in enumerate(self.rules.tolist(), self.base):
            o, n = where[i], sizes[a]
            flat[o : o + n] = flat[where[a] : where[a] + n]
            flat[o + n : o + sizes[i]] = flat[where[b] : where[b] + sizes[b]]
        return flat, at

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, at = self._expansions
        n = self.lengths[symbols]
        until = np.cumsum(n)
        place = np.repeat(at[symbols] - (until - n), n)
        place += np.arange(len(place))
        return flat[place]

    def ids(self) -> np.ndarray:
        """All ids, document by document."""
        return self.expand(self.symbols)

    def stretch(self, doc: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the doc-th document: only the symbols over them are expanded."""
        mine = self.symbols[self.begin[doc] : self.begin[doc + 1]]
        until = np.cumsum(self.lengths[mine])
        start, stop = max(0, start), min(stop, int(self.sizes[doc]))
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = (int(np.searchsorted(until, x, side="right")) for x in (start, stop - 1))
        before = int(until[a - 1]) if a else 0
        return self.expand(mine[a : b + 1])[start - before : stop - before]


def _written(path: str):
    names = [x.split()[0] for x in SHARDS.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one partition, in order; one shard's ids are held."""
        encoder = kept_by_worker(f"words:{path}", lambda: WordEncoder(path))
        base = len(encoder.closes)
        docs: list[int | None] = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []
        count = shard = start = part = 0

        def closed() -> pa.RecordBatch:
            nonlocal docs, sizes, held, count, shard, start
            data, n_symbols, n_rules = pack(docs, np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(held), base)
            row = (part, shard, start, len(docs), count, n_symbols, n_rules, data)
            shard, start, docs, sizes, held, count = shard + 1, start + count, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            name = batch.column("doc_id").to_pylist()
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for first, data, offsets in chunks(batch.column("text")):
                ids, begin = encoder.encode(data, offsets)
                n = len(offsets) - 1
                ended = np.full(len(ids) + n, END, np.uint32)
                ended[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(begin))] = ids
                docs += name[first : first + n]
                sizes.append(np.diff(begin) + 1)
                held.append(ended)
                count += len(ended)
                if count >= SHARD_IDS:
                    yield closed()
        if docs:
            yield closed()

    return run


def write_shards(docs: DataFrame, tokenizer: str, name: str = "shards") -> DataFrame:
    """The table of shards of all documents' ids, in ascending doc_id order (null first, then by a hash of the text), stored and read again.

    part and shard give their order, start the ids before a shard within its part. Rows that repeat, however often, are dealt by
    their place in the table as well, so no doc_id makes a task of its own.
    """
    ordered = documents(docs).withColumns({"_hash": text_key(), "_place": F.monotonically_increasing_id()})
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    key = [F.col("doc_id").asc_nulls_first(), "_hash", "_place"]
    dealt = ordered.repartitionByRange(n, *key).sortWithinPartitions(*key).select("doc_id", "text", F.spark_partition_id().alias("part"))
    return stored(dealt.mapInArrow(tidied(_written(tokenizer), keeps=True), SHARDS), name)


DIGEST = "part int, at long, doc_id long, n_tokens long, ids_crc32 long"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = [x.split()[0] for x in DIGEST.split(", ")], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        for part, start, data in zip(*(batch.column(c) for c in ("part", "start", "data")), strict=True):
            shard = Shard(data.as_py())
            raw = memoryview(shard.ids().astype("<u4").tobytes())
            until = np.cumsum(shard.sizes)
            at = until - shard.sizes
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), until.tolist(), strict=True)]
            columns = [[part.as_py()] * len(sums), at + start.as_py(), shard.names, shard.sizes, sums]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read_digests(shards: DataFrame) -> DataFrame:
    """Per document, from its shard: doc_id, start (the ids of all documents before it), n_tokens, ids_crc32."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = shards.select("part", "start", "data").mapInArrow(tidied(_digested), DIGEST)
    placed = found.join(F.broadcast(parts.select("part", before.alias("before"))), "part")  # a row for each partition that wrote
    return placed.select("doc_id", (F.col("at") + F.col("before")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def read_stretches(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, first, last) with ids, the document's ids first to last (exclusive), cut at its end; rows whose doc_id no shard has are left out.

    Where a doc_id repeats, each of its documents gives a row. Only the shards that hold a wanted document are decoded.
    """

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, data in zip(*(batch.column(c) for c in ("part", "shard", "data")), strict=True):
                found = Shard(data.as_py()).names
                columns = [pa.array(found, pa.int64()), pa.array([part.as_py()] * len(found), pa.int32()), pa.array([shard.as_py()] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "shard", "doc"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shard = None, None
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                if (r["part"], r["shard"]) != current:
                    current, shard = (r["part"], r["shard"]), Shard(r["data"])
                r["ids"] = shard.stretch(r["doc"], r["first"], r["last"]).astype(np.int64)
            columns = [pa.array([r[c] for r in rows], pa.int64()) for c in ("doc_id", "first", "last")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r["ids"] for r in rows], pa.list_(pa.int64()))], ["doc_id", "first", "last", "ids"])

    index = shards.select("part", "shard", "data").mapInArrow(names, "doc_id long, part int, shard int, doc int")
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))
    met = asked.join(index, "doc_id").join(shards.select("part", "shard", "data"), ["part", "shard"])
    return met.mapInArrow(cut, "doc_id long, first long, last long, ids array<long>")


def token_shards(docs: DataFrame, tokenizer: str) -> DataFrame:
    """What read_digests() finds in the shards that write_shards() made of docs.

    Null and empty texts are the end id alone. Rows that repeat a doc_id, or have none, are documents each: their starts are
    consecutive, those of null doc_ids first. A very long text is one document of one shard. Extra columns are ignored; an empty
    table gives no rows.
    """
    return read_digests(write_shards(docs, tokenizer))
