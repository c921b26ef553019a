"""Removal of long repeated byte strings by difference-cover suffix sorting.

Two equal strings of LENGTH bytes have the same leftmost least hash among their grams of GRAM bytes: their anchor. Each
string start of each text is dealt to its anchor, with the stretch of text that the anchor's starts need. Anchors that
occur once have no repeats. A stretch that occurs as a whole more than once is repeated as a whole. For anchors with
stretches that differ, the stretches' suffixes are sorted by the difference-cover algorithm (sampled triples are sorted
and named, names recurse, the remaining suffixes merge in) and neighbours in the order are compared over LENGTH bytes.
Anchors with very many different stretches compare their strings by count instead, so no task holds an unbounded group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.llm.common import documents, gated, parted, stored
from linework.llm.kernels import chunks, mixed, span_hashes, tidied, window_hashes

LENGTH = 200
GRAM = 40
#: Different stretches of an anchor that are sorted together.
SORTED_STRETCHES = 2048
#: Bytes that one suffix sort takes, beyond a single anchor's.
SORT_BYTES = 1 << 19
#: Bytes of text that a batch of results holds.
OUT_BYTES = 4 << 20
#: Part of a very long text that is hashed at once.
PART_BYTES = 4 << 20
_PLACE = 24  # bits of a position in a sliding minimum's key


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of integers in [1, 2 ** 21), by the difference cover {1, 2} modulo 3."""
    n = len(t)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    s = np.concatenate([t.astype(np.int64), np.zeros(3, np.int64)])
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a last position past the end keeps names apart
    sample = np.concatenate([ones, twos])
    padded = np.concatenate([s, np.zeros(3, np.int64)])
    triple = padded[sample] << 42 | padded[sample + 1] << 21 | padded[sample + 2]
    distinct, names = np.unique(triple, return_inverse=True)
    if len(distinct) < len(sample):
        order = suffix_array(names + 1)
    else:
        order = np.empty(len(sample), np.int64)
        order[names] = np.arange(len(sample))
    rank = np.zeros(n + 6, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    rank[n:] = 0
    first = np.arange(0, n, 3)
    key = padded[first] << 21 | rank[first + 1]
    first = first[np.argsort(key, kind="stable")]
    in_order = sample[order]
    in_order = in_order[in_order < n]
    at_one, at_two = in_order[in_order % 3 == 1], in_order[in_order % 3 == 2]
    before = np.searchsorted(padded[at_one] << 21 | rank[at_one + 1], padded[first] << 21 | rank[first + 1])
    before += np.searchsorted(
        padded[at_two] << 42 | padded[at_two + 1] << 21 | rank[at_two + 2], padded[first] << 42 | padded[first + 1] << 21 | rank[first + 2]
    )
    out = np.empty(n, np.int64)
    place = before + np.arange(len(first))
    out[place] = first
    rest = np.ones(n, bool)
    rest[place] = False
    out[rest] = in_order
    return out


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, anchor hash, two stretch hashes, first start, end of starts) of each run of starts with one anchor."""
    if len(data) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    gram, levels = window_hashes(data, GRAM)
    at = np.arange(len(gram))
    least = _sliding_min(gram >> np.uint64(_PLACE) << np.uint64(_PLACE) | at.astype(np.uint64), LENGTH - GRAM + 1)
    where = (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    starts = np.arange(len(where))
    room = np.repeat(offsets[1:], np.diff(offsets))[: len(where)]  # where each start's document ends
    good = starts + LENGTH <= room
    starts, where, room = starts[good], where[good], room[good]
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    new = np.ones(len(starts), bool)
    new[1:] = (where[1:] != where[:-1]) | (room[1:] != room[:-1])
    lo = starts[new]
    hi = np.append(starts[np.flatnonzero(new)[1:] - 1], starts[-1]) + 1
    pos = where[new]
    stretch = mixed(span_hashes(data, lo, hi + LENGTH - 1, lower=False) + (pos - lo).astype(np.uint64))
    second = span_hashes(data, lo, hi + LENGTH - 1, lower=False, lane=1)
    doc = np.searchsorted(offsets, lo, side="right") - 1
    return doc, gram[pos].view(np.int64), stretch.view(np.int64), second.view(np.int64), lo - offsets[doc], hi - offsets[doc]


ANCHORS = "doc_id long, text_key long, anchor long, stretch long, second long, lo int, hi int"


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, keys = batch.column("doc_id"), batch.column("text_key")
        for first, data, offsets in chunks(batch.column("text")):
            parts = [(0, len(data))] if len(offsets) > 2 or len(data) <= PART_BYTES else [(a, min(len(data), a + PART_BYTES + LENGTH - 1)) for a in range(0, len(data) - LENGTH + 1, PART_BYTES)]
            for a, b in parts:
                doc, anchor, stretch, second, lo, hi = anchored(data[a:b], offsets if len(parts) == 1 else np.array([0, b - a]))
                if len(doc):
                    rows = pa.array(doc + first)
                    yield pa.RecordBatch.from_arrays([names.take(rows), keys.take(rows), pa.array(anchor), pa.array(stretch), pa.array(second), pa.array((lo + a).astype(np.int32)), pa.array((hi + a).astype(np.int32))], [x.split()[0] for x in ANCHORS.split(", ")])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the asked stretches of each text."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.binary()]
    for batch in batches:
        out: list[tuple] = []
        size = 0
        for name, key, text, asked in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), batch.column("text"), batch.column("asked"), strict=True):
            raw = text.as_py().encode()
            for x in asked.as_py():
                out.append((name, key, x["anchor"], x["stretch"], x["single"], x["hot"], x["lo"], raw[x["lo"] : x["hi"] + LENGTH - 1]))
                size += len(out[-1][-1])
                if size > OUT_BYTES:
                    yield _rows(out, kinds, _STRETCH_NAMES)
                    out, size = [], 0
        if out:
            yield _rows(out, kinds, _STRETCH_NAMES)


def _rows(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


STRETCHES = "doc_id long, text_key long, anchor long, stretch long, single boolean, hot boolean, lo int, body binary"
_STRETCH_NAMES = [x.split()[0] for x in STRETCHES.split(", ")]
SPANS = "doc_id long, text_key long, s int, e int"


def repeated_starts(bodies: list[bytes]) -> list[np.ndarray]:
    """Starts in each body whose LENGTH bytes also start elsewhere in the list, among starts with LENGTH bytes left."""
    sizes = np.array([len(b) for b in bodies])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    t = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8).astype(np.int64) + 2
    t[begin[1:] - 1] = 1
    body = np.repeat(np.arange(len(bodies)), sizes + 1)
    left = begin[body] + sizes[body] - np.arange(len(t))
    order = suffix_array(t)
    order = order[left[order] >= LENGTH]
    hit = np.zeros(len(t), bool)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        same = np.ones(len(a), bool)
        for k in range(0, LENGTH, 8):  # neighbours drop out early
            live = np.flatnonzero(same)
            if not len(live):
                break
            x, y = a[live, None] + np.arange(k, k + 8), b[live, None] + np.arange(k, k + 8)
            same[live] = (t[x] == t[y]).all(1)
        hit[a[same]] = hit[b[same]] = True
    return [np.flatnonzero(hit[begin[i] : begin[i] + sizes[i]]) for i in range(len(bodies))]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """Covered spans of strings at sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > LENGTH) + 1
    return [(int(x[0]), int(x[-1]) + LENGTH) for x in np.split(starts, cut)]


def _sorted_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def found() -> Iterator[pa.RecordBatch]:
        out = [
            (name, key, lo + s, lo + e)
            for (name, key, _, single, lo, _), starts in zip(held, repeated_starts([x[5] for x in held]), strict=True)
            if single
            for s, e in _runs(starts)
        ]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "text_key", "s", "e"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "anchor", "single", "lo", "body")), strict=True):
            if size > SORT_BYTES and row[2] != held[-1][2]:
                yield from found()
                held, size = [], 0
            held.append(row)
            size += len(row[5])
    if held:
        yield from found()


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each string start of a stretch: two hashes of its LENGTH bytes, of independent functions."""
    for batch in batches:
        for i, body in enumerate(batch.column("body")):
            data = np.frombuffer(body.as_py(), np.uint8)
            at = np.arange(len(data) - LENGTH + 1)
            h, _ = window_hashes(data, LENGTH)
            g = span_hashes(data, at, at + LENGTH, lower=False, lane=1)
            same = [batch.column(c).slice(i, 1).take(pa.array(np.zeros(len(at), np.int64))) for c in ("doc_id", "text_key", "single")]
            start = batch.column("lo")[i].as_py() + at
            yield pa.RecordBatch.from_arrays([*same, pa.array(start.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(g.view(np.int64))], ["doc_id", "text_key", "single", "s", "h", "g"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for batch in batches:
        out, size = [], 0
        for name, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("spans"), strict=True):
            raw = text.as_py().encode()
            kept, at, runs = [], 0, 0
            if spans.is_valid:
                inside = spans.values
                s, e = inside.field("s").to_numpy(), inside.field("e").to_numpy()
                order = np.argsort(s, kind="stable")
                s, e = s[order].astype(np.int64), np.maximum.accumulate(e[order]).astype(np.int64)
                new = np.ones(len(s), bool)
                new[1:] = s[1:] > e[:-1]
                ends = np.append(e[np.flatnonzero(new)[1:] - 1], e[-1])
                for a, b in zip(s[new].tolist(), ends.tolist(), strict=True):
                    kept.append(raw[at:a])
                    at = b
                    runs += 1
            kept.append(raw[at:])
            rest = b"".join(kept)
            out.append((name, len(raw), len(raw) - len(rest), runs, hashlib.sha256(rest).hexdigest(), rest))
            size += len(rest)
            if size > OUT_BYTES:
                yield _rows(out, kinds, names)
                out, size = [], 0
        if out:
            yield _rows(out, kinds, names)


def keyed(docs: DataFrame) -> DataFrame:
    """documents() with a hash of the text, so that rows that repeat a doc_id stay apart."""
    return documents(docs).withColumn("text_key", F.xxhash64("text"))


def repeated_spans(docs: DataFrame, sorted_stretches: int = SORTED_STRETCHES) -> DataFrame:
    """(doc_id, text_key, s, e): byte spans whose every byte lies in a string of LENGTH bytes that starts elsewhere too."""
    rows = keyed(docs)
    found = stored(rows.mapInArrow(tidied(_anchors), ANCHORS), "anchors")
    often = stored(found.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "anchors-met")
    met = stored(gated(found, F.col("anchor"), often, "anchor", often.count()).join(often, "anchor", "left_semi"), "met")
    one = [F.first(c).alias(c) for c in ("doc_id", "text_key", "lo", "hi")]  # of one row, as all take the first
    kinds = stored(met.groupBy("anchor", "stretch", "second").agg(F.count("*").alias("times"), *one), "stretches")
    per_anchor = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")

    whole = met.join(kinds.where("times > 1").select("anchor", "stretch", "second"), ["anchor", "stretch", "second"], "left_semi")
    whole = whole.select("doc_id", "text_key", F.col("lo").alias("s"), (F.col("hi") + (LENGTH - 1)).alias("e"))
    asked = (
        kinds.join(per_anchor, "anchor")
        .select("doc_id", "text_key", F.struct("anchor", "stretch", (F.col("times") == 1).alias("single"), (F.col("kinds") > sorted_stretches).alias("hot"), "lo", "hi").alias("x"))
        .groupBy("doc_id", "text_key").agg(F.collect_list("x").alias("asked"))
    )
    asked = stored(asked, "asked")
    # Rows that repeat a doc_id and text repeat each other's stretches, which are then none that occur once.
    near = gated(rows, F.col("doc_id"), asked, "doc_id", asked.count())
    near = near.withColumnRenamed("doc_id", "d").withColumnRenamed("text_key", "k").join(asked, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("text_key")))
    bodies = stored(near.select("doc_id", "text_key", "text", "asked").mapInArrow(tidied(_stretches), STRETCHES), "bodies")
    ordered = bodies.where("not hot").repartition("anchor").sortWithinPartitions("anchor").select("doc_id", "text_key", "anchor", "single", "lo", "body")
    parts = whole.unionByName(ordered.mapInArrow(tidied(_sorted_spans), SPANS))
    strings = bodies.where("hot").select("doc_id", "text_key", "single", "lo", "body").mapInArrow(tidied(_strings), "doc_id long, text_key long, single boolean, s int, h long, g long")
    twice = strings.groupBy("h", "g").agg(F.count("*").alias("times")).where("times > 1")
    return parts.unionByName(strings.where("single").join(twice, ["h", "g"]).select("doc_id", "text_key", "s", (F.col("s") + LENGTH).alias("e")))


def remove_repeats(docs: DataFrame, sorted_stretches: int = SORTED_STRETCHES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    Null text counts as empty; texts under LENGTH bytes keep everything; a row that repeats another's doc_id and text is
    a copy like any other, and rows that share a doc_id, or have none, only that are told apart by their texts. Texts over
    PART_BYTES are hashed in parts that overlap. Extra columns are ignored; an empty table gives no rows.
    """
    spans = repeated_spans(docs, sorted_stretches).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    spans = stored(spans.withColumnRenamed("doc_id", "d").withColumnRenamed("text_key", "k"), "spans")
    near, far = parted(keyed(docs), F.col("doc_id"), spans, "d", spans.count())
    hit = near.join(spans, near["doc_id"].eqNullSafe(spans["d"]) & (near["text_key"] == spans["k"]), "left").select("doc_id", "text", "spans")
    zero = F.lit(0).cast("long")
    clear = far.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"))
    return hit.mapInArrow(tidied(_removed), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").unionByName(clear)
