"""Two tokenizers' tokens of the same text, aligned by an event sweep.

Each token is an event at the byte where it ends. A document's events of both sides in order of their offsets run through a
machine that holds nothing but the group it is in: where both sides end at one offset the group closes, and every pair of its
A and B tokens is a link. swept() runs on any two event tables: it deals them out by document, sorts within partitions and
streams. A corpus's own events are born document by document in the task that reads the text, already in order on each
side, so aligned_texts() merges them there, a stretch of text at a time, and moves only what is counted.

Counts are of documents for each linked id pair. Pairs of over one in HOT of all are broadcast (there are at most HOT
of them); the others are joined.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.llm.common import documents, stored
from linework.llm.kernels import kept_by_worker, mixed, same_spans, span_hashes, tidied
from linework.llm.packing import HashTable, Pool

#: Bytes of text that are swept at once; a stretch ends where both sides are sure to.
STRETCH_BYTES = 1 << 18
#: Distinct units that a worker keeps the ids of, and the bytes of one such unit, at most.
KEPT_UNITS, UNIT_BYTES = 400_000, 96
#: Pairs that are broadcast: those with more than one in HOT of all (document, pair) rows.
HOT = 1 << 20
#: Distinct pairs that a task counts before it hands them on.
COUNTED = 1 << 22
_U = np.uint64
#: Fixed: the split of byte-level BPE before merging, as its public files have it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin-1 itself, the others counted up from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level(path: str) -> tuple[Callable[[str], np.ndarray], list[bytes]]:
    """How a byte-level BPE file encodes a text (special tokens' strings are plain text), and each id's bytes.

    The vocabulary is handed to the faster of the two public encoders, which merges by id; so a file whose merges are not
    numbered in order is refused.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    signs, special = byte_alphabet(), {t["id"] for t in model["added_tokens"]}
    ranks = {bytes(signs[c] for c in token): i for token, i in model["model"]["vocab"].items() if i not in special}
    made = [model["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["model"]["merges"]]
    if made != sorted(made):
        raise ValueError("the merges of a byte-level vocabulary must be numbered in order")
    encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    entries = [b""] * (max(ranks.values()) + 1)
    for raw, i in ranks.items():
        entries[i] = raw
    return lambda text: np.asarray(encoding.encode_ordinary(text), np.int32), entries


def pieces(path: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """How a piece model encodes texts, and each id's bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        entries.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return lambda texts: model.encode(texts, num_threads=1), entries


#: Bytes of ASCII white space and separators, and bytes that lead letters and marks of two bytes (U+00C0 to U+03FF).
_WHITE, _LEAD = np.zeros(256, bool), np.zeros(256, bool)
_WHITE[[*range(9, 14), *range(28, 33)]] = True
_LEAD[0xC3:0xD0] = True


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Where units begin in bytes that begin with the added space: at a space between two signs that aren't white.

    Neither side has a token across such a place: the byte-level split ends before it, and no piece has a space behind another
    sign. Beside signs beyond U+03FF nothing is cut, as some of them are white.
    """
    if len(data) < 3:
        return np.zeros(min(1, len(data)), np.int64)
    at = np.flatnonzero(data[1:-1] == 32) + 1
    before, after = data[at - 1], data[at + 1]
    letter = _LEAD[data[np.maximum(at - 2, 0)]] & (before >= 128) & (before < 192) & (at > 1)
    at = at[((before < 128) & ~_WHITE[before] | letter) & ((after < 128) & ~_WHITE[after] | _LEAD[after])]
    return np.concatenate([[0], at])


class Encoders:
    """Ids of both sides, unit by unit; units met before come from a table, whose bytes are compared."""

    def __init__(self, bytes_path: str, pieces_path: str):
        self.encode_a, self.bytes_a = byte_level(bytes_path)
        self.encode_b, self.bytes_b = pieces(pieces_path)
        self.size_a, self.size_b = (np.array([len(x) for x in entries], np.int64) for entries in (self.bytes_a, self.bytes_b))
        for piece in self.bytes_b:
            if b" " in piece.lstrip(b" "):
                raise ValueError("a piece has a space behind another sign, so texts can't be cut at spaces")
        decimals = [b",%d" % i for i in range(1 << 16)]
        self.decimals = np.frombuffer(b"".join(decimals), np.uint8)
        self.decimal_at = np.concatenate([[0], np.cumsum([len(x) for x in decimals])])
        self.clear()

    def clear(self) -> None:
        self.table, self.a, self.b, self.raw = HashTable(), Pool(np.uint16), Pool(np.uint16), Pool(np.uint8)
        self.fits = Pool(np.bool_)

    def _encoded(self, parts: list[bytes]) -> tuple[list[np.ndarray], list[list[int]], np.ndarray]:
        texts = [x.decode() for x in parts]
        a, b = [self.encode_a(t) for t in texts], self.encode_b([t[1:] for t in texts])
        fits = [b"".join([self.bytes_a[i] for i in x]) == raw == b"".join([self.bytes_b[i] for i in y]) for x, y, raw in zip(a, b, parts, strict=True)]
        return a, b, np.array(fits, bool)

    def encode(self, data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Units' starts and whether both sides give their bytes back; ids of A and how many each unit has; the same of B. A text, or the rest of one, begins at each cut."""
        starts = np.union1d(cut, unit_starts(data))
        ends = np.append(starts[1:], len(data))
        raw = data.tobytes()
        hashes = span_hashes(data, starts, ends, lower=False)
        long = ends - starts > UNIT_BYTES
        entry = self.table.find(hashes)
        new = np.flatnonzero((entry < 0) & ~long)
        if len(new):
            keys, first = np.unique(hashes[new], return_index=True)
            if self.a.count and self.a.count + len(keys) > KEPT_UNITS:  # all of this stretch's units are learnt anew
                self.clear()
                new = np.flatnonzero(~long)
                keys, first = np.unique(hashes[new], return_index=True)
            at = new[first]
            parts = [raw[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            a, b, fits = self._encoded(parts)
            self.table.add(keys, np.arange(self.a.count, self.a.count + len(keys), dtype=np.int32))
            for pool, lists in ((self.a, a), (self.b, b)):
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                pool.add(np.fromiter((i for x in lists for i in x), np.uint16, int(sizes.sum())), sizes)
            self.raw.add(np.frombuffer(b"".join(parts), np.uint8), np.fromiter(map(len, parts), np.int64, len(parts)))
            self.fits.add(fits, np.ones(len(parts), np.int64))
            entry[new] = self.table.find(hashes[new])
        entry[long] = -1
        known = np.flatnonzero(entry >= 0)
        of = entry[known]
        same = self.raw.size[of] == (ends - starts)[known]
        same[same] = same_spans(data, starts[known[same]], self.raw.flat[: self.raw.used], self.raw.start[of[same]], (ends - starts)[known[same]])
        entry[known[~same]] = -1
        alone = np.flatnonzero(entry < 0)
        whole = self._encoded([raw[x:y] for x, y in zip(starts[alone].tolist(), ends[alone].tolist(), strict=True)]) if len(alone) else None
        known = np.flatnonzero(entry >= 0)
        of = entry[known]
        fits = np.zeros(len(entry), bool)
        fits[known] = self.fits.flat[self.fits.start[of]]
        out = [starts, fits]
        for k, pool in enumerate((self.a, self.b)):
            flat, begin, sizes = pool.flat, np.zeros(len(entry), np.int64), np.zeros(len(entry), np.int64)
            begin[known], sizes[known] = pool.start[of], pool.size[of]
            if whole:
                fits[alone] = whole[2]
                n = np.fromiter(map(len, whole[k]), np.int64, len(alone))
                begin[alone], sizes[alone] = pool.used + np.cumsum(n) - n, n
                flat = np.concatenate([flat[: pool.used], np.fromiter((i for x in whole[k] for i in x), np.uint16, int(n.sum()))])
            until = np.cumsum(sizes)
            out += [flat[np.repeat(begin - (until - sizes), sizes) + np.arange(int(until[-1]) if len(until) else 0)].astype(np.int64), sizes]
        return tuple(out)


    def group_text(self, ids: np.ndarray, signs: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Each id in decimal behind its sign (a comma where it is 0), and where each begins."""
        begin = self.decimal_at[ids]
        n = self.decimal_at[ids + 1] - begin
        at = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(begin - at[:-1], n)
        place += np.arange(len(place))
        out = self.decimals[place]
        out[at[:-1][signs > 0]] = signs[signs > 0]
        return out.tobytes(), at


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sweep over the union of both sides' ends: each event's group is how many offsets before it ended tokens of both."""
    size = int(max(ends_a[-1], ends_b[-1])) + 1
    one, other = np.zeros(size, bool), np.zeros(size, bool)
    one[ends_a] = other[ends_b] = True
    closed = np.cumsum(one & other, dtype=np.int32)
    return closed[ends_a - 1], closed[ends_b - 1]


class Document:
    """What the sweep keeps of a document between stretches: sums, a digest and its distinct pairs."""

    def __init__(self) -> None:
        self.fits, self.n_a, self.n_b, self.n_groups, self.n_links = True, 0, 0, 0, 0
        self.digest = hashlib.sha256()
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def linked(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (A's id, then 16 bits of B's) in order, and how often each is linked."""
        if len(self.pairs) > 1:
            keys, n = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.pairs = [(keys[first], np.add.reduceat(n, first))]
        return self.pairs[0] if self.pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _sweep(docs: list[Document], encoders: Encoders, data: np.ndarray, cut: np.ndarray) -> None:
    """Takes a stretch of whole units in: the parts from each cut on are of one document each."""
    starts, fits, a, n_a, b, n_b = encoders.encode(data, cut)
    part = np.searchsorted(cut, starts, side="right") - 1
    part_a, part_b = np.repeat(part, n_a), np.repeat(part, n_b)
    if not fits.all():  # such a document has no tokens at all
        bad = np.zeros(len(docs), bool)
        bad[part[~fits]] = True
        for i in np.flatnonzero(bad).tolist():
            docs[i].fits = False
        good_a, good_b = ~bad[part_a], ~bad[part_b]
        a, b, part_a, part_b = a[good_a], b[good_b], part_a[good_a], part_b[good_b]
    if not len(a):
        return
    ends_a, ends_b = np.cumsum(encoders.size_a[a]), np.cumsum(encoders.size_b[b])
    group_a, group_b = groups_of(ends_a, ends_b)
    groups = int(group_a[-1]) + 1
    in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    of_group = part_a[np.cumsum(in_a) - in_a]
    n = len(docs)
    sums = [np.bincount(x, minlength=n) for x in (part_a, part_b, of_group)] + [np.bincount(of_group, in_a * in_b, minlength=n).astype(np.int64)]
    # Each A token with its group's B tokens, in order.
    times = in_b[group_a]
    until = np.cumsum(times)
    place = np.repeat((np.cumsum(in_b) - in_b)[group_a] - (until - times), times)
    place += np.arange(len(place))
    keys = np.repeat((part_a.astype(np.int64) << 32) | (a << 16), times) | b[place]
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    many = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    bounds = np.searchsorted(keys, np.arange(n + 1) << 32)
    keys &= 0xFFFFFFFF
    total = np.concatenate([[0], np.cumsum(in_a + in_b)])
    ids, signs = np.zeros(total[-1], np.int64), np.zeros(total[-1], np.uint8)
    rank_a, rank_b = np.arange(len(a)) - (np.cumsum(in_a) - in_a)[group_a], np.arange(len(b)) - (np.cumsum(in_b) - in_b)[group_b]
    at_a, at_b = total[group_a] + rank_a, total[group_b] + in_a[group_b] + rank_b
    ids[at_a], ids[at_b] = a, b
    signs[at_a[rank_a == 0]], signs[at_b[rank_b == 0]] = ord(";"), ord("|")
    text, place = encoders.group_text(ids, signs)
    text, place = memoryview(text), place[np.concatenate([[0], np.cumsum(sums[0] + sums[1])])].tolist()
    for k in np.flatnonzero(sums[0]).tolist():
        d = docs[k]
        d.digest.update(text[place[k] + (d.n_groups == 0) : place[k + 1]])
        d.n_a, d.n_b, d.n_groups, d.n_links = (x + int(s[k]) for x, s in zip((d.n_a, d.n_b, d.n_groups, d.n_links), sums, strict=True))
        d.pairs.append((keys[bounds[k] : bounds[k + 1]], many[bounds[k] : bounds[k + 1]]))
        if len(d.pairs) > 64:
            d.linked()


def _stretches(texts: Iterator[bytes]) -> Iterator[tuple[list[int], bytes, list[int], int]]:
    """(documents, bytes, where each one's begin, documents that end here) of stretches of texts with the added space."""
    doc: list[int] = []
    held: list[bytes] = []
    cut: list[int] = []
    size = ended = 0
    for i, text in enumerate(texts):
        raw, at = b" " + text if text else b"", 0
        while len(raw) - at > STRETCH_BYTES:
            ends = unit_starts(np.frombuffer(raw, np.uint8)[at : at + STRETCH_BYTES + 1])
            if len(ends) < 2:  # a unit longer than a stretch
                ends = unit_starts(np.frombuffer(raw, np.uint8)[at:])
                if len(ends) < 2:
                    break
                ends = ends[:2]
            yield [*doc, i], b"".join([*held, raw[at : at + int(ends[-1])]]), [*cut, size], ended
            doc, held, cut, size, ended, at = [], [], [], 0, 0, at + int(ends[-1])
        if len(raw) > at:
            doc.append(i)
            held.append(raw[at:])
            cut.append(size)
            size += len(raw) - at
        ended += 1
        if size >= STRETCH_BYTES:
            yield doc, b"".join(held), cut, ended
            doc, held, cut, size, ended = [], [], [], 0, 0
    yield doc, b"".join(held), cut, ended


def aligned(texts: Iterator[bytes], encoders: Encoders) -> Iterator[Document]:
    """Each text's sweep, in order."""
    docs: dict[int, Document] = {}
    done = 0
    for mine, data, cut, ended in _stretches(texts):
        if mine:
            _sweep([docs.setdefault(i, Document()) for i in mine], encoders, np.frombuffer(data, np.uint8), np.array(cut))
        for i in range(done, done + ended):
            d = docs.pop(i, None) or Document()
            yield d if d.fits else Document()
        done += ended


def _bytes_of(column: pa.Array) -> Iterator[bytes]:
    return (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column)


SWEPT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_SWEPT = [(x.split()[0], pa.string() if "string" in x else pa.binary() if "binary" in x else pa.int64()) for x in SWEPT.split(", ")]


def _batch(columns: list[list], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])


def _documents_swept(paths: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = kept_by_worker(f"align:{paths}", lambda: Encoders(*paths))
        for batch in batches:
            out: list[list] = [[] for _ in _SWEPT]
            size = 0
            names = zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)
            for (row, name), d in zip(names, aligned(_bytes_of(batch.column("text")), encoders), strict=True):
                pairs, times = d.linked()
                text = d.digest.hexdigest() if d.n_a else ""
                values = (row, name, d.n_a, d.n_b, d.n_groups, d.n_links, text, pairs.astype("<u4").tobytes(), times.astype("<u4").tobytes())
                for column, x in zip(out, values, strict=True):
                    column.append(x)
                size += len(pairs)
                if size > 1 << 18:
                    yield _batch(out, _SWEPT)
                    out, size = [[] for _ in _SWEPT], 0
            if out[0]:
                yield _batch(out, _SWEPT)

    return run


def swept_texts(docs: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """Per document: tokens of both sides, groups, links, the groups' digest, its distinct linked pairs in order (A's id << 16 | B's,
    uint32) and how often each is linked; stored."""
    rows = documents(docs).withColumn("row", F.monotonically_increasing_id())
    return stored(rows.select("row", "doc_id", "text").mapInArrow(tidied(_documents_swept((bytes_path, pieces_path)), keeps=True), SWEPT), "swept")


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of uint32 arrays, and where each row's begin."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.copy().view("<u4").astype(np.int64), (at - at[0]) // 4


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of a task with the documents that hold them."""
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    fresh = most = 0

    def merged() -> None:
        nonlocal keys, counts, fresh, most
        k, n = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(k, kind="stable")
        k, n = k[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        keys, counts, fresh, most = [k[first]], [np.add.reduceat(n, first)], 0, len(first)

    for batch in batches:
        pairs, _ = _numbers(batch.column("pairs"))
        if len(pairs):
            k, n = np.unique(pairs, return_counts=True)
            keys.append(k)
            counts.append(n)
            fresh += len(k)
        if fresh > max(1 << 20, most):
            merged()
            if most > COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(counts[0])], ["pair", "docs"])
                keys, counts, most = [], [], 0
    if keys:
        merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(counts[0])], ["pair", "docs"])


def pair_counts(swept: DataFrame) -> DataFrame:
    """(pair, docs, best): each linked id pair with how many documents hold it and whether that is its A id's most; stored."""
    rows = swept.select("pairs").mapInArrow(tidied(_counted), "pair long, docs long")
    counts = stored(rows.groupBy("pair").agg(F.sum("docs").alias("docs")), "pairs")
    most = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("docs").alias("most"))  # at most a row for each of A's ids
    met = counts.join(F.broadcast(most), F.shiftright("pair", 16) == F.col("a"))
    return stored(met.select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "counts")


SCORED = "row long, n_best long, count_sum long, pairs array<long>, times array<long>"
_SCORED = [(x.split()[0], pa.list_(pa.int64()) if "array" in x else pa.int64()) for x in SCORED.split(", ")]


def _scored(sent: Broadcast):
    """Sums over the broadcast pairs; the other pairs go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, docs, best = (np.frombuffer(x, k) for x, k in zip(sent.value, ("<i8", "<i8", "?"), strict=True))
        table = HashTable()
        if len(pairs):
            table.add(mixed(pairs.astype(_U)), np.arange(len(pairs), dtype=np.int32))
        for batch in batches:
            mine, at = _numbers(batch.column("pairs"))
            times, _ = _numbers(batch.column("times"))
            place = table.find(mixed(mine.astype(_U)))
            met = place >= 0
            sums = []
            for worth in (times[met] * best[place[met]], times[met] * docs[place[met]]):
                upto = np.zeros(len(mine) + 1, np.int64)
                upto[1:][met] = worth
                upto = np.cumsum(upto)
                sums.append(upto[at[1:]] - upto[at[:-1]])
            left = np.concatenate([[0], np.cumsum(~met)])[at].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(left), pa.array(x[~met])) for x in (mine, times)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, sums), *lists], [n for n, _ in _SCORED])

    return run


def aligned_texts(docs: DataFrame, bytes_path: str, pieces_path: str, hot: int = HOT) -> DataFrame:
    """Per document: tokens of both sides, groups, links, links whose count is their A id's highest, the sum of all links' counts, the groups' digest.

    Null and empty texts, and those that either side does not give back byte for byte, have no tokens. Rows that repeat a doc_id, or
    have none, are documents each and counted each. A long text is swept stretch by stretch, a word longer than a stretch whole. Extra
    columns are ignored; an empty table gives no rows.
    """
    swept = swept_texts(docs, bytes_path, pieces_path)
    counts = pair_counts(swept)
    every = counts.agg(F.sum("docs")).first()[0] or 0
    # At most `hot` pairs can have more than one in `hot` of all rows: 17 bytes each.
    common = counts.where(F.col("docs") > max(1, every // hot)).toArrow()
    sent = docs.sparkSession.sparkContext.broadcast([common.column(c).to_numpy().astype(k).tobytes() for c, k in (("pair", "<i8"), ("docs", "<i8"), ("best", "?"))])
    scored = stored(swept.select("row", "pairs", "times").mapInArrow(tidied(_scored(sent)), SCORED), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    met = rare.join(counts.where(F.col("docs") <= max(1, every // hot)), "pair")
    parts = met.select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("docs")).alias("count_sum"))
    parts = parts.unionByName(scored.select("row", "n_best", "count_sum"))
    sums = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return swept.drop("pairs", "times").join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


GROUPS = "doc_id long, group long, a array<long>, b array<long>"


def _machine_over_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events by document and offset: the open group is all that is held."""
    at: tuple | None = None
    group, a, b, ends = 0, [], [], [False, False]
    out: list[tuple] = []

    def closed() -> None:
        nonlocal group, a, b
        out.append((at[0], group, a, b))
        group, a, b = group + 1, [], []

    for batch in batches:
        for doc, offset, side, token in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "side", "id")), strict=True):
            if at is not None and (doc, offset) != at:
                if all(ends):
                    closed()
                if doc != at[0]:
                    if a or b:
                        raise ValueError(f"the two sides of document {at[0]} end apart")
                    group = 0
                ends = [False, False]
            at = (doc, offset)
            (b if side else a).append(token)
            ends[side] = True
        if len(out) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _GROUP_KINDS, strict=True)], _GROUP_NAMES)
            out = []
    if at is not None and all(ends):
        closed()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _GROUP_KINDS, strict=True)], _GROUP_NAMES)


_GROUP_NAMES = [x.split()[0] for x in GROUPS.split(", ")]
_GROUP_KINDS = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def swept(a: DataFrame, b: DataFrame) -> DataFrame:
    """Groups of two event tables (doc_id, at, id): their union dealt by document, sorted by offset, streamed through the machine."""
    events = a.select("doc_id", "at", F.lit(0).alias("side"), "id").unionByName(b.select("doc_id", "at", F.lit(1).alias("side"), "id"))
    dealt = events.repartition("doc_id").sortWithinPartitions("doc_id", "at", "side")
    return dealt.mapInArrow(tidied(_machine_over_events), GROUPS)


def links(groups: DataFrame) -> DataFrame:
    """(doc_id, a, b, times): each document's linked id pairs and how often, counted before a group's pairs are made."""
    sides = [groups.select("doc_id", "group", F.explode(s).alias(s)).groupBy("doc_id", "group", s).agg(F.count("*").alias(f"n_{s}")) for s in ("a", "b")]
    return sides[0].join(sides[1], ["doc_id", "group"]).groupBy("doc_id", "a", "b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("times"))
