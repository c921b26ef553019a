"""Brown class-based bigram model: exchange clustering, class transitions and word emissions.

Words count exactly over all training texts. First, exchange parts units: the words of at least UNIT_SHARE of all tokens (so
at most 1 / UNIT_SHARE of them), each other word under a group of its ending, and the end of a text; the bound on units
bounds the bigram matrix that exchange works on, however large the corpus. Then each other word of at least MIN_COUNT
occurrences takes one exchange step of its own, from its contexts (the classes beside each occurrence), which are shuffled
by word: two bytes an occurrence. Rarer and unseen words stay with their ending's class. Transitions count over all
training texts with the words' final classes; within a class each word's own count gives its emission, smoothed by one
for every word and one unseen word.

    P(w | before) = P(class(w) | class(before)) * (count(w) + 1) / (tokens(class) + words(class) + 1)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.llm.common import documents, stored
from linework.llm.kernels import chunks, span_hashes, tidied, word_hashes

CLASSES = 64
ENDINGS = 512
#: Words at least this frequent are units of their own: 4000 at most.
UNIT_SHARE = 2.5e-4
#: Words of fewer occurrences keep their ending's class.
MIN_COUNT = 3
#: Counts and classes of words at least this frequent go to every worker: 500,000 words, 9 MB at most.
KNOWN_SHARE = 2e-6
SWEEPS = 12
#: Weight of the class unigram within a transition.
PRIOR = 50.0
#: Distinct keys that a task holds before it passes its sums on.
HELD = 1 << 20
#: Contexts of a word that one block of exchange steps holds, by 64 classes each.
STEP_ENTRIES = 1 << 14
#: Stands for a token whose class comes by the join.
OPEN = 255


def _key(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(1)).astype(np.int64)


def _chunk_words(data: np.ndarray, offsets: np.ndarray, shared: np.ndarray = np.zeros(0, np.int64)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, document, ending group, start and end of each word. Words whose key is among the shared ones have a key of the second hash."""
    h, doc, starts, ends = word_hashes(data, offsets)
    ending = (span_hashes(data, np.maximum(starts, ends - 3), ends) % np.uint64(ENDINGS)).astype(np.int64)
    key = _key(h)
    if len(shared):
        other = np.flatnonzero(np.isin(key, shared))
        key[other] = _key(span_hashes(data, starts[other], ends[other], lane=1))
    return key, doc, ending, starts, ends


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    u, inverse = np.unique(all_keys, return_inverse=True)
    return u, np.bincount(inverse, weights=all_counts, minlength=len(u)).astype(np.int64)


def _counted(shared: np.ndarray):
    """word, ending, n, and the least and greatest second hash of each key: they differ where words share a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0

        def merged(columns: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
            key, ending, n, low, high = columns
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
            return key[order][first], ending[order][first], np.add.reduceat(n[order], first), np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in merged(tuple(map(np.concatenate, zip(*parts, strict=True))))], ["word", "ending", "n", "low", "high"])

        for batch in batches:
            for _, data, offsets in chunks(batch.column("text")):
                key, _, ending, starts, ends = _chunk_words(data, offsets, shared)
                if not len(key):
                    continue
                second = span_hashes(data, starts, ends, lane=1).view(np.int64)
                parts.append(merged((key, ending, np.ones(len(key), np.int64), second, second)))
                held += len(parts[-1][0])
                if held > 2 * HELD:
                    yield flush()
                    parts, held = [], 0
        if parts:
            yield flush()

    return run


@dataclass
class Units:
    """Unit of each token: a frequent word, an ending group, or the end (the last)."""

    words: np.ndarray  # sorted keys of the frequent words
    shared: np.ndarray  # keys that several words hash to

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, document and ending group of each word of a chunk."""
        return _chunk_words(data, offsets, self.shared)[:3]

    @property
    def size(self) -> int:
        return len(self.words) + ENDINGS + 1

    def of(self, key: np.ndarray, ending: np.ndarray) -> np.ndarray:
        unit = len(self.words) + ending
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, key), len(self.words) - 1)
            unit = np.where(self.words[at] == key, at, unit)
        return unit

    def sequence(self, key: np.ndarray, doc: np.ndarray, ending: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Units of all documents of a chunk, each with an end after it, and each one's document."""
        counts = np.bincount(doc, minlength=docs)
        out = np.full(len(key) + docs, self.size - 1)
        owner = np.repeat(np.arange(docs), counts + 1)
        out[np.arange(len(key)) + doc] = self.of(key, ending)
        return out, owner

    def pairs(self, sequence: np.ndarray) -> np.ndarray:
        """Each unit with the one before; before a document's first is the end."""
        before = np.empty_like(sequence)
        before[:1], before[1:] = self.size - 1, sequence[:-1]
        return before * self.size + sequence


def _paired(units: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for _, data, offsets in chunks(batch.column("text")):
                sequence, _ = units.sequence(*units.read(data, offsets), len(offsets) - 1)
                u, n = np.unique(units.pairs(sequence), return_counts=True)
                keys.append(u), counts.append(n)
                held += len(u)
                if held > 2 * HELD:
                    u, n = _summed(keys, counts)
                    keys, counts, held = [u], [n], 0
                    if len(u) > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], ["pair", "n"])
                        keys, counts = [], []
        if keys:
            u, n = _summed(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], ["pair", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit: each in turn moves to where the class bigram likelihood gains most, until none moves.

    pairs[u, v] counts v after u. The last unit (the end) keeps a class of its own, the last. Ties take the lower class.
    """
    n = len(pairs)
    pairs = pairs.astype(np.float64)
    total = pairs.sum(0)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((np.arange(n), -total))] = np.arange(n)
    at = rank % (classes - 1)
    at[-1] = classes - 1
    one = np.zeros((n, classes))
    one[np.arange(n), at] = 1
    table = one.T @ pairs @ one
    turned = np.ascontiguousarray(pairs.T)
    order = np.argsort(rank)
    for _ in range(sweeps):
        moved = 0
        for u in order.tolist():
            if u == n - 1 or not total[u]:
                continue
            own = pairs[u, u]
            right = np.bincount(at, pairs[u], classes)
            left = np.bincount(at, turned[u], classes)
            old = at[u]
            right[old] -= own
            left[old] -= own
            table[old] -= right
            table[:, old] -= left
            table[old, old] -= own
            rows, cols = table.sum(1) + left, table.sum(0) + right  # whatever the move, the others' totals hold the word
            base = _xlogx(table)
            gain = (_xlogx(table + right) - base).sum(1) + (_xlogx(table + left[:, None]) - base).sum(0)
            diagonal = np.diagonal(table)
            gain += _xlogx(diagonal + right + left + own) - _xlogx(diagonal + right) - _xlogx(diagonal + left) + _xlogx(diagonal)
            gain -= _xlogx(rows + right.sum() + own) - _xlogx(rows) + _xlogx(cols + left.sum() + own) - _xlogx(cols)
            gain[-1] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            table[new] += right
            table[:, new] += left
            table[new, new] += own
            at[u] = new
            moved += new != old
        if not moved:
            break
    return at


def _side(table: np.ndarray, old: np.ndarray, here: np.ndarray, there: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Gain of each word (row) in each class over the entries (class, x) of table that its counts here[x] go to."""
    gain = np.zeros(here.shape)
    word, x = np.nonzero(here)
    if not len(word):
        return gain
    n, every = here[word, x], np.arange(len(word))
    rest = table.T[x]
    same = np.flatnonzero(x == old[word])
    rest[same] -= there[word[same]]
    rest[every, old[word]] -= n
    rest[same, x[same]] -= own[word[same]]
    first = np.flatnonzero(np.diff(word, prepend=-1))
    gain[word[first]] = np.add.reduceat(_xlogx(rest + n[:, None]) - _xlogx(rest), first)
    return gain


def exchange_step(table: np.ndarray, old: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Class that each word, all others in place, moves to by exchange's gain. Ties take the lower class.

    table counts class pairs with each word in its old class. A word has right[c] tokens of class c after it, left[c] before
    it and own times itself. The last class is the end's.
    """
    every = np.arange(len(old))
    own = own.astype(np.float64)
    rows, cols = np.repeat(table.sum(1)[None], len(old), 0), np.repeat(table.sum(0)[None], len(old), 0)
    to_right, to_left = right.sum(1) + own, left.sum(1) + own
    rows[every, old] -= to_right
    cols[every, old] -= to_left
    diagonal = np.repeat(np.diagonal(table)[None], len(old), 0)
    diagonal[every, old] -= right[every, old] + left[every, old] + own
    gain = _side(table, old, right, left, own) + _side(np.ascontiguousarray(table.T), old, left, right, own)
    gain += _xlogx(diagonal + right + left + own[:, None]) - _xlogx(diagonal + right) - _xlogx(diagonal + left) + _xlogx(diagonal)
    gain -= _xlogx(rows + to_right[:, None]) - _xlogx(rows) + _xlogx(cols + to_left[:, None]) - _xlogx(cols)
    gain[:, -1] = -np.inf
    new = np.argmax(gain, 1)
    return np.where(gain[every, new] > gain[every, old] + 1e-9, new, old)


def _contexts(units: Units, class_of: np.ndarray, classes: int):
    """word, ending and contexts of the words that are no units: for each occurrence the class before and after, the word itself as `classes`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, endings, beside, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            key, ending, codes = np.concatenate(keys), np.concatenate(endings), np.concatenate(beside)
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            offsets = (2 * np.append(first, len(key))).astype(np.int32)
            contexts = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(codes[order].tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(ending[order[first]]), contexts], ["word", "ending", "contexts"])

        for batch in batches:
            for _, data, offsets in chunks(batch.column("text")):
                key, doc, ending = units.read(data, offsets)
                sequence, _ = units.sequence(key, doc, ending, len(offsets) - 1)
                c = class_of[sequence].astype(np.uint16)
                at = np.arange(len(key)) + doc
                before, after = c[at - 1], c[at + 1]  # before the first is the last, an end
                again = np.flatnonzero((key[1:] == key[:-1]) & (doc[1:] == doc[:-1]))
                before[again + 1] = after[again] = classes
                other = np.flatnonzero(sequence[at] >= len(units.words))
                keys.append(key[other]), endings.append(ending[other]), beside.append(before[other] << 8 | after[other])
                held += len(other)
                if held > 2 * HELD:
                    yield flush()
                    keys, endings, beside, held = [], [], [], 0
        if held:
            yield flush()

    return run


def _assigned(table: np.ndarray, ending_class: np.ndarray, least: int):
    """word, ending, n and class of each word, from its contexts sorted by word."""
    classes = len(table)

    def block(owner: np.ndarray, codes: np.ndarray, old: np.ndarray) -> np.ndarray:
        left, right = (np.bincount(owner * (classes + 1) + c, minlength=len(old) * (classes + 1)).reshape(-1, classes + 1) for c in (codes >> 8, codes & 255))
        return exchange_step(table, old, right[:, :-1].astype(np.float64), left[:, :-1].astype(np.float64), right[:, -1])

    def batch_of(word: np.ndarray, ending: np.ndarray, contexts: pa.Array) -> pa.RecordBatch:
        sizes = pa.compute.binary_length(contexts).to_numpy() // 2
        codes = np.frombuffer(b"".join(contexts.to_pylist()), np.uint16).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        n = np.add.reduceat(sizes, first).astype(np.int64)
        new = ending_class[ending[first]]
        begin = np.concatenate([[0], np.cumsum(n)])
        moving = np.flatnonzero(n >= least)
        part = np.cumsum(np.minimum(2 * n[moving], 2 * classes)) // STEP_ENTRIES
        for some in np.split(moving, np.flatnonzero(np.diff(part)) + 1) if len(moving) else []:
            owner = np.repeat(np.arange(len(some)), n[some])
            at = np.arange(len(owner)) + np.repeat(begin[some] - np.concatenate([[0], np.cumsum(n[some])[:-1]]), n[some])
            new[some] = block(owner, codes[at], new[some])
        return pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(ending[first]), pa.array(n), pa.array(new.astype(np.int32))], ["word", "ending", "n", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            word = rows.column("word").to_numpy()
            last = int(np.searchsorted(word, word[-1]))  # the last word may go on in the next batch
            held = rows.slice(last)
            if last:
                yield batch_of(word[:last], rows.column("ending").to_numpy()[:last], rows.column("contexts").combine_chunks().slice(0, last))
        if held is not None:
            yield batch_of(held.column("word").to_numpy(), held.column("ending").to_numpy(), held.column("contexts").combine_chunks())

    return run


@dataclass
class Lexicon:
    units: Units
    class_of: np.ndarray  # class of each unit
    known: np.ndarray  # sorted keys of words whose counts and classes travel with the model
    known_class: np.ndarray
    known_log: np.ndarray  # log10 (count + 1)
    words: np.ndarray  # words of each class, the end as one
    tokens: int
    log_base: float  # log10 (N + V + 1)
    ends: int


@dataclass
class Model(Lexicon):
    log_next: np.ndarray  # log10 P(class | class before)
    log_room: np.ndarray  # log10 (tokens + words + 1) of each class


def clustered(texts: DataFrame, classes: int = CLASSES) -> tuple[Lexicon, DataFrame, DataFrame]:
    """Classes of all words of (doc_id, text), the exact word counts (word, ending, n, low, high), and (word, ending, n, class) of the words that are no units."""
    shared = np.zeros(0, np.int64)
    while True:
        counts = texts.select("text").mapInArrow(tidied(_counted(shared)), "word long, ending long, n long, low long, high long")
        counts = stored(counts.groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")), "word-counts")
        # Keys have 63 bits: a billion distinct words share none by any likelihood, 10 ** 11 some hundreds. Those words are keyed anew.
        found = counts.where("low <> high").select("word").toPandas()["word"].to_numpy(np.int64)
        if not len(found):
            break
        shared = np.concatenate([shared, found])
    ends = texts.count()
    n_words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, kinds = n_words + ends, distinct + (ends > 0)
    frequent = counts.where(F.col("n") >= UNIT_SHARE * tokens).select("word", "n").toPandas().sort_values("word")
    units = Units(frequent["word"].to_numpy(np.int64), np.sort(shared))

    found = texts.select("text").mapInArrow(tidied(_paired(units)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    pairs = np.zeros(units.size**2, np.float64)
    pairs[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    pairs = pairs.reshape(units.size, units.size)
    class_of = exchange(pairs, classes)
    one = np.zeros((units.size, classes))
    one[np.arange(units.size), class_of] = 1

    beside = texts.select("text").mapInArrow(tidied(_contexts(units, class_of, classes)), "word long, ending long, contexts binary")
    others = beside.repartition("word").sortWithinPartitions("word").mapInArrow(
        tidied(_assigned(one.T @ pairs @ one, class_of[len(units.words) : -1], MIN_COUNT)), "word long, ending long, n long, class int"
    )
    others = stored(others, "word-classes")
    known = others.where(F.col("n") >= KNOWN_SHARE * tokens).select("word", "n", "class").toPandas()
    keys = np.concatenate([units.words, known["word"].to_numpy(np.int64)])
    numbers = np.concatenate([frequent["n"].to_numpy(np.int64), known["n"].to_numpy(np.int64)])
    known_class = np.concatenate([class_of[: len(units.words)], known["class"].to_numpy(np.int64)])
    order = np.argsort(keys)

    per_class = others.groupBy("class").agg(F.count("*").alias("words")).toPandas()
    words = np.bincount(class_of[: len(units.words)], minlength=classes).astype(np.float64)
    words[per_class["class"].to_numpy(np.int64)] += per_class["words"].to_numpy(np.float64)
    words[-1] = 1
    lexicon = Lexicon(units, class_of, keys[order], known_class[order].astype(np.uint8), np.log10(numbers[order] + 1.0), words, tokens, float(np.log10(tokens + kinds + 1)), ends)
    return lexicon, counts, others


def _sequenced(lexicon: Lexicon):
    """Classes of each document's tokens, its end last. Words not at hand are OPEN: place has each one's index among the document's distinct ones, rare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = lexicon.units
        end_class = lexicon.class_of[-1]
        ending_class = lexicon.class_of[len(units.words) : -1].astype(np.uint8)
        for batch in batches:
            names = batch.column("doc_id")
            held = batch.column("held_out")
            for first, data, offsets in chunks(batch.column("text")):
                docs = len(offsets) - 1
                key, doc, ending = units.read(data, offsets)
                n = np.bincount(doc, minlength=docs)
                logs = np.full(docs, np.log10(lexicon.ends + 1.0))
                known = np.full(docs, int(lexicon.ends > 0))
                is_known = np.zeros(len(key), bool)
                c = np.full(len(key), OPEN, np.uint8)
                if len(lexicon.known) and len(key):
                    at = np.minimum(np.searchsorted(lexicon.known, key), len(lexicon.known) - 1)
                    is_known = lexicon.known[at] == key
                    c[is_known] = lexicon.known_class[at[is_known]]
                    logs += np.bincount(doc[is_known], lexicon.known_log[at[is_known]], docs)
                    known = known + np.bincount(doc[is_known], minlength=docs)
                out = np.full(len(key) + docs, end_class, np.uint8)
                out[np.arange(len(key)) + doc] = c

                rare, rare_doc = key[~is_known], doc[~is_known]
                order = np.lexsort((rare, rare_doc))
                kind, kind_doc = rare[order], rare_doc[order]
                new = np.ones(len(rare), bool)
                new[1:] = (kind[1:] != kind[:-1]) | (kind_doc[1:] != kind_doc[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(rare))).astype(np.int32)
                begin = np.concatenate([[0], np.cumsum(np.bincount(kind_doc[at], minlength=docs))]).astype(np.int32)
                place = np.empty(len(rare), np.int32)
                place[order] = np.cumsum(new) - 1
                place -= begin[rare_doc]
                lists = pa.array(begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        names.slice(first, docs), held.slice(first, docs), pa.array((n + 1).astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(logs),
                        _binary(out, n + 1), _binary(place, np.bincount(rare_doc, minlength=docs)), _binary(ending_class[ending[~is_known][order[at]]], np.diff(begin)),
                        pa.ListArray.from_arrays(lists, pa.array(kind[at])), pa.ListArray.from_arrays(lists, pa.array(times)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "known", "logs", "classes", "place", "by_ending", "rare", "times"],
                )

    return run


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive values as one binary for each size."""
    offsets = (values.itemsize * np.concatenate([[0], np.cumsum(sizes)])).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _flat(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of binaries, and the number in each."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype), pa.compute.binary_length(column).to_numpy() // np.dtype(dtype).itemsize


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences with each open token's class: the found one (index * 256 + class), else its ending's."""
    for batch in batches:
        c, sizes = _flat(batch.column("classes"), np.uint8)
        place, open_in = _flat(batch.column("place"), np.int32)
        kinds, kinds_in = _flat(batch.column("by_ending"), np.uint8)
        c, kinds = c.copy(), kinds.copy()
        base = np.concatenate([[0], np.cumsum(kinds_in)[:-1]]).astype(np.int64)
        lists = batch.column("found")
        found = lists.flatten().to_numpy()
        found_in = pa.compute.list_value_length(lists).fill_null(0).to_numpy()
        kinds[np.repeat(base, found_in) + (found >> 8)] = found & 255
        c[c == OPEN] = kinds[np.repeat(base, open_in) + place]
        kept = ["doc_id", "held_out", "n_tokens", "n_known", "logs"]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), _binary(c, sizes)], [*kept, "classes"])


def sequences(rows: DataFrame, lexicon: Lexicon, others: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, logs (of the counts, the end's too), classes (a byte a token) of rows (doc_id, text, held_out).

    Counts and classes of frequent words are at hand; those of the others come by a join on the word.
    """
    schema = "doc_id long, held_out boolean, n_tokens long, known long, logs double, classes binary, place binary, by_ending binary, rare array<long>, times array<int>"
    parts = stored(rows.mapInArrow(tidied(_sequenced(lexicon)), schema).withColumn("row", F.monotonically_increasing_id()), "sequenced")
    asked = parts.select("row", F.posexplode(F.arrays_zip("rare", "times")).alias("i", "x")).select("row", "i", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    rest = asked.join(others.where(F.col("n") < KNOWN_SHARE * lexicon.tokens).select("word", "n", "class"), "word").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"), F.sum("times").alias("more_known"),
        F.collect_list(F.col("i").cast("long") * 256 + F.col("class")).alias("found"),
    )
    joined = parts.drop("rare", "times").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0))).alias("logs"), "classes", "place", "by_ending", "found",
    )
    return stored(joined.mapInArrow(tidied(_resolved), "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, classes binary"), "sequences")


def _before(c: np.ndarray, end: int) -> np.ndarray:
    """Class before each token; before a document's first is the end."""
    return np.concatenate([[end], c[:-1]])[: len(c)].astype(np.int64)


def _class_pairs(classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes**2, np.int64)
        for batch in batches:
            c, _ = _flat(batch.column("classes"), np.uint8)
            total += np.bincount(_before(c, classes - 1) * classes + c, minlength=classes**2)
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(total[pair])], ["pair", "n"])

    return run


def fitted(lexicon: Lexicon, training: DataFrame, classes: int = CLASSES) -> Model:
    """The model whose transitions count over the sequences of all training texts."""
    found = training.select("classes").mapInArrow(tidied(_class_pairs(classes)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(classes**2)
    table[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    table = table.reshape(classes, classes)
    share = (table.sum(0) + 1) / (table.sum() + classes)
    log_next = np.log10((table + PRIOR * share) / (table.sum(1, keepdims=True) + PRIOR))
    return Model(**vars(lexicon), log_next=log_next, log_room=np.log10(table.sum(0) + lexicon.words + 1))


def train(texts: DataFrame, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """The model of all texts of (doc_id, text), and the table of exact word counts (word, ending, n, low, high)."""
    lexicon, counts, others = clustered(texts, classes)
    return fitted(lexicon, sequences(texts.withColumn("held_out", F.lit(False)), lexicon, others), classes), counts


def _scored(log_next: np.ndarray, log_room: np.ndarray, log_end: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = len(log_room) - 1
        for batch in batches:
            c, sizes = _flat(batch.column("classes"), np.uint8)
            path = log_next[_before(c, end), c] - log_room[c]
            path[c == end] += log_room[-1]  # the end has its class to itself: its emission is 1
            total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), path, len(sizes))
            kept = ["doc_id", "held_out", "n_tokens", "n_known", "logs"]
            logs = batch.column("logs").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(logs - log_end + total)], [*kept, "score"])

    return run


def score(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of sequences()."""
    run = tidied(_scored(model.log_next, model.log_room, float(np.log10(model.ends + 1.0))))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(model.log_base)).alias("base_score"), "score",
    )


def class_bigram_scores(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id as text) mod folds is not held.

    Null and empty texts are an end alone. With no training text every count is 0 and classes are even. Extra columns are
    ignored; rows that repeat a doc_id are scored each, and those of null doc_id are in the training part; words of any
    length count whole, and words that share a key are keyed anew; ties of classes take the lower one; an empty table gives no rows.
    """
    rows = documents(docs).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False)))
    lexicon, _, others = clustered(rows.where(~F.col("held_out")).select("doc_id", "text"))
    placed = sequences(rows, lexicon, others)
    return score(placed, fitted(lexicon, placed.where(~F.col("held_out"))))
