"""Dictionary correction: each word's nearest term within two edits, swaps of neighbours among them.

A dictionary of a checked size becomes a word graph that every task walks with its words, many at once: a word and a path
stay together as long as the bounded distance of what was read may still come down to two. Of two edits at most one lies in the
word's first half or at most one in its second, so walks begin at either end and may spend one edit on that half. A larger dictionary is joined by
delete neighbourhoods: a word and a near term share a string that each becomes by at most two deletions in its first
characters. Words are corrected once each, however often they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.config import CONFIG
from linework.functions.text import BLANK, PLACEHOLDER, WORD_PARTS, clean_noise, split_words
from linework.storage import stored

P = CONFIG.postprocessing
#: Characters that words are spread by. Any number finds all pairs; more make fewer pairs that are not near, but more strings.
PREFIX = 10


def alignment_distance(a: str, b: str, most: int) -> int:
    """Edits and swaps of neighbours that turn a into b, no part edited twice; most + 1 where it takes more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most and min(last) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def deletions(word: Column, most: int = P.max_edit_distance, prefix: int = P.prefix) -> Column:
    """Distinct strings that the word's prefix becomes by at most `most` deletions."""
    head = F.substring(word, 1, prefix)

    def without_one(w: Column) -> Column:
        return F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))

    out = level = F.array(head)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, without_one)))
        out = F.array_union(out, level)
    return out


def _distance(most: int):
    @F.pandas_udf("int")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b, plain, swapped in batches:
            yield pd.Series([alignment_distance(x, y, most) if s else d for x, y, d, s in zip(a, b, plain, swapped, strict=True)], dtype="int32")

    return run


class Beginnings:
    """Terms as a graph of their beginnings, level by level: nodes of one depth, each with its children's places in the next.

    A node knows the term that ends in it and the lengths of those that pass through it.
    """

    def __init__(self, terms: pa.Array):
        order = pc.sort_indices(terms).to_numpy().astype(np.int32)
        ordered = terms.take(pa.array(order))
        sizes = pc.utf8_length(ordered).to_numpy().astype(np.int32)
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        signs = np.frombuffer("".join(ordered.to_pylist()).encode("utf-32-le"), "<i4")
        self.deepest = int(sizes.max(initial=0))
        self.levels: list[tuple[np.ndarray, ...]] = []  # sign, term, shortest, longest, first child, children
        some, node, parents = np.arange(len(sizes)), np.zeros(len(sizes), np.int64), 1  # terms of this depth, and their nodes of the level before
        for depth in range(self.deepest):
            deep = sizes[some] > depth
            some, node = some[deep], node[deep]
            sign = signs[starts[some] + depth]
            new = np.concatenate([[True], (node[1:] != node[:-1]) | (sign[1:] != sign[:-1])])
            mine, first = np.cumsum(new) - 1, np.flatnonzero(new)
            children = np.bincount(node[first], minlength=parents).astype(np.int32)
            below = (np.cumsum(children, dtype=np.int32) - children, children)
            if self.levels:
                self.levels[-1] = (*self.levels[-1], *below)
            else:
                self.root = below
            term = np.full(len(first), -1, np.int32)
            ends = sizes[some] == depth + 1
            term[mine[ends]] = order[some[ends]]
            self.levels.append((sign[first], term, np.minimum.reduceat(sizes[some], first), np.maximum.reduceat(sizes[some], first)))
            node, parents = mine, len(first)
        if self.levels:
            self.levels[-1] = (*self.levels[-1], np.zeros(parents, np.int32), np.zeros(parents, np.int32))

    def within(self, words: list[str], most: int, heads: np.ndarray, half: int) -> list[tuple[np.ndarray, ...]]:
        """(word, distance, term) of pairs of at most `most` edits, all those among them that spend at most `half` on the word's first `heads` signs."""
        sizes = np.array([len(w) for w in words], np.int32)
        far, width = most + 1, 2 * most + 1
        stride = int(sizes.max()) + 2 * width
        padded = np.full((len(words), stride), -1, np.int32)  # by `width` on both sides
        padded[:, width:][np.arange(stride - width) < sizes[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), "<i4")
        signs = padded.ravel()
        row = np.arange(len(words), dtype=np.int32)
        place = np.zeros(len(words), np.int32)
        # The distances of what was read of the word, up to `most` signs fewer or more than the path has, from the path; and those one sign before.
        reads = np.arange(-most, most + 1)[:, None]
        band = np.where((reads < 0) | (reads > sizes), far, reads).astype(np.int8)
        before, last = np.full(band.shape, far, np.int8), np.full(len(words), -2, np.int32)
        least, passed = np.zeros(len(words), np.int8), heads <= half  # whether the head is behind, and cost no more
        found: list[tuple[np.ndarray, ...]] = []
        begin, children = self.root
        for depth, (sign, term, shortest, longest, next_begin, next_children) in enumerate(self.levels, 1):
            n = children[place].astype(np.int64)
            until = np.cumsum(n)
            child = np.repeat(begin[place] - (until - n), n) + np.arange(int(until[-1]) if len(until) else 0)
            back = np.repeat(np.arange(len(row)), n)
            mine = row[back]
            m, c = sizes[mine], sign[child]
            at = mine.astype(np.int64) * stride + (depth - most + width - 2)
            window = [signs[at + k] for k in range(width + 1)]  # signs of the word: the last two that k of the band has read are k and k + 1
            same = [x == c for x in window]
            # A path that has spent all it may goes on by an equal sign alone, or a swap, which has one at its end's neighbour.
            go = (shortest[child] <= m + most) & (longest[child] >= m - most) & ((least[back] < np.where(passed[back], most, half)) | np.logical_or.reduce(same))
            if not go.any():
                break
            child, back, mine, m, c = child[go], back[go], mine[go], m[go], c[go]
            window, same = [x[go] for x in window], [x[go] for x in same]
            old, older, previous = band[:, back], before[:, back], last[back]
            new = np.full(old.shape, far, np.int8)
            for k in range(width):
                i = depth + k - most
                if i <= 0:
                    new[k] = min(depth, far) if i == 0 else far
                    continue
                d = old[k] + ~same[k + 1]
                if k + 1 < width:
                    d = np.minimum(d, old[k + 1] + 1)
                if k:
                    d = np.minimum(d, new[k - 1] + 1)
                swap = (window[k + 1] == previous) & same[k]
                d = np.where(swap, np.minimum(d, older[k] + 1), d)
                new[k] = np.where(i <= m, np.minimum(d, far), far)
            ends = np.flatnonzero((term[child] >= 0) & (np.abs(m - depth) <= most))
            d = new[m[ends] - depth + most, ends]
            good = d <= most
            found.append((mine[ends[good]].astype(np.int64), d[good].astype(np.int64), term[child[ends[good]]].astype(np.int64)))
            least, least_old, head = new.min(0), least[back], heads[mine]
            k = head - depth + most
            behind = passed[back] | ((k >= 0) & (k < width) & (new[np.clip(k, 0, width - 1), np.arange(len(k))] <= half))
            alive = ((least <= most) | (least_old < most)) & (behind | ((depth < head + half) & ((least <= half) | (least_old < half))))
            row, place, band, before, last, passed = mine[alive], child[alive].astype(np.int32), new[:, alive], old[:, alive], c[alive], behind[alive]
            least = least[alive]
            begin, children = next_begin, next_children
        return found


class WordGraph:
    """Terms to be walked from either end."""

    def __init__(self, terms: list[str] | pa.Array, counts: np.ndarray):
        terms = pa.array(terms, pa.string())
        order = pc.sort_indices(terms)
        self.terms, self.counts = terms.take(order), counts[order.to_numpy()]
        self.forward, self.backward = Beginnings(self.terms), Beginnings(pc.utf8_reverse(self.terms))

    def nearest(self, words: list[str], most: int) -> list[tuple[str, str, int]]:
        """(word, term, distance) of words that have a term within `most` edits: the most frequent on ties, then the first."""
        words = [w for w in words if len(w) <= self.forward.deepest + most]
        if not words or not len(self.terms):
            return []
        sizes = np.array([len(w) for w in words], np.int64)
        # A swap of the halves' neighbours is an edit of each of them.
        half = (most + 1) // 2
        found = self.forward.within(words, most, sizes // 2, half)
        if half < most:
            found += self.backward.within([w[::-1] for w in words], most, sizes - sizes // 2, half)
        if not found:
            return []
        word, distance, which = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((which, -self.counts[which], distance, word))
        word, distance, which = word[order], distance[order], which[order]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else word
        terms = self.terms.take(pa.array(which[first])).to_pylist()
        return [(words[w], t, d) for w, t, d in zip(word[first].tolist(), terms, distance[first].tolist(), strict=True)]


#: Bytes of a dictionary's terms up to which it is sent to all tasks, and words that walk its graph at once.
GRAPH_BYTES, WALKERS = 32 << 20, 512


def _walked(sent: Broadcast, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = sent.value  # a worker's tasks share it, and the graph that the first of them makes
            if "graph" not in held:
                held["graph"] = WordGraph(held.pop("terms"), held.pop("counts"))
            words = batch["word"].tolist()
            for at in range(0, len(words), WALKERS):
                left = words[at : at + WALKERS]
                for reach in range(1, most + 1):  # a nearer term settles a word, and a short walk costs little
                    found = held["graph"].nearest(left, reach)
                    yield pd.DataFrame(found, columns=["word", "term", "distance"]).astype({"distance": "int32"})
                    left = sorted(set(left) - {w for w, _, _ in found})

    return run


def closest_terms(words: DataFrame, dictionary: DataFrame, most: int = P.max_edit_distance, limit: int = GRAPH_BYTES) -> DataFrame:
    """(word, term, distance): each distinct word's nearest term of (term, count), the most frequent on ties, then the first.

    Words of the dictionary are their own term. Words with no term in reach have no row. A dictionary of over `limit` bytes is joined.
    """
    dictionary, size = _measured(dictionary)
    words = words.select("word").where("word is not null and word <> ''").distinct()
    known = stored(words.join(dictionary.select("term"), F.col("word") == F.col("term"), "left"), "words")
    exact = known.where("term is not null").select("word", "term", F.lit(0).alias("distance"))
    return _nearest(known.where("term is null").select("word"), dictionary, most, size <= limit).unionByName(exact)


def _measured(dictionary: DataFrame) -> tuple[DataFrame, int]:
    """The dictionary, stored, and the bytes of its terms."""
    dictionary = stored(dictionary.select("term", F.col("count").cast("long").alias("count")).where("term <> ''"), "terms")
    return dictionary, dictionary.agg(F.coalesce(F.sum(F.octet_length("term") + 8), F.lit(0))).first()[0]


def _nearest(words: DataFrame, dictionary: DataFrame, most: int, walk: bool) -> DataFrame:
    """closest_terms() of distinct words without a term of their own."""
    if not walk:
        return _by_join(words, dictionary, most)
    listed = dictionary.toArrow()
    sent = words.sparkSession.sparkContext.broadcast({"terms": listed.column("term").combine_chunks(), "counts": listed.column("count").to_numpy()})
    # Few bytes but much work: a set number of partitions keeps adaptive execution from merging them into one.
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = words.repartition(max(n, 2 * words.sparkSession.sparkContext.defaultParallelism), "word")
    return left.mapInPandas(_walked(sent, most), "word string, term string, distance int")


def _by_join(words: DataFrame, dictionary: DataFrame, most: int) -> DataFrame:
    """closest_terms() of words without a term of their own, by delete neighbourhoods."""
    letters = lambda c: F.array_join(F.sort_array(F.split(c, "")), "")
    left = words.select("word", F.explode(deletions(F.col("word"), most, PREFIX)).alias("key"))
    right = dictionary.select("term", F.explode(deletions(F.col("term"), most, PREFIX)).alias("key"))
    # Few bytes but much work: a set number of partitions keeps adaptive execution from merging them into one.
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = left.repartition(n, "key").join(right.repartition(n, "key"), "key").where(F.abs(F.length("word") - F.length("term")) <= most).select("word", "term").distinct()
    met = pairs.withColumn("d", F.levenshtein("word", "term", 2 * most)).where("d >= 0").withColumns({"letters": letters("word"), "own": letters("term")})
    # A swap is two plain edits and keeps the letters, any other edit changes two of them at most: with an even number of
    # plain edits all can be swaps, with an odd one all but one. Only such pairs can be nearer than plain edits say, and
    # only for those is the exact distance computed.
    others = F.when(F.col("d") > most, 2 * most - F.col("d")).otherwise(F.greatest(F.col("d") - 2, F.lit(0)))
    swapped = (F.col("d") > 1) & (F.levenshtein("letters", "own") <= 2 * others)
    met = met.withColumn("swapped", swapped).where((F.col("d") <= most) | F.col("swapped")).select("word", "term", "d", "swapped")
    near = met.withColumn("distance", _distance(most)("word", "term", "d", "swapped")).where(F.col("distance") <= most).join(dictionary, "term")
    best = near.groupBy("word").agg(F.min(F.struct("distance", (-F.col("count")).alias("c"), "term")).alias("b"))
    return best.select("word", "b.term", "b.distance")


def corrected(lines: DataFrame, dictionary: DataFrame, whitelist: list[str] | None = None, *keys: str) -> DataFrame:
    """lines with corrected_text: noise cleaned, words corrected, placeholders as they are.

    A line's words stay in its row. Only those that the dictionary lacks move, each once a line, and come back as a map of the line;
    lines of equal keys are told apart by their text.
    """
    keys = keys or ("doc_id", "line_index")
    listed = F.array(*map(F.lit, [w.lower() for w in whitelist])) if whitelist else None
    dictionary, size = _measured(dictionary)
    # Placeholders lie between the parts that the split leaves: part 0, mark 0, part 1, ...
    parts = F.split("raw_text", PLACEHOLDER, -1)
    marks = F.regexp_extract_all("raw_text", F.lit(PLACEHOLDER), 0)
    plain = lambda p: F.transform(split_words(clean_noise(p)), lambda w: F.struct(w.alias("w"), F.regexp_extract(w, WORD_PARTS, 2).alias("core")))
    mark = lambda i: F.when(i < F.size(marks), F.array(F.struct(F.get(marks, i).alias("w"), F.lit("").alias("core")))).otherwise(F.array().cast("array<struct<w:string,core:string>>"))
    items = F.flatten(F.transform(parts, lambda p, i: F.concat(plain(p), mark(i))))
    # A core is of ASCII's letters and apostrophes, so its first byte tells whether it is capitalised.
    plainly = lambda c: (F.octet_length(c) >= 3) & ~((c >= "A") & (c < "["))
    asked = lambda x: plainly(x["core"]) if listed is None else plainly(x["core"]) & ~F.array_contains(listed, F.lower(x["core"]))
    named = [F.col(k).alias(f"_{n}") for n, k in enumerate(keys)]
    line = [f"_{n}" for n in range(len(keys))]
    words = lines.select(*named, F.xxhash64("raw_text").alias("_text"), F.explode(F.array_distinct(F.transform(F.filter(items, asked), lambda x: F.lower(x["core"])))).alias("word"))
    walk, terms = size <= GRAPH_BYTES, dictionary.select("term")
    unknown = stored(words.join(F.broadcast(terms) if walk else terms, F.col("word") == F.col("term"), "left_anti"), "unknown")
    found = _nearest(stored(unknown.select("word").distinct(), "words"), dictionary, P.max_edit_distance, walk)
    given = unknown.join(found, "word", "left").groupBy(*line, "_text").agg(F.map_from_entries(F.collect_set(F.struct("word", "term"))).alias("_given"))
    same = F.col("_key") == F.col("_text")
    for n, k in enumerate(keys):
        same = same & lines[k].eqNullSafe(F.col(f"_{n}"))
    # The maps are the small side, and lines are not sorted for them.
    met = lines.withColumn("_key", F.xxhash64("raw_text")).join(given.hint("shuffle_hash"), same, "left")

    def word(x: Column) -> Column:
        key = F.lower(x["core"])
        new = F.when(F.coalesce(F.map_contains_key("_given", key), F.lit(False)), F.coalesce(F.element_at("_given", key), x["core"])).otherwise(key)
        whole = F.concat(F.regexp_extract(x["w"], WORD_PARTS, 1), new, F.regexp_extract(x["w"], WORD_PARTS, 3))
        return F.when(asked(x), F.when(new == x["core"], x["w"]).otherwise(whole)).otherwise(x["w"])

    return met.select(*[lines[c] for c in lines.columns], F.coalesce(F.array_join(F.transform(items, word), " "), F.lit("")).alias("corrected_text"))


def word_counts(lines: DataFrame, text: str = "raw_text") -> DataFrame:
    """(term, count) of the lower-case words of letters in lines: a dictionary of one's own."""
    words = lines.select(F.explode(F.split(F.lower(text), rf"{BLANK}+")).alias("term"))
    return words.where(F.col("term").rlike("^[a-z']+$")).groupBy("term").agg(F.count("*").alias("count"))
