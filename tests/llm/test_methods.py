"""Each method against a plain version of itself: packing, voting, class scores, broken media, long texts in parts."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from linework.llm import brown_lm, gif, knn_quality, packing, suffix_dedup


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def greedy(lengths, capacity):
    """Bins of the same filling without replacement."""
    left, bins = sorted(lengths), 0
    while left:
        gap, bins = capacity, bins + 1
        while fits := [x for x in left if x <= gap]:
            gap -= fits[-1]
            left.remove(fits[-1])
    return bins


def test_two_pieces_for_the_smallest_save_a_bin():
    lengths = np.array([6, 6, 6, 3, 3, 3, 2, 2, 2, 2, 2, 2])
    bins, offsets = packing.best_two_fit(lengths, 10)
    assert greedy(lengths.tolist(), 10) == 5 and len(set(bins.tolist())) == 4
    shapes = sorted(sorted(lengths[bins == b].tolist()) for b in set(bins.tolist()))
    assert shapes == [[2, 2, 6], [2, 2, 6], [2, 2, 6], [3, 3, 3]]
    for b in set(bins.tolist()):
        order = np.argsort(offsets[bins == b])
        assert (np.cumsum(lengths[bins == b][order]) - lengths[bins == b][order] == offsets[bins == b][order]).all()


def plain_two_fit(lengths, capacity):
    """The method as it is said, by lists: fill with the longest that fits; then two unpacked ones for the smallest, as tight as can be."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        inside, gap = [], capacity
        while True:
            while fits := [x for x in left if x <= gap]:
                inside.append(fits[0])
                left.remove(fits[0])
                gap -= fits[0]
            if not gap or not left:
                break
            small = min(inside)
            pairs = [(a + b, max(a, b)) for i, a in enumerate(left) for b in left[i + 1 :] if small < a + b <= gap + small]
            if not pairs:
                break
            total, a = max(pairs)
            inside.remove(small)
            for x in (a, total - a):
                inside.append(x)
                left.remove(x)
            left = sorted([*left, small], reverse=True)
            gap += small - total
        out.append(sorted(inside))
    return sorted(out)


@pytest.mark.parametrize("seed", range(12))
def test_best_two_fit_equals_plain_lists(seed):
    rng = random.Random(seed)
    lengths = np.array([rng.randrange(1, rng.choice((12, 30, 51))) for _ in range(60)])
    bins, _ = packing.best_two_fit(lengths, 50)
    assert sorted(sorted(lengths[bins == b].tolist()) for b in set(bins.tolist())) == plain_two_fit(lengths.tolist(), 50)


def test_votes_of_the_whole_query_equal_plain_loops(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) + rng.choice(("", "", ".", "!!", "##")) * (i % 3) for _ in range(rng.randrange(1, 30))) for i in range(60)] + ["", None]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 60, 2)] + [(i, (i // 3) % 2) for i in range(1, 60, 6)], "doc_id long, quality int")
    docs = table(spark, texts)
    voter = knn_quality.train(docs, labels)
    found = {r["doc_id"]: r["score"] for r in knn_quality.scores(docs, labels).collect()}
    for i, text in enumerate(texts):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        v = voter.project(knn_quality.term_counts(raw, np.array([0, len(raw)])))[0]
        cosines = sorted(((float(v @ w), float(y)) for w, y in zip(voter.vectors, voter.labels, strict=True)), reverse=True)
        near = cosines[: knn_quality.NEIGHBOURS]
        total = sum(max(c, 0.0) for c, _ in near)
        want = sum(max(c, 0.0) * y for c, y in near) / total if total > 1e-9 else voter.prior
        tied = len(cosines) > len(near) and abs(cosines[len(near)][0] - near[-1][0]) < 1e-6
        assert tied or abs(found[i] - want) < 1e-4, (i, found[i], want)


def test_class_scores_equal_plain_counts(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(words, weights=range(30, 0, -1), k=rng.randrange(12))) for _ in range(80)] + ["never seen words", "", None]
    docs = table(spark, texts)
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    training = [texts[i] or "" for i in range(len(texts)) if not held[i]]
    lexicon, _, others = brown_lm.clustered(table(spark, training))
    classes, end = brown_lm.CLASSES, brown_lm.CLASSES - 1
    moved = {r["word"]: r["class"] for r in others.collect()}

    def class_of(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        key, _, ending, _, _ = brown_lm._chunk_words(raw, np.array([0, len(raw)]))
        unit = int(lexicon.units.of(key, ending)[0])
        return int(lexicon.class_of[unit]) if unit < len(lexicon.units.words) else moved.get(int(key[0]), int(lexicon.class_of[unit]))

    counts, pairs, in_class = {}, np.zeros((classes, classes)), [set() for _ in range(classes)]
    for text in training:
        before = end
        for w in text.split():
            c = class_of(w)
            counts[w] = counts.get(w, 0) + 1
            in_class[c].add(w)
            pairs[before, c] += 1
            before = c
        pairs[before, end] += 1
    tokens = pairs.sum(0)
    share = (tokens + 1) / (tokens.sum() + classes)
    following = (pairs + brown_lm.PRIOR * share) / (pairs.sum(1, keepdims=True) + brown_lm.PRIOR)
    n, v = int(tokens.sum()), len(counts) + 1
    for r in brown_lm.class_bigram_scores(docs).collect():
        before, score, base = end, 0.0, 0.0
        for w in (texts[r["doc_id"]] or "").split():
            c = class_of(w)
            score += math.log10(following[before, c]) + math.log10((counts.get(w, 0) + 1) / (tokens[c] + len(in_class[c]) + 1))
            base += math.log10((counts.get(w, 0) + 1) / (n + v + 1))
            before = c
        score += math.log10(following[before, end])
        base += math.log10((len(training) + 1) / (n + v + 1))
        assert abs(r["score"] - score) < 1e-6 and r["train_tokens"] == n and r["held_out"] == held[r["doc_id"]]
        assert abs(r["base_score"] - base) < 1e-6 * max(1, r["n_tokens"])


def test_every_cut_of_a_file_raises():
    media = gif.encode(gif.payload("some text of a few words " * 30), rows=8)
    whole = list(gif.decode(media))
    assert len(whole) == 2
    for n in range(len(media)):
        with pytest.raises(gif.GifError):
            list(gif.decode(media[:n]))


def test_headers_of_great_size_ask_for_no_memory():
    media = gif.encode(gif.payload("x"))
    great = media[:6] + b"\xff\xff\xff\xff" + media[10:]
    with pytest.raises(gif.GifError, match="screen"):
        list(gif.decode(great))
    at = media.index(b"\x2c", 13 + 768 + 8)
    wide = media[: at + 5] + b"\xff\xff\xff\xff" + media[at + 9 :]
    with pytest.raises(gif.GifError, match="cut off"):
        list(gif.decode(wide))


def test_frames_come_in_batches(spark, monkeypatch):
    media = gif.encode(gif.payload("word " * 900), rows=4)
    rows = gif.frames(spark.createDataFrame([(1, media), (2, None), (1, media)], "doc_id long, media binary")).collect()
    each = len(list(gif.decode(media)))
    assert len(rows) == 2 * each and rows[1]["at_ms"] == rows[0]["delay_ms"]


def test_long_texts_have_the_same_anchors_in_parts(monkeypatch):
    rng = np.random.default_rng(5)
    text = "".join(map(chr, rng.integers(97, 105, 6000)))

    def starts():
        columns = {"doc_id": pa.array([1]), "text_key": pa.array([2]), "text": pa.array([text])}
        out = {}
        for b in suffix_dedup._anchors(iter([pa.RecordBatch.from_pydict(columns)])):
            for r in b.to_pylist():
                out.update({s: r["anchor"] for s in range(r["lo"], r["hi"])})
        return out

    whole = starts()
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 1000)
    assert len(whole) == 6000 - 199 and starts() == whole
