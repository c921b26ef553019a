"""The training-data operators against brute force, round trips and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linework.llm import brown_lm, chat_format, gif, knn_quality, lsm_dedup, packing, pii_weak, suffix_dedup, wfst_pieces
from linework.llm.kernels import chunks
from linework.llm.queries import PIECE_MODEL, SPACE_TOKENIZER, tokenizer_path

ODD = [None, "", " ", "\t\n", "a", "été — naïve 日本語 🤖", "x" * 5000, "same text", "same  text", "same text"]


def table(spark, texts, extra=True):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df.withColumns({"stretch": F.lit(1), "digest": F.lit("x"), "score": F.lit(2)}) if extra else df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# GIF


@pytest.mark.parametrize("n", [64, 128, 64 * 255, 64 * 256, 64 * 700])
def test_gif_round_trip(n):
    rng = np.random.default_rng(n)
    for samples in (bytes(n), rng.integers(0, 256, n, dtype=np.uint8).tobytes(), (b"abab" * n)[:n]):
        frames = list(gif.decode(gif.encode(samples)))
        assert b"".join(f.indices.tobytes() for f in frames) == samples
        assert all(gif.histogram(f.screen).sum() == 3 * 64 * f.indices.shape[0] for f in frames) or len(frames) > 1


def block(indices, left, top, palette=None, disposal=0, transparent=None, interlace=False, size=2):
    h, w = len(indices), len(indices[0])
    rows = [indices[i] for i in gif._row_order(h)] if interlace else indices
    flag = (disposal << 2) | (transparent is not None)
    local = (0x80 | (size - 1)) if palette else 0
    head = bytes([0x21, 0xF9, 4, flag, 7, 0, transparent or 0, 0, 0x2C, left, 0, top, 0, w, 0, h, 0, local | (0x40 if interlace else 0)])
    return head + (bytes(sum(palette, [])) if palette else b"") + bytes([size]) + gif._blocks(gif.lzw_encode(bytes(sum(rows, [])), size))


def test_gif_disposal_transparency_palettes_interlace():
    red, green, blue, white = [255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255]
    shared = [red, green, blue, white]
    data = b"GIF89a" + bytes([4, 0, 4, 0, 0x81, 0, 0]) + bytes(sum(shared, []))
    data += block([[0] * 4] * 4, 0, 0, disposal=1)
    data += block([[1, 3], [3, 1]], 1, 1, disposal=2, transparent=3)
    data += block([[2]], 0, 0, disposal=3)
    data += block([[0], [1], [2], [3]], 3, 0, palette=[white, blue, green, red], interlace=True)
    frames = list(gif.decode(data + b";"))
    assert [f.delay for f in frames] == [7] * 4 and [f.disposal for f in frames] == [1, 2, 3, 0]
    one, two, three, four = (f.screen for f in frames)
    assert (one[..., :3] == red).all()
    assert two[1, 1, :3].tolist() == green and two[1, 2, :3].tolist() == red  # transparent shows what lies below
    assert three[1, 1].tolist() == [0, 0, 0, 0] and three[0, 0, :3].tolist() == blue  # the second frame is cleared
    assert four[0, 0, :3].tolist() == red  # the third is taken back
    assert four[:, 3, :3].tolist() == [white, blue, green, red]


def test_gif_deferred_clear_and_short_streams():
    """A full table without a clear code goes on with 12 bits; cut streams leave zeros."""
    rng = np.random.default_rng(1)
    samples = rng.integers(0, 4, 60_000).tolist()
    table, codes, free, code = {}, [4], 6, samples[0]
    for x in samples[1:]:
        if (code, x) in table:
            code = table[code, x]
            continue
        codes.append(code)
        if free < 4096:
            table[code, x] = free
            free += 1
        code = x
    codes += [code, 5]
    bits, n, made = 0, 0, 0
    for k, c in enumerate(codes):
        width = 3 if k == 0 else min(12, max(3, (min(4095, 6 + max(0, k - 2))).bit_length()))
        bits |= c << n
        n += width
        made += 1
    stream = bits.to_bytes((n + 7) // 8, "little")
    assert gif.lzw_decode(stream, 2, len(samples)).tolist() == samples
    assert gif.lzw_decode(stream[:100], 2, len(samples))[-1] == 0
    with pytest.raises(gif.GifError):
        list(gif.decode(b"PNG"))


def test_gif_query(spark):
    found = {r["doc_id"]: r for r in gif.text_media(table(spark, ODD)).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        r = found[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert found[7]["media_sha256"] == found[9]["media_sha256"] != found[8]["media_sha256"]
    assert gif.text_media(empty(spark)).count() == 0
    timed = gif.frames(gif.encoded(table(spark, ["x" * 40_000]))).orderBy("frame").collect()
    assert [r["at_ms"] for r in timed] == [0, 40, 80] and sum(sum(r["red"]) for r in timed) >= 40_000


def test_media_feature_sums_the_histograms_of_what_frames_show(spark):
    docs = table(spark, ["a" * 16_384 + "Z" * 100, "short", "x" * 40_000])  # a shorter last frame leaves earlier rows on the screen
    feature = {r["doc_id"]: [int(x) for x in r["feature"].split(":")] for r in gif.text_media(docs).collect()}
    timed = gif.frames(gif.encoded(docs)).collect()
    for i in range(3):
        mine = [r for r in timed if r["doc_id"] == i]
        assert feature[i] == [len(mine), *np.sum([[*r["red"], *r["green"], *r["blue"]] for r in mine], 0).tolist()]
    assert sum(feature[0][1:17]) == 2 * 16_384


# Exact deduplication


def test_exact_dedup(spark):
    want = {}
    for i, t in enumerate(ODD):
        want.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    for limit in (None, 0):  # with the filter, and with plain joins
        found = {r["doc_id"]: r for r in lsm_dedup.exact_dedup(table(spark, ODD), filter_limit=limit).collect()}
        for text, ids in want.items():
            for i in ids:
                r = found[i]
                assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (ids[0], len(ids), i == ids[0], hashlib.sha256(text.encode()).hexdigest())
    assert lsm_dedup.exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_repeated_rows_and_index(spark):
    docs = spark.createDataFrame([(3, "a"), (3, "a"), (1, "b"), (2, "a"), (None, "c")], "doc_id long, text string")
    assert lsm_dedup.exact_dedup(docs).where("text_sha256 is not null").count() == 5
    kept = lsm_dedup.kept_documents(docs)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "c"), (1, "b"), (2, "a")]
    index = lsm_dedup.DigestIndex(spark)
    index.flush(docs)
    index.flush(spark.createDataFrame([(9, "a")], "doc_id long, text string"))
    assert index.lookup(hashlib.sha256(b"a").hexdigest()).count() == 4
    assert index.compact().where("group_size = 4").first()["keep_id"] == 2
    index.flush(spark.createDataFrame([(1, "a"), (4, "new")], "doc_id long, text string"))
    merged = index.compact()  # what was flushed since, into the sorted runs of the level below
    assert merged.where("group_size = 5").first()["keep_id"] == 1 and merged.count() == 4


def test_exact_dedup_doc_id_of_two_texts_and_null_ids(spark):
    docs = spark.createDataFrame([(3, "A"), (5, "A"), (5, "B"), (6, "C"), (7, "B"), (None, "A"), (None, "D"), (None, "D")], "doc_id long, text string")
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in "ABCD"}
    for limit in (None, 0):
        rows = lsm_dedup.exact_dedup(docs, filter_limit=limit).collect()
        found = sorted(((sha[r["text_sha256"]], r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in rows), key=lambda r: r[:2])
        assert found == [
            ("A", 0, 3, 3, False), ("A", 3, 3, 3, True), ("A", 5, 3, 3, False), ("B", 5, 5, 2, True), ("B", 7, 5, 2, False),
            ("C", 6, 6, 1, True), ("D", 0, None, 2, True), ("D", 0, None, 2, True),
        ]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in lsm_dedup.kept_documents(docs).collect())
    assert kept == [(0, "D"), (3, "A"), (5, "B"), (6, "C")]


def test_regrouped_moves_rows_of_null_doc_id(spark):
    joined = spark.createDataFrame([(1, b"d", 1, 3), (None, b"d", 1, 3), (None, b"d", 1, 3)], "doc_id long, digest binary, keep_id long, group_size long")
    wrong = spark.createDataFrame([(None, b"d", "other"), (None, b"d", "other")], "doc_id long, digest binary, body string")
    rows = [(r["doc_id"], r["keep_id"], r["group_size"]) for r in lsm_dedup._regrouped(joined, wrong).collect()]
    assert sorted(rows, key=str) == [(1, 1, 1), (None, None, 2), (None, None, 2)]


def test_rows_that_only_share_a_digest_are_grouped_by_bytes(spark):
    joined = spark.createDataFrame([(1, b"d", 1, 4), (2, b"d", 1, 4), (3, b"d", 1, 4), (4, b"d", 1, 4)], "doc_id long, digest binary, keep_id long, group_size long")
    wrong = spark.createDataFrame([(3, b"d", "other"), (4, b"d", "other")], "doc_id long, digest binary, body string")
    found = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in lsm_dedup._regrouped(joined, wrong).collect()}
    assert found == {1: (1, 2), 2: (1, 2), 3: (3, 2), 4: (3, 2)}


# Quality


def test_quality_learns_style(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "quite", "plain", "prose"]

    def text(good):
        return " ".join(rng.choice(words) + ("" if good else rng.choice(["!!!", "***", "$$$"])) for _ in range(60))

    texts = [text(i % 3 > 0) for i in range(300)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(900, None)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in knn_quality.scores(table(spark, texts), labels).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i]["held_out"] == (i in held) for i in range(300))
    assert sum(rows[i]["predicted"] == int(i % 3 > 0) for i in held) >= 0.95 * len(held)
    assert 0 < rows[300]["score"] < 1 and rows[300]["score"] == rows[301]["score"]
    none = knn_quality.scores(table(spark, texts), labels.where("false"))
    assert none.where("score <> 0.5").count() == 0
    assert knn_quality.scores(empty(spark), labels).count() == 0


def test_quality_blocks_equal_brute_force():
    rng = np.random.default_rng(0)
    counts = rng.poisson(0.01, (700, knn_quality.TERMS)).astype(np.float32)
    labels = rng.integers(0, 2, 700).astype(float)
    voter = knn_quality.fit(counts[:600], labels[:600])
    scores = voter.score(counts[600:])
    v = voter.project(counts[600:]) @ voter.vectors.T
    for i in range(100):
        near = np.argsort(-v[i])[: knn_quality.NEIGHBOURS]
        w = np.maximum(v[i][near], 0)
        assert abs(scores[i] - (w * labels[near]).sum() / w.sum()) < 1e-5


# Packing


def test_best_two_fit_fills_bins():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 900, 3000)
    bins, offsets = packing.best_two_fit(lengths, 2048)
    for b in range(bins.max() + 1):
        inside = np.flatnonzero(bins == b)
        order = inside[np.argsort(offsets[inside])]
        assert offsets[order].tolist() == (np.cumsum(lengths[order]) - lengths[order]).tolist()
        assert lengths[order].sum() <= 2048
    assert bins.max() + 1 <= -(-lengths.sum() // 2048) + 1


def test_two_replace_the_smallest():
    # Greedy takes 7, then 2; a gap of 1 stays, and 2 + 1 of what is left do not beat it until 2 makes way.
    bins, _ = packing.best_two_fit(np.array([7, 2, 2, 2, 2, 3]), 10)
    assert bins.max() == 1


def test_pieces_equal_whole_encoding(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path(SPACE_TOKENIZER)
    whole = Tokenizer.from_file(path)
    rng = random.Random(2)
    letters = "abİΣß'.,!≠́é…<|>endoftext 019$*\n\x1c"
    texts = [*ODD, "x<|endoftext|>y it's don't .'s", *("".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)), "word " * 5000]
    rows = packing.pack_documents(table(spark, texts), path, with_ids=True).collect()
    for i, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [x for r in mine for x in r["ids"]] == ids
        assert [(r["start"], r["length"]) for r in mine] == [(s, len(ids[s : s + 2048])) for s in range(0, len(ids), 2048)]
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in mine)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty(spark), path).count() == 0


# Pieces


def test_wfst_equals_library(spark):
    import sentencepiece

    path = tokenizer_path(PIECE_MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        model = f.read()
    machine = wfst_pieces.Transducer(model)
    rng = random.Random(4)
    letters = "abcXYZ.,'!? ▁é日\n\t0129$€#-_([{"
    texts = [*ODD, "  lead", "trail  ", "a   b", *("".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(1500))]
    for t in texts:
        ids = library.encode(t or "")
        assert machine.encode(t or "").tolist() == ids
        assert machine.decode(np.array(ids, np.int64)) == library.decode(ids)
    rows = {r["doc_id"]: r for r in wfst_pieces.piece_digests(table(spark, ODD), model).collect()}
    assert all(r["round_trip"] for r in rows.values()) and rows[0]["n_pieces"] == 0
    back = wfst_pieces.decode_documents(wfst_pieces.encode_documents(table(spark, ODD), model), model)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate(ODD)}
    assert wfst_pieces.piece_digests(empty(spark), model).count() == 0


# Suffixes


def test_suffix_array():
    rng = np.random.default_rng(5)
    for n in [*range(1, 40), 500, 2000]:
        for top in (1, 2, 4, 200):
            t = rng.integers(1, top + 1, n)
            listed = t.tolist()
            assert suffix_dedup.suffix_array(t).tolist() == sorted(range(n), key=lambda i: listed[i:])


def repeats(texts):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for k in range(len(b) - 199):
            seen[b[k : k + 200]] = seen.get(b[k : k + 200], 0) + 1
    out = {}
    for i, b in enumerate(raw):
        covered = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                covered[k : k + 200] = b"\1" * 200
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        out[i] = (len(b), len(b) - len(kept), sum(1 for k in range(len(b)) if covered[k] and not (k and covered[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("most", [suffix_dedup.SORTED_STRETCHES, 3])
def test_repeats_equal_brute_force(spark, most):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [word(k) for k in (199, 200, 201, 340, 900)]
    texts = [*ODD, "abc" * 400, "x" * 199, "x" * 200, shared[3] * 3]
    for _ in range(40):
        texts.append(word(rng.randrange(300)) + rng.choice(shared) + word(rng.randrange(150)) + rng.choice(shared) + word(rng.randrange(50)))
    for s in shared:
        for _ in range(4):  # near copies: one byte changed
            k = rng.randrange(len(s))
            texts.append(s[:k] + "#" + s[k + 1 :])
    rows = suffix_dedup.remove_repeats(table(spark, texts), most).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == repeats(texts)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_repeats_of_repeated_identifiers(spark):
    docs = spark.createDataFrame([(1, "y" * 150 + "ab" * 120), (1, "plain"), (1, "plain"), (None, "q" * 250)], "doc_id long, text string")
    rows = sorted((r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(docs).collect())
    assert rows == [(5, 0), (5, 0), (250, 250), (390, 240)]


# Language model


def test_brown_scores(spark):
    import math
    from collections import Counter

    rng = random.Random(8)
    a, b = [f"a{k}" for k in range(30)], [f"b{k}" for k in range(30)]
    texts = [*ODD, *(" ".join(rng.choice(side) for _ in range(rng.randrange(5, 60))) for _ in range(200) for side in [rng.choice((a, b))])]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(texts)}
    c = Counter(x for i, t in tokens.items() if not held(i) for x in t)
    total = sum(c.values())
    rows = {r["doc_id"]: r for r in brown_lm.class_bigram_scores(table(spark, texts)).collect()}
    for i, t in tokens.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(t), sum(c[x] > 0 for x in t), total)
        assert abs(r["base_score"] - sum(math.log10((c[x] + 1) / (total + len(c) + 1)) for x in t)) < 1e-6
        assert r["score"] < 0
    mine, base = (sum(r[k] for r in rows.values() if r["held_out"]) for k in ("score", "base_score"))
    assert mine > base  # knowing the class before helps where words come in two languages
    assert brown_lm.class_bigram_scores(empty(spark)).count() == 0


def test_exchange_parts_two_languages_and_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(2)
    pairs = np.zeros((21, 21))
    for u in range(20):
        for v in range(20):
            if (u < 10) == (v < 10):
                pairs[u, v] = rng.integers(50, 90)
    pairs[20, :20] = pairs[:20, 20] = 5
    at = brown_lm.exchange(pairs, 3)
    assert len(set(at[:10])) == len(set(at[10:20])) == 1 and at[0] != at[10] and at[20] == 2
    texts = ["the cat sat", "the dog sat down", "a cat"] * 9
    model, counts = brown_lm.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), classes=4)
    assert np.allclose((10.0**model.log_next).sum(1), 1)
    words = counts.toPandas()
    unit = model.units.of(words["word"].to_numpy(), words["ending"].to_numpy())
    for k in range(3):  # every word of a class, and one unseen one
        n = words["n"].to_numpy()[model.class_of[unit] == k]
        assert abs((n + 1).sum() + 1 - 10.0 ** model.log_room[k]) < 1e-6


def test_exchange_step_moves_each_word_where_exchange_would():
    rng = np.random.default_rng(5)
    n, classes = 14, 4
    for _ in range(20):
        pairs = rng.poisson(rng.choice([0.3, 2, 9], (n, n))).astype(float)
        at = rng.integers(0, classes - 1, n)
        at[-1] = classes - 1

        def fit(at, pairs=pairs):
            one = np.eye(classes)[at]
            table = one.T @ pairs @ one
            return brown_lm._xlogx(table).sum() - brown_lm._xlogx(table.sum(0)).sum() - brown_lm._xlogx(table.sum(1)).sum(), table

        _, table = fit(at)
        own = np.diagonal(pairs)[:-1]
        right, left = ((p - np.diag(np.diagonal(p)))[:-1] @ np.eye(classes)[at] for p in (pairs, pairs.T))
        new = brown_lm.exchange_step(table, at[:-1], right, left, own)
        for u in range(n - 1):
            fits = [fit(np.where(np.arange(n) == u, c, at))[0] for c in range(classes - 1)]
            assert fits[new[u]] > max(fits) - 1e-6


def test_brown_classes_of_less_frequent_words_go_by_context_not_ending(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "UNIT_SHARE", 0.02)
    monkeypatch.setattr(brown_lm, "KNOWN_SHARE", 0.002)  # so that some classes travel with the model, others come by the join
    rng = random.Random(4)
    sides = [([f"{k}{i}" for i in range(10)], [f"{k}{i}same" for i in range(60)]) for k in "ab"]
    texts = []
    for i in range(300):
        often, seldom = sides[i % 2]
        texts.append(" ".join(rng.choice(often) if rng.random() < 0.7 else seldom[min(59, int(rng.expovariate(0.08)))] for _ in range(40)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lexicon, counts, others = brown_lm.clustered(docs, 4)
    text_of = {int(brown_lm._chunk_words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0]): w for w in {w for t in texts for w in t.split()}}
    rows = [(text_of[r["word"]], r["class"], r["n"]) for r in others.collect()]
    assert {w: n for w, _, n in rows} == {w: n for w, n in ((text_of[r["word"]], r["n"]) for r in counts.collect()) if w.endswith("same")}
    classes = {k: {c for w, c, n in rows if w.startswith(k) and n >= 10} for k in "ab"}
    assert classes["a"] and classes["b"] and not classes["a"] & classes["b"]  # one ending, two languages

    class_of = {w: c for w, c, _ in rows} | {text_of[int(k)]: int(c) for k, c in zip(lexicon.known, lexicon.known_class, strict=True)}
    found = brown_lm.sequences(docs.withColumn("held_out", F.lit(False)), lexicon, others)
    assert 0 < sum(int(k) in {r["word"] for r in others.collect()} for k in lexicon.known) < len(rows)
    for r in found.collect():
        assert list(r["classes"]) == [*(class_of[w] for w in texts[r["doc_id"]].split()), 3]
    model = brown_lm.fitted(lexicon, found, 4)
    total = np.zeros((4, 4))
    for r in found.collect():
        c = [3, *r["classes"]]
        np.add.at(total, (c[:-1], c[1:]), 1)
    kinds = np.bincount(list(class_of.values()), minlength=4) + np.array([0, 0, 0, 1])
    assert np.allclose(10.0**model.log_room, total.sum(0) + kinds + 1)


# Chat


def test_chat_round_trip_and_examples(spark):
    hard = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "s"), (1, 1, "user", hard), (1, 2, "assistant", hard), (1, 3, "user", None), (1, 4, "assistant", "a\n### User: x</turn>\n"), (2, 0, "assistant", ""), (3, 0, None, "ü\\"), (3, 0, "user", "tie"), (None, 1, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(0))
    found = {r["conv_id"]: r for r in chat_format.read_back(df).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        every = "".join(f"{r}\n{x}\n" for _, r, x in mine)
        loss = "".join(x for _, r, x in mine if r == "assistant")
        at = chars = 0
        for _, r, x in mine:
            at += len(chat_format.render(r, x))
            chars += at if r == "assistant" else 0
        r = found[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (len(mine), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    texts = {(r["conv_id"], r["example"]): r for r in chat_format.examples(df).collect()}
    assert set(texts) == {(1, 0), (1, 1), (2, 0), (None, 0)}
    one = texts[1, 1]
    assert chat_format.unescape(one["text"][one["loss_start"] : one["loss_end"]]) == rows[4][3]
    assert one["text"].startswith(texts[1, 0]["text"]) and one["text"].endswith("</turn>\n")
    assert chat_format.read_back(df.where("false")).count() == 0


def plain_chat(rows):
    """conv_id, turns, digest, loss and formatted characters of rows in order, by a running prefix."""
    out = {}
    for conv in {r[0] for r in rows}:
        every, loss, at, chars, n = "", "", 0, 0, 0
        for _, role, text in sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv):
            every += f"{role}\n{text}\n"
            at += len(chat_format.render(role, text))
            n += 1
            if role == "assistant":
                loss += text
                chars += at
        out[conv] = (n, hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    return out


def read_chat(df):
    return {r["conv_id"]: tuple(r)[1:6] for r in chat_format.read_back(df).collect()}


@pytest.mark.parametrize("block", [1, 40, 1 << 16])
def test_chat_blocks_of_any_size_read_back_alike(spark, monkeypatch, block):
    monkeypatch.setattr(chat_format, "BLOCK_CHARS", block)
    rows = [(c, t, ("user", "assistant")[t % 2], f"#{t} \\<:{c} " * (t + 1)) for c in (1, 5) for t in range(9)] + [(2, 0, "user", "alone"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (None, 2, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert read_chat(df) == plain_chat(rows)
    texts = {(r["conv_id"], r["example"]): r for r in chat_format.examples(df).collect()}
    assert len(texts) == 10 and texts[1, 3]["text"] == "".join(chat_format.render(r, x) for c, t, r, x in rows if c == 1 and t <= 7)
    assert sum(len(r["text"]) for k, r in texts.items() if k[0] == 1) == plain_chat(rows)[1][4]
    if block == 1:  # what a changed example would show
        parts = chat_format.blocks(df.where("conv_id = 1")).orderBy("block").collect()
        own = [(r["conv_id"], t["block"], r["block"], r["start"], r["text"], [e.asDict() for e in r["examples"]] if t["block"] == r["block"] else []) for t in parts for r in parts if r["block"] <= t["block"]]
        names = ["conv_id", "target", "piece", "start", "text", "examples"]
        read = lambda rows: [r for b in chat_format._read(iter([chat_format.pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])])) for r in b.to_pylist()]
        assert sum(r["formatted_chars"] for r in read(own)) == plain_chat(rows)[1][4]
        with pytest.raises(ValueError, match="context"):
            read([r for r in own if r[1:3] != (7, 2)])
        with pytest.raises(ValueError, match="rendered"):
            read([(*r[:4], r[4].replace("</turn>", "", 1), r[5]) for r in own])


def test_chat_examples_are_written_each_by_itself(spark, monkeypatch):
    rows = [(1, t, ("user", "assistant")[t % 2], f"#{t}<") for t in range(9)] + [(2, 0, "user", "alone"), (None, 0, "assistant", "x"), (None, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat_format.written(df).collect()
    whole = lambda conv, upto: "".join(chat_format.render(r, x) for c, t, r, x in rows if c == conv and t <= upto)
    want = [(c, whole(c, t)) for c, t, r, _ in rows if r == "assistant"]
    assert sorted(((r["conv_id"], r["text"]) for r in found if r["examples"]), key=str) == sorted(want, key=str)
    assert sorted((r["conv_id"], r["text"]) for r in found if not r["examples"]) == [(1, whole(1, 8)), (2, whole(2, 0))]  # turns after the last reply
    assert all(chat_format.unescape(r["text"][e["loss_start"] : e["loss_end"]]) == f"#{2 * e['example'] + 1}<" for r in found if r["conv_id"] == 1 for e in r["examples"])
    names = ["conv_id", "target", "piece", "start", "text", "examples"]
    own = sorted(((r["conv_id"], 0, 0, 0, r["text"], [e.asDict() for e in r["examples"]]) for r in found if r["conv_id"] == 1), key=lambda r: len(r[4]))
    read = lambda rows: list(chat_format._read(iter([chat_format.pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])])))
    assert sum(r["n_turns"] for b in read(own) for r in b.to_pylist()) == 9
    with pytest.raises(ValueError, match="begin"):  # a context that differs in one example alone
        read([own[0], (*own[1][:4], own[1][4].replace("#0", "#9", 1), own[1][5]), *own[2:]])


def test_chat_long_conversation_and_missing_ids(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"word {t}") for t in range(20_000)]
    df = spark.range(20_000).selectExpr("1L conv_id", "id turn", "if(id % 2 = 1, 'assistant', 'user') role", "concat('word ', id) text")
    assert read_chat(df) == plain_chat(rows)
    lost = spark.range(100_000).selectExpr("cast(null as long) conv_id", "id turn", "'assistant' role", "'r' text")
    n, _, loss, _, chars = read_chat(lost)[None]
    assert (n, loss, chars) == (100_000, 100_000, len(chat_format.render("assistant", "r")) * 100_000 * 100_001 // 2)


# Personal data


def plain_spans(text):
    import regex

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    kinds = list(patterns)

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0

    def holds(kind, m):
        d = regex.sub("[^0-9]", "", m)
        return kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.split("."))) or (kind == "card" and 12 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15)

    return sorted((m.start(), kinds.index(k), m.end(), k) for k, p in patterns.items() for m in regex.finditer(p, text) if holds(k, m[0]))


def test_pii_base_equals_plain_patterns(spark):
    rng = random.Random(9)
    letters = ["4", "1", "0", "25", "255", ".", "-", " ", "@", "+", "(", ")", "a", "b.c", "é", "🤖", "_", "x@y.z", "4111 1111 1111 1111", "+1 (437) 555-0689", "10.0.0.1"]
    texts = [*ODD, "a@b.c_d@e.f", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "0001.2.3.255", "1 2 3 " * 30_000, "9" * 40_000, "z" * 60_000 + "@", *("".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(800))]
    rows = {r["doc_id"]: r for r in pii_weak.detect(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t or "")
        r = rows[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest(), repr((t or "")[:80])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(x[1] == k for x in want) for k in range(4)]
        assert set(f"{k}:{a}:{b}" for a, _, b, k in want) <= set(r["spans"].split(",")) | {""}
    assert pii_weak.detect(empty(spark)).count() == 0


def test_pii_adds_loose_spans_and_redacts(spark):
    texts = [f"write an email to ann{k} (at) mail{k}.example.com please" for k in range(30)] + [f"email joe{k}@mail{k}.example.com now" for k in range(60)] + ["call phone 437-555-0689 today", None]
    found = {r["doc_id"]: r for r in pii_weak.detect(table(spark, texts)).collect()}
    assert found[0]["n_email"] == 0 and found[0]["spans"].startswith("email:18:")
    docs = table(spark, texts)
    hidden = {r["doc_id"]: r["text"] for r in pii_weak.redact(docs).collect()}
    assert hidden[40] == "email [EMAIL] now" and hidden[0] == "write an email to [EMAIL] please" and hidden[91] is None
    assert pii_weak.redact(docs).columns == docs.columns


def test_reliabilities_find_the_good_labelers():
    patterns = [((1, 1, 0), 400), ((0, 0, 0), 500), ((1, 1, 1), 60), ((0, 0, 1), 40), ((1, 0, 0), 10), ((0, 1, 1), 10)]
    prior, rates, posterior = pii_weak.reliabilities(patterns)
    assert 0.3 < prior < 0.6 and rates[0][0] > 0.9 and rates[1][0] > 0.9 and rates[2][0] < 0.5
    assert posterior[1, 1, 0] > 0.9 > 0.1 > posterior[0, 0, 0]
    assert pii_weak.reliabilities([]) == (0.5, [], {}) or pii_weak.reliabilities([])[1] == []


# Pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    good = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(80))
    base = good()
    texts = [good() for _ in range(60)] + [base, base.replace(" ", "  ", 1), base.replace(base.split()[3], "changed", 1), "mail me at a.b@c.example.com " + good(), None, ""]
    texts += [" ".join(f"{w}***" for w in good().split()) for _ in range(30)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 66)) for i in range(len(texts))], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    now, left = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, str(tmp_path)).collect(), docs.schema)
        assert now.columns == docs.columns
        left[name] = {r["doc_id"] for r in now.collect()}
    assert left["quality"] == set(range(66))
    assert left["exact_copies"] == left["quality"] - {61, 65}
    assert left["near_copies"] == left["exact_copies"] - {62}
    kept = {r["doc_id"]: r for r in now.collect()}
    assert "[EMAIL]" in kept[63]["text"] and kept[63]["n_chars"] == len(kept[63]["text"])
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == left["near_copies"]
