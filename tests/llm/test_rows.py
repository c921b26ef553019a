"""Nulls, repeated identifiers, clashing columns, structured texts: what each operator does with rows that aren't tidy."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linework.llm import bottomk, brown_lm, knn_quality, lsm_dedup, packing, pii_weak, suffix_dedup
from linework.llm.common import gated, parted, shared_dir, text_key, without
from linework.llm.kernels import joined, same_spans, shingle_sets, span_hashes, window_hashes, windows_at
from linework.llm.queries import SPACE_TOKENIZER, tokenizer_path


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def turned(text):
    return text.translate(str.maketrans("ab", "ba"))


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("n", [64, 512, 1024, 4096])
def test_structured_texts_have_hashes_of_their_own(n):
    data = np.frombuffer((thue_morse(n) + turned(thue_morse(n))).encode(), np.uint8)
    starts, ends = np.array([0, n]), np.array([n, 2 * n])
    one, two = (span_hashes(data, starts, ends, lane=k) for k in (0, 1))
    assert len({*one.tolist(), *two.tolist()}) == 4
    assert not same_spans(data, starts[:1], data, starts[1:], np.array([n]))[0] and same_spans(data, starts, data, starts, ends - starts).all()


def test_window_hashes_depend_on_their_bytes_alone():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 4, 900).astype(np.uint8)
    at_all, levels = window_hashes(data, 40)
    assert len(at_all) == 861
    for i in (0, 7, 400, 860):
        moved, _ = window_hashes(np.concatenate([rng.integers(0, 4, 5).astype(np.uint8), data[i : i + 40]]), 40)
        assert moved[5] == at_all[i]
    wide, levels = window_hashes(data, 200)
    assert (wide == windows_at(levels, np.arange(701), 200)).all() and len(set(wide.tolist())) == 701
    assert joined(np.array([1], np.uint64), np.array([2], np.uint64)) != joined(np.array([2], np.uint64), np.array([1], np.uint64))


@pytest.mark.parametrize("n", [1024, 4096])
def test_thue_morse_words_stay_apart(spark, n):
    word = thue_morse(n)
    texts = [word, turned(word), f"one two three four {word}", f"one two three four {turned(word)}", f"{word} {turned(word)} {word}"]
    docs = table(spark, texts)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(SPACE_TOKENIZER))
    for r in packing.pieces(docs, tokenizer_path(SPACE_TOKENIZER), with_ids=True).collect():
        ids = [*tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]
        own = ids[r["start"] : r["start"] + r["length"]]
        assert r["ids"] == own and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
    near = {r["doc_id"]: r for r in bottomk.near_duplicates(docs).collect()}
    assert [near[i]["component_id"] for i in range(5)] == [0, 1, 2, 3, 4]
    _, counts, _ = brown_lm.clustered(docs)
    assert sorted(r["n"] for r in counts.collect()) == [2, 2, 2, 2, 3, 4]
    scored = brown_lm.class_bigram_scores(spark.createDataFrame([(k, t) for k, t in zip((1, 3, 4, 5, 8), texts, strict=True)], "doc_id long, text string"), held=9)
    assert scored.where("base_score is null").count() == 0
    left = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs).collect()}
    for i, text in enumerate(texts):
        raw = text.encode()
        seen = {}
        for t in texts:
            for k in range(len(t) - 199):
                seen[t[k : k + 200]] = seen.get(t[k : k + 200], 0) + 1
        gone = np.zeros(len(raw), bool)
        for k in range(len(text) - 199):
            if seen[text[k : k + 200]] > 1:
                gone[k : k + 200] = True
        assert left[i]["n_removed"] == gone.sum() and left[i]["kept_sha256"] == hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()


def test_parts_that_share_a_hash_are_encoded_by_themselves(monkeypatch):
    encoder = packing.WordEncoder(tokenizer_path(SPACE_TOKENIZER))
    monkeypatch.setattr(packing, "span_hashes", lambda data, starts, ends, lower: (ends - starts).astype(np.uint64))  # all of a length collide
    text = "cat dog cow the dog 42 cat x_y Öl éa " * 3
    data = np.frombuffer(text.encode(), np.uint8)
    for _ in range(2):
        ids, begin = encoder.encode(data, np.array([0, len(data)]))
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids and begin.tolist() == [0, len(ids)]


def test_words_that_share_a_key_are_keyed_anew(spark, monkeypatch):
    texts = ["alpha beta alpha gamma", "beta beta delta", "alpha epsilon zeta"] * 3
    docs = table(spark, texts)
    want = sorted(r["n"] for r in brown_lm.clustered(docs)[1].collect())
    plain = brown_lm._chunk_words

    def colliding(data, offsets, shared):
        key, doc, ending, starts, ends = plain(data, offsets, np.zeros(0, np.int64))
        second = brown_lm._key(span_hashes(data, starts, ends, lane=1))
        first = np.full(len(key), 5, np.int64)
        return np.where(np.isin(first, shared), second, first), doc, ending, starts, ends

    monkeypatch.setattr(brown_lm, "_chunk_words", colliding)
    rows = [r for b in brown_lm._counted(np.zeros(0, np.int64))(iter([batch(texts)])) for r in b.to_pylist()]
    assert len(rows) == 1 and rows[0]["low"] != rows[0]["high"]
    rows = [r for b in brown_lm._counted(np.array([5]))(iter([batch(texts)])) for r in b.to_pylist()]
    assert sorted(r["n"] for r in rows) == want and all(r["low"] == r["high"] for r in rows)


def batch(texts):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])


def test_shingles_that_share_a_hash_are_told_apart():
    words = "a b c d e f g a b c d e f g a b c d x".split()
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    doc, h, g = shingle_sets(data, np.array([0, len(data)]))
    assert len(h) == len(g) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)}) and (np.diff(h.astype(object)) > 0).all()


#: Names that operators use inside, and one with a dot.
CLASHING = ("_bucket", "_bit", "_bits", "maybe", "row", "_gone", "_gone_key", "_id", "_key", "_own", "_own_id", "_sha", "kept", "sketch", "body", "digest", "node", "a.b", "text_key", "items", "_items", "_d", "_k", "_end", "keep_id")


def clashing(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


def key_of(spark, text):
    return spark.range(1).select(text_key(F.lit(text)).alias("k")).first()["k"]


def test_without_takes_rows_by_their_texts(spark):
    docs = clashing(spark, [(1, "a"), (1, "b"), (None, "a"), (None, "c"), (2, None), (2, ""), (3, "a")])
    dropped = spark.createDataFrame([(1, key_of(spark, "a")), (None, key_of(spark, "c")), (2, key_of(spark, "")), (4, key_of(spark, "a"))], "doc_id long, text_key long")
    left = without(docs, dropped)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in left.collect()), key=str) == [(0, "a"), (1, "b"), (3, "a")]
    assert all(r[f"{c}"] == f"own {c}" for r in left.collect() for c in CLASHING)
    assert without(docs, dropped.limit(0)).count() == 7 and without(docs.limit(0), dropped).count() == 0


def test_filters_of_few_bits_lose_nothing(spark):
    df, keys = spark.range(4000).withColumn("_bucket", F.lit(1)), spark.range(0, 4000, 7).withColumnRenamed("id", "k")
    for limit in (1 << 20, 4096, 10):
        near, far = parted(df, F.col("id"), keys, "k", 30_000, limit=limit)
        assert near.columns == df.columns and near.count() + far.count() == 4000
        assert near.join(keys, near["id"] == keys["k"]).count() == keys.count()
        assert gated(df, F.col("id"), keys, "k", 30_000, limit=limit).where("id % 7 = 0").count() == keys.count()


def test_near_duplicates_of_untidy_identifiers(spark):
    words = [f"w{i}" for i in range(60)]
    one = " ".join(words)
    close = " ".join([*words[:-1], "other"])
    far = " ".join(f"z{i}" for i in range(40))
    rows = [(5, one), (5, far), (3, close), (None, one), (None, far), (None, "only nulls " * 9), (None, "only nulls " * 9), (7, far), (7, far), (8, None), (8, ""), (None, None)]
    found = bottomk.near_duplicates(clashing(spark, rows)).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r["text_key"], []).append((r["doc_id"], r["component_id"], r["kept"]))
    order = lambda x: sorted(x, key=str)
    assert order(by[key_of(spark, one)]) == order([(5, 3, False), (None, 3, False)])
    assert by[key_of(spark, close)] == [(3, 3, True)]
    assert order(by[key_of(spark, far)]) == order([(5, 5, True), (None, 5, False), (7, 5, False), (7, 5, False)])
    assert by[key_of(spark, "only nulls " * 9)] == [(None, None, True)] * 2
    assert order(by[key_of(spark, "")]) == order([(8, 8, True), (8, 8, True), (None, None, True)])


def test_pipeline_stages_of_untidy_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    prose = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(80))
    good, junk = [prose() for _ in range(40)], [" ".join(f"{w}***" for w in prose().split()) for _ in range(40)]
    labels = [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(i, t) for i, t in enumerate(good)] + [(100 + i, t) for i, t in enumerate(junk)]
    rows += [(500, good[0] + " x"), (500, junk[0] + " x"), (None, good[1]), (None, junk[1]), (501, None), (None, "")]
    docs = clashing(spark, rows)
    left = corpus_pipeline.quality(spark, docs, str(tmp_path))
    ids = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert left.columns == docs.columns and (500, good[0] + " x") in ids and (None, good[1]) in ids
    assert (500, junk[0] + " x") not in ids and (None, junk[1]) not in ids and len(ids) == 44
    left = corpus_pipeline.exact_copies(spark, left, str(tmp_path))
    ids = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert left.columns == docs.columns and (None, good[1]) not in ids and len(ids) == 42 and (501, None) in ids
    left = corpus_pipeline.near_copies(spark, left, str(tmp_path))
    ids = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert left.columns == docs.columns and (500, good[0] + " x") not in ids and len(ids) == 41
    hidden = corpus_pipeline.personal_data(spark, left.withColumn("text", F.concat("text", F.lit(" joe@mail.org"))), str(tmp_path))
    assert hidden.columns == docs.columns and hidden.where("text like '% [EMAIL]'").count() == 40
    pieces = corpus_pipeline.packed(spark, hidden, str(tmp_path))
    assert pieces.select("doc_id").distinct().count() == 41
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, str(tmp_path))
        assert nothing.count() == 0


def test_repeated_rows_spread_over_packing_groups(spark):
    docs = spark.createDataFrame([(1, "same words here")] * 300, "doc_id long, text string")
    packed = packing.pack(packing.stored(packing.pieces(docs, tokenizer_path(SPACE_TOKENIZER), 32), "pieces"), 32, group_rows=40).collect()
    assert len(packed) == 300 and len({r["sequence_id"] >> 32 for r in packed}) > 4


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = Context

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_dir(Session)


def test_quality_of_repeated_and_tied_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 21)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, "plain words " * 9 if i % 2 else "**?? ##!! " * 9) for i in range(1, 21)] + [(1, "plain words " * 9)] * 50 + [(None, None)], "doc_id long, text string")
    rows = knn_quality.scores(docs, labels).collect()
    assert len(rows) == 71
    assert len({round(r["score"], 9) for r in rows if r["doc_id"] == 1}) == 1
    voter = knn_quality.train(docs, labels)
    assert len(voter.labels) <= 20


def test_exact_dedup_of_clashing_columns(spark):
    docs = clashing(spark, [(2, "a b"), (1, "a  b"), (None, "a\tb"), (4, None), (3, "")])
    kept = lsm_dedup.kept_documents(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_personal_data_is_linear_in_a_texts_matches(spark):
    n = 20_000
    text = " ".join(f"10.{i // 65025}.{i // 255 % 255}.{i % 255}" for i in range(n))
    docs = clashing(spark, [(1, text), (1, "call +1 (437) 555-0689"), (None, "joe@mail.org"), (2, None)])
    pii_weak.detect(docs.limit(1)).collect()
    began = time.time()
    rows = {(r["doc_id"], r["n_spans"]): r for r in pii_weak.detect(docs).collect()}
    hidden = {r["text"] for r in pii_weak.redact(docs).collect()}
    assert time.time() - began < 60  # quadratic work takes many minutes
    assert rows[1, n]["n_ip"] == n and rows[1, 1]["n_phone"] == 1 and rows[None, 1]["n_email"] == 1 and rows[2, 0]["spans"] == ""
    assert hidden == {" ".join(["[IP]"] * n), "call [PHONE]", "[EMAIL]", None}


def test_added_spans_are_found_and_decoys_left(spark):
    rng = random.Random(8)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def iban():
        body = "".join(rng.choice("0123456789") for _ in range(18))
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"

    real = [
        lambda: f"email: ann{digits(2)} (at) mail{digits(1)}.example.com", lambda: f"write to bob{digits(2)} at gmail dot com", lambda: f"phone 4{digits(2)}-5{digits(2)}-{digits(4)}",
        lambda: f"iban {iban()}", lambda: f"ssn 1{digits(2)}-4{rng.randrange(1, 9)}-1{digits(3)}", lambda: f'token = "{hashlib.sha1(digits(9).encode()).hexdigest()}"',
    ]
    fake = [lambda: f"the order DE12{digits(18)} went", lambda: f"part 900-00-{digits(4)} fits", lambda: "see him at noon dot then", lambda: f"version{digits(2)}ofaverylongprojectname here"]
    texts, wanted = [], []
    for i in range(400):
        mine = i % 2 == 0
        texts.append(f"some words {(rng.choice(real) if mine else rng.choice(fake))()} and more")
        wanted.append(mine)
    found = {r["doc_id"]: r["n_spans"] > 0 for r in pii_weak.detect(table(spark, texts)).collect()}
    hits = sum(found[i] for i, w in enumerate(wanted) if w)
    wrong = sum(found[i] for i, w in enumerate(wanted) if not w)
    assert hits >= 190 and wrong <= 10


def test_iban_checksum(spark):
    rows = spark.createDataFrame([("DE89370400440532013000",), ("GB82 WEST 1234 5698 7654 32",), ("DE88370400440532013000",)], "t string")
    assert [r["x"] for r in rows.select(pii_weak.iban_holds(F.col("t")).alias("x")).collect()] == [True, True, False]
