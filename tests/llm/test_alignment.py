"""Aligned tokens against the libraries' whole-text encoding and a plain loop; the event sweep as Spark runs it; odd texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linework.llm import alignment
from linework.llm.queries import BYTE_TOKENIZER, PIECE_MODEL, tokenizer_path

PATHS = tokenizer_path(BYTE_TOKENIZER), tokenizer_path(PIECE_MODEL)


@pytest.fixture(scope="module")
def plain_tokens():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    signs = alignment.byte_alphabet()
    names = {i: t for t, i in a.get_vocab().items()}
    raw_a = lambda i: bytes(signs[c] for c in names[i])
    raw_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def run(text):
        """[(id, end)] of both sides; none where a side's bytes differ."""
        if not text:
            return [], []
        out = []
        for ids, raw in ((a.encode(" " + text, add_special_tokens=False).ids, raw_a), (b.encode(text), raw_b)):
            parts = [raw(i) for i in ids]
            if b"".join(parts) != (" " + text).encode():
                return [], []
            out.append(list(zip(ids, np.cumsum([len(x) for x in parts]).tolist(), strict=True)))
        return out[0], out[1]

    return run


def plain_rows(docs, tokens):
    every = []
    for name, text in docs:
        a, b = tokens(text)
        both = sorted({e for _, e in a} & {e for _, e in b})
        groups = [([i for i, e in a if lo < e <= hi], [i for i, e in b if lo < e <= hi]) for lo, hi in zip([0, *both], both, strict=False)]
        every.append((name, a, b, groups, Counter((x, y) for g in groups for x in g[0] for y in g[1])))
    counts = Counter(p for r in every for p in r[4])
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for name, a, b, groups, links in every:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best, total = sum(n for p, n in links.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in links.items())
        out.append((name, len(a), len(b), len(groups), sum(links.values()), best, total, hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


WORDS = ["the", "The", "naïve", "été", "日本語", "🤖🤖", "a", "I'm", "x1y22", "…", "12,345.67", "\n", "\t", "  ", "<|endoftext|>", "</s>", "<s>", "<unk>", "<0x41>", "Übermaß", "ﬁ", "é", " ", "　", "don't", "http://a.b/c?d=e", "=====", "....", "\r\n", "\x00", "ŵ", "Ωμέγα", " ", "\x1c", "\x85"]


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "", "  ", "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(n)]


ODD = [None, "", " ", "  ", "\n", " a", "a ", "a  b", "▁", "a ▁ b", "x▁y", "a" * 300, "ab " * 500, "日本 語", "  x", "é é", "same text", "same text", "same  text"]


@pytest.mark.parametrize("stretch", [alignment.STRETCH_BYTES, 40])
def test_rows_equal_the_plain_ones(spark, plain_tokens, monkeypatch, stretch):
    monkeypatch.setattr(alignment, "STRETCH_BYTES", stretch)
    docs = list(enumerate(ODD + texts(1, 60)))
    want = sorted(plain_rows(docs, plain_tokens))
    assert sum(r[1] == 0 for r in want) > 4 and sum(r[1] > 0 for r in want) > 30
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit(1), "pair": F.lit("x"), "docs": F.lit(2)}).repartition(5)
    for hot in (alignment.HOT, 50):  # all pairs broadcast; most of them joined
        assert sorted(map(tuple, alignment.aligned_texts(df, *PATHS, hot=hot).collect())) == want


def test_units_never_split_a_token(plain_tokens):
    encoders = alignment.Encoders(*PATHS)
    for text in [t for t in ODD + texts(2, 400) if t]:
        data = np.frombuffer((" " + text).encode(), np.uint8)
        _, fits, a, _, b, _ = encoders.encode(data, np.array([0]))
        want_a, want_b = plain_tokens(text)
        if want_a:
            assert fits.all() and a.tolist() == [i for i, _ in want_a] and b.tolist() == [i for i, _ in want_b], text
        else:
            assert not fits.all(), text


def test_known_units_are_learnt_anew_when_there_are_too_many(monkeypatch, plain_tokens):
    monkeypatch.setattr(alignment, "KEPT_UNITS", 30)
    encoders = alignment.Encoders(*PATHS)
    for text in texts(3, 60):
        _, fits, a, _, _, _ = encoders.encode(np.frombuffer((" " + text).encode(), np.uint8), np.array([0]))
        assert not fits.all() or a.tolist() == [i for i, _ in plain_tokens(text)[0]]


def test_event_sweep_over_tables(spark, plain_tokens):
    docs = list(enumerate(texts(4, 12)))
    tokens = {name: plain_tokens(text) for name, text in docs}
    a, b = (spark.createDataFrame([(n, e, i) for n, t in tokens.items() for i, e in t[k]], "doc_id long, at long, id long").repartition(3) for k in (0, 1))
    groups = alignment.swept(a, b)
    found = {}
    for r in groups.orderBy("doc_id", "group").collect():
        found.setdefault(r["doc_id"], []).append((r["a"], r["b"]))
    pairs = {(r["doc_id"], r["a"], r["b"]): r["times"] for r in alignment.links(groups).collect()}
    for name, want in ((r[0], r) for r in plain_rows(docs, plain_tokens) if r[1]):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in found[name])
        assert (len(found[name]), hashlib.sha256(text.encode()).hexdigest()) == (want[3], want[7])
        assert sum(n for k, n in pairs.items() if k[0] == name) == want[4]


def test_sides_that_end_apart_raise(spark):
    a, b = spark.createDataFrame([(1, 2, 5), (2, 1, 1)], "doc_id long, at long, id long"), spark.createDataFrame([(1, 3, 5), (2, 1, 1)], "doc_id long, at long, id long")
    with pytest.raises(Exception, match="end apart"):
        alignment.swept(a, b).collect()


def test_repeated_missing_ids_and_empty_tables(spark, plain_tokens):
    docs = [(1, "one two"), (1, "one two"), (None, "one three"), (1, "two"), (None, None)] + [(7, "copies of it")] * 40
    want = sorted((r[0] or 0, *r[1:]) for r in plain_rows(docs, plain_tokens))
    found = alignment.aligned_texts(spark.createDataFrame(docs, "doc_id long, text string"), *PATHS, hot=9)
    assert sorted((r[0] or 0, *r[1:]) for r in found.collect()) == want
    assert alignment.aligned_texts(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0
