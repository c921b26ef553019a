"""Token shards against plain encoding, plain decoding and damaged bytes."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linework.llm import grammar
from linework.llm.queries import SPACE_TOKENIZER, tokenizer_path

PATH = tokenizer_path(SPACE_TOKENIZER)


def plain(rows):
    """Each document's row by one loop over the library's ids; rows are in order."""
    from tokenizers import Tokenizer

    tokenizer, at, out = Tokenizer.from_file(PATH), 0, []
    for name, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, grammar.END]
        out.append((name, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_repair_round_trip_and_stretches(seed):
    rng = random.Random(seed)
    words = [[rng.randrange(50) for _ in range(rng.randint(1, 6))] for _ in range(12)]
    docs = [[x for _ in range(rng.randint(0, 200)) for x in rng.choice(words)] + [1] for _ in range(rng.randint(1, 40))]
    docs += [[7] * 1001, [1], [3, 3] * 500] if seed % 2 else []
    ids, begin = np.array([x for d in docs for x in d], np.uint32), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    data, n_symbols, n_rules = grammar.pack([*range(len(docs) - 1), None], begin, ids, 50)
    shard = grammar.Shard(data)
    assert shard.ids().tolist() == ids.tolist() and shard.names == [*range(len(docs) - 1), None]
    assert n_symbols == len(shard.symbols) <= len(ids) and n_rules == len(shard.rules)
    flat, at = shard._expansions
    for i, (a, b) in enumerate(shard.rules.tolist(), shard.base):  # a rule stands for its parts, which come before it
        assert max(a, b) < i and shard.lengths[i] == shard.lengths[a] + shard.lengths[b]
        assert flat[at[i] : at[i] + shard.lengths[i]].tolist() == shard.expand(np.array([a, b])).tolist()
    for _ in range(100):
        d = rng.randrange(len(docs))
        a, b = rng.randint(-2, len(docs[d]) + 2), rng.randint(-2, len(docs[d]) + 2)
        assert shard.stretch(d, a, b).tolist() == docs[d][max(0, a) : max(0, b)]


def test_each_rule_saves_and_no_frequent_pair_is_left(monkeypatch):
    monkeypatch.setattr(grammar, "GAIN", 1 << 40)
    rng = np.random.default_rng(2)
    ids = rng.zipf(1.5, 50_000) % 300
    begin = np.array([0, 20_000, 50_000])
    seq, at, rules = grammar.repair(ids, begin, 300)
    pairs = [p for a, b in zip(at[:-1], at[1:], strict=True) for p in zip(seq[a : b - 1].tolist(), seq[a + 1 : b].tolist(), strict=True) if p[0] != p[1]]
    most = max(Counter(pairs).values())
    assert len(rules) and most < grammar.LEAST and len(np.unique(rules, axis=0)) == len(rules)


def test_damaged_shards_raise():
    data, _, _ = grammar.pack([1, 2], np.array([0, 3, 5]), np.array([5, 6, 1, 7, 1]), 10)
    assert grammar.Shard(data).ids().tolist() == [5, 6, 1, 7, 1]
    for bad in (b"PNG" + data[3:], data[:-1], data + b"x", data[:-8] + bytes(8)):
        with pytest.raises(ValueError):
            grammar.Shard(bad).ids()


def test_shards_of_untidy_rows(spark, monkeypatch):
    monkeypatch.setattr(grammar, "SHARD_IDS", 200)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["ab", "cde", "the", "of", "é", "日本", "<|endoftext|>", "x1,"]) for _ in range(rng.randint(0, 60))) for _ in range(30)]
    rows = [(i * 7 % 30 - 3, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (102, "long " * 30_000), (103, "y" * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit(1), "data": F.lit("x"), "start": F.lit(2)})
    found = grammar.token_shards(docs, PATH)
    assert sorted(map(tuple, found.collect())) == plain(sorted(rows, key=lambda r: r[0]))
    assert grammar.token_shards(docs.where("false"), PATH).count() == 0


def test_repeated_and_missing_ids_take_consecutive_places(spark):
    rows = [(None, "a b"), (3, "c"), (3, "c"), (3, "d e f"), (None, "g"), (1, "h")] + [(9, "copies of one row")] * 300
    found = grammar.token_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), PATH).collect()
    assert sorted((r[0] or 0, *r[2:]) for r in found) == sorted((r[0] or 0, *r[2:]) for r in plain(rows))
    by_start = sorted(found, key=lambda r: r["start"])
    assert [r["doc_id"] for r in by_start[:6]] == [None, None, 1, 3, 3, 3]
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(by_start, by_start[1:], strict=False))


def test_stretches_of_documents(spark):
    texts = ["one two three four five six " * 40, "", None, "seven eight"]
    shards = grammar.write_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH)
    wanted = spark.createDataFrame([(0, 5, 9), (0, 230, 900), (3, 0, 100), (1, 0, 1), (77, 0, 1)], "doc_id long, first long, last long")
    from tokenizers import Tokenizer

    ids = [[*Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    found = {(r["doc_id"], r["first"]): r["ids"] for r in grammar.read_stretches(shards, wanted).collect()}
    assert found == {(0, 5): ids[0][5:9], (0, 230): ids[0][230:], (3, 0): ids[3], (1, 0): [1]}
