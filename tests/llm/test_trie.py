"""The prefix trie against a plain recursive one, over few and many partitions."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from linework.llm import trie


def plain_sequences(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
    own = {c: [(r, t) for _, r, t in sorted(ts, key=lambda x: (x[0], x[1], digest(x[1], x[2])))] for c, ts in convs.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    return out


def plain(seqs):
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    ends = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(members[k]) if len(seqs[c]) == len(k)).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k], ends(k)) for k, m in members.items())


def shown(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def talks(rng, n, ids):
    rows = []
    for c in ids:
        for t in range(rng.randint(1, n)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc é"]) * rng.randint(0, 1)))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_the_plain_one(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 3)
    monkeypatch.setattr(trie, "BATCH", 5)
    monkeypatch.setattr(trie, "PARENTS", 4)
    rng = random.Random(seed)
    rows = talks(rng, 7, range(0, 350, rng.choice([1, 2, 3])))
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"part": F.lit(1), "digest": F.lit("x"), "depth": F.lit(2)})
    want = plain(plain_sequences(rows))
    for partitions in (1, 3, 40):
        assert shown(trie.prefix_trie(trie.rebuilt(df), partitions)) == want


def test_untidy_rows(spark):
    rows = [(0, None, "user", "first"), (0, 0, None, None), (0, 0, None, None), (0, 1, "assistant", "x"), (5, 2, "user", None), (7, 0, "user", "first"), (None, 0, "user", "lost"), (205, 0, "user", "no hundred"), (205, 1, "a:b", "c"), (205, 1, "a", "b:c")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert shown(trie.conversation_trie(df)) == plain(plain_sequences(rows))
    assert trie.conversation_trie(df.where("false")).count() == 0


def test_copies_over_many_partitions_and_a_long_conversation(spark):
    rows = [(c, 0, "user", "same") for c in range(2000)] + [(100, t, "user", "same" if t == 0 else str(t)) for t in range(1, 1500)]
    seqs = trie.sequences(spark.createDataFrame(rows, SCHEMA))
    own = {c: [("user", "same")] for c in range(2000)}
    own[100] = [("user", "same" if t == 0 else str(t)) for t in range(1500)]
    assert shown(trie.prefix_trie(seqs, 16)) == plain(own)
