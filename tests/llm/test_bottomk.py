"""Near duplicates against all pairs of small tables."""

import random

import pytest
from pyspark.sql import functions as F

from linework.llm import bottomk


def brute(texts: dict[int, str | None], percent: int) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                m = len(sets[i] & sets[j])
                if m * 100 >= (len(sets[i]) + len(sets[j]) - m) * percent:
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def group(rng: random.Random, base: list[str], edits: int) -> str:
    w = list(base)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"x{rng.random()}"
    return " ".join(w)


def test_groups_passages_and_edges_match_all_pairs(spark):
    rng = random.Random(5)
    texts: dict[int, str | None] = {}
    for size in (60, 150, 330):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for _ in range(110):
            texts[len(texts)] = group(rng, base, rng.randrange(6 if size < 200 else 16))
    passage = [f"p{k}" for k in range(70)]
    for _ in range(90):
        texts[len(texts)] = " ".join([*passage, *(f"q{rng.randrange(90)}" for _ in range(rng.randrange(40)))])
    for t in (None, "", " \t\n", "one", "ONE", "one two three", "one two three", "a b c d e", "a b c d e f"):
        texts[len(texts)] = t
    rows = [(i, t) for i, t in texts.items()]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sketch", F.lit("clash")).repartition(5)
    for percent in (85, 80):
        found = {r["doc_id"]: r for r in bottomk.near_duplicates(docs, percent=percent).collect()}
        want = brute(texts, percent)
        assert {i: r["component_id"] for i, r in found.items()} == want
        assert all(r["kept"] == (i == want[i]) for i, r in found.items())
    assert found[len(texts) - 9]["n_shingles"] == 0


def test_empty_table(spark):
    assert bottomk.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("k", [64, 170])
def test_bound_of_shared_values(k):
    m = bottomk.min_shared(k, 85)
    assert 0 < m < 0.85 * k
