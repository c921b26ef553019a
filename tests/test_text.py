"""Text, metric, confidence and correction operators on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linework import sinks
from linework.functions import distance as kernel
from linework.functions import text as T
from linework.operators import confidence as K
from linework.operators import decoding as G
from linework.operators import fuzzy, losses
from linework.operators import metrics as M

LINES = [(0, "hello world", 0.92, [0.92, 0.91]), (1, "the quick brown fox", 0.80, [0.80]), (2, "low conf line", 0.50, [0.50]), (3, "", 0.0, [])]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.fixture
def lines(spark):
    return spark.createDataFrame([("d", i, t, c, "clean", False) for i, t, c, _ in LINES], "doc_id string, line_index int, raw_text string, confidence double, difficulty_tag string, needs_review boolean")


@pytest.mark.parametrize(
    ("raw", "want"),
    [('"# Ell hello  ..', "hello"), ("hello.", "hello."), ("“quoted’", "quoted’"), ("a   b", "a b"), (" x ", "x"), ("Ell", "Ell"), ("", ""), ("end . .", "end")],
)
def test_noise(spark, raw, want):
    assert one(spark, T.clean_noise(F.lit(raw))) == want


def test_edit_distance_bands(spark):
    rng = random.Random(1)
    pairs = [("", ""), ("", "abc"), ("a😀b", "ab"), ("é", "e")] + [("".join(rng.choice("abc") for _ in range(n)), "".join(rng.choice("abc") for _ in range(m))) for n, m in ((5, 9), (40, 80), (300, 20), (600, 600))]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [(r["a"], r["b"], r["d"]) for r in df.select("a", "b", T.edit_distance("a", "b").alias("d")).collect()] == [(a, b, distance(a, b)) for a, b in pairs]


def test_edit_distance_where_bounds_meet_and_where_they_do_not(monkeypatch):
    rng = random.Random(2)
    for n in (0, 1, 30, 90, 300, 1200):
        for signs in ("ab", "abcdefgh", "aé😀b"):
            a = "".join(rng.choice(signs) for _ in range(n))
            b = "".join(c if rng.random() > 0.1 else rng.choice(["", signs[0], c + signs[1]]) for c in a)
            d = distance(a, b)
            assert kernel.edits(a, b) == kernel.edits(b, a) == kernel.edits(list(a), list(b)) == d
            longer, shorter = (a, b) if len(a) >= len(b) else (b, a)
            assert not shorter or kernel.banded(longer, shorter, d) == kernel.banded(longer, shorter, d + 5) == d
    # Of a line of 200,000 signs no step has as many bits.
    line = "".join(rng.choice("the quick brown dog saw there") for _ in range(200_000))
    wide, whole = [], kernel.banded
    monkeypatch.setattr(kernel, "banded", lambda a, b, most: wide.append(len(a)) or whole(a, b, most))
    assert kernel.edits(line.replace("e", "a"), line) == line.count("e")
    assert max(wide, default=0) < 2000


def test_word_distance_with_a_large_vocabulary(spark):
    a, b = [f"w{i}" for i in range(40)], [f"w{i}" for i in range(0, 40, 2)]
    df = spark.createDataFrame([(a, b), (["the", "cat", "sat"], ["the", "dog", "sat", "down"]), ([], ["x"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(T.word_distance(F.col("a"), F.col("b"))).collect()] == [20, 2, 1]


def test_error_rates(spark):
    rows = [("hello", "hello", "clean", False), ("abc", "xyz", "hard", True), ("hello world", "hello earth", "clean", False), ("ab", "", "other", False)]
    pairs = spark.createDataFrame(rows, "prediction string, reference string, tag string, needs_review boolean")
    r = M.evaluate(pairs).first()
    edits = [distance(p, q) for p, q, _, _ in rows]
    assert abs(r["cer"] - sum(edits) / sum(max(1, len(q)) for _, q, _, _ in rows)) < 1e-12
    assert (r["num_samples"], r["num_clean"], r["num_hard"], r["num_needs_review"], r["cer_hard"]) == (4, 2, 1, 1, 1.0)
    assert abs(r["wer"] - (0 + 1 + 1 + 1) / (1 + 1 + 2 + 1)) < 1e-12
    alone = pairs.limit(1).withColumn("reference", F.lit(None).cast("string"))
    more = M.evaluate(pairs.unionByName(alone)).first()
    assert more["num_samples"] == r["num_samples"] + 1 and (more["cer"], more["wer"]) == (r["cer"], r["wer"])
    none = M.evaluate(pairs.where("false")).first()
    assert (none["cer"], none["wer"], none["accuracy"], none["num_samples"]) == (0.0, 0.0, 1.0, 0)
    assert one(spark, T.quick_cer(F.lit("ab"), F.lit(""))) == 1.0
    each, totals = M.report(pairs.withColumn("sample_id", F.monotonically_increasing_id()))
    view = sinks.report_view(each, totals)
    assert view.where("part = 2").count() == 3 and view.where("part = 1").count() == 1 and view.where("part = 0").count() == 4


def test_best_match(spark):
    truths = spark.createDataFrame([(1, "the cat sat"), (2, "a dog")], "truth_id int, truth string")
    said = spark.createDataFrame([(1, "The CAT ran"), (2, "dog a"), (3, "none"), (4, "")], "line_id int, text string")
    assert {r["line_id"]: (r["truth_id"], round(r["overlap"], 3)) for r in M.best_matches(said, truths).collect()} == {1: (1, 0.667), 2: (2, 1.0), 3: (None, 0.0), 4: (None, 0.0)}


def test_postprocess_search_and_summary(spark, lines):
    done = K.postprocess(lines)
    assert [(r["line_index"], r["is_low_confidence"]) for r in done.orderBy("line_index").collect()] == [(0, False), (1, False), (2, True)]
    assert [r["line_index"] for r in K.keyword_search(done, " HELLO ").collect()] == [0]
    assert K.keyword_search(done, "").count() == K.keyword_search(done, "zzz").count() == 0
    s = K.summaries(done).first()
    assert (s["lines"], round(s["mean_confidence"], 6), s["low_confidence_count"], s["full_text"]) == (3, 0.74, 1, "hello world\nthe quick brown fox\nlow conf line")


def mask(tokens, line=None):
    out, hidden = [], False
    for t, p in tokens:
        if p < 0.10:
            if not hidden:
                out.append("[illegible]")
            hidden = True
        else:
            hidden = False
            out.append(t)
    return " ".join(x for x in out if x).strip()


def test_masks(spark):
    rng = random.Random(3)
    groups = [[("a", 0.9), ("b", 0.05), ("c", 0.04), ("d", 0.9)], [("a", 0.9), ("b", 0.05), ("", 0.9), ("c", 0.05)]] + [[(rng.choice(["x", "", "y z"]), rng.choice([0.01, 0.5, 0.99])) for _ in range(9)] for _ in range(30)]
    rows = [(g, k, t, p) for g, tokens in enumerate(groups) for k, (t, p) in enumerate(tokens)]
    df = spark.createDataFrame(rows, "line_index int, tok_index int, tok string, p double").repartition(4)
    found = {r["line_index"]: r["text"] for r in K.masked_lines(df, "line_index").collect()}
    assert found == {g: "[illegible line]" if sum(p for _, p in t) / len(t) < 0.05 else mask(t) for g, t in enumerate(groups)}
    assert one(spark, K.masked_text(F.array(F.struct(F.lit("a").alias("tok"), F.lit(0.9).alias("p"))), F.lit(0.04))) == "[illegible line]"


def test_word_confidences(spark):
    rows = [(0, 0, " pro", 0.4), (0, 1, "paganda", 0.2), (0, 2, " Bel", 0.5), (1, 0, "Ġx", 0.9), (1, 1, "Ġ", 0.1), (1, 2, "Ġy", 0.8)]
    df = spark.createDataFrame(rows, "line_index int, tok_index int, tok string, p double")
    found = [(r["line_index"], r["word_index"], r["word"], round(r["confidence"], 3), r["low"]) for r in K.word_confidences(df, "line_index").orderBy("line_index", "word_index").collect()]
    assert found == [(0, 0, "propaganda", 0.3, True), (0, 1, "Bel", 0.5, True), (1, 0, "x", 0.9, False), (1, 1, "y", 0.8, False)]


def test_hallucination_risk(spark):
    long = " ".join(["word"] * 20)
    case = lambda text, ps, runs: one(spark, K.hallucination_risk(F.lit(text), F.array(*map(F.lit, ps)).cast("array<double>"), F.lit(runs)))
    assert case(long, [0.2, 0.3], 4) is True and case(long, [0.9], 4) is False and case(long, [0.2], 0) is False
    assert case("", [0.2], 4) is False and case(long, [], 4) is False and case("[illegible] " * 20, [0.1], 4) is False
    ink = [0.0] * 5 + [9.0] * 5 + [0.0] * 8 + [9.0] * 4 + [0.0] * 5
    assert one(spark, K.ink_words(F.array(*map(F.lit, ink)))) == 2


def test_second_opinion(spark, lines):
    seen = lines.withColumn("valid", F.lit(True))
    other = spark.createDataFrame([("d", 2, "something else"), ("d", 0, "hullo")], "doc_id string, line_index int, second_text string")
    assert [r["line_index"] for r in K.second_opinion_review(seen, other, "doc_id", "line_index").where("needs_review").collect()] == [2]


def test_confidence_table(spark, lines):
    done = K.postprocess(lines).withColumn("word_confidences", F.array().cast("array<struct<word:string,confidence:double,low:boolean>>"))
    rows = sinks.confidence_rows(done).orderBy("line_id").collect()
    assert len(rows) == 3 and rows[0]["word_id"] == "" and rows[0]["word"] == "hello world"
    assert [c for c in rows[0].asDict() if c != "doc_id"] == list(sinks.CONFIDENCE_COLUMNS)


def test_files_of_results(spark, lines, tmp_path):
    done = K.postprocess(lines).withColumn("word_confidences", F.array(F.struct(F.lit('a"b').alias("word"), F.lit(0.5).alias("confidence"), F.lit(True).alias("low"))))
    sinks.save_text(done, f"{tmp_path}/text", folders=True)
    assert "".join(p.read_text() for p in tmp_path.glob("text/doc_id=d/part-*.txt")) == "hello world\nthe quick brown fox\nlow conf line\n"
    sinks.save_confidence_csv(done, f"{tmp_path}/csv")
    back = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(f"{tmp_path}/csv")
    assert back.count() == 3 and back.first()["word"] == 'a"b' and back.first()["word_confidence"] == "0.5000"
    pdf = sinks.pdf_documents(done).first()["pdf"]
    assert bytes(pdf).startswith(b"%PDF") and b"(low conf line)" in bytes(pdf) and b"1 0 0 rg" in bytes(pdf)


def test_characters(spark):
    vocabulary = T.character_vocabulary()
    assert len(vocabulary) == 99
    table = F.create_map(*[F.lit(x) for pair in vocabulary.items() for x in pair])
    inverse = F.create_map(*[F.lit(x) for k, v in vocabulary.items() for x in (v, k)])
    ids = one(spark, T.encode_characters(F.lit("aé!"), table))
    assert ids == [1, vocabulary["a"], 3, vocabulary["!"], 2]
    assert one(spark, T.decode_characters(F.array(*map(F.lit, [*ids, 0, vocabulary["z"]])), inverse)) == "a!"


def test_correction(spark):
    assert [fuzzy.alignment_distance(a, b, 2) for a, b in (("ca", "abc"), ("ab", "ba"), ("kitten", "sitting"), ("", "ab"), ("x", "x"))] == [3, 1, 3, 2, 0]
    dictionary = spark.createDataFrame([("hello", 9), ("world", 5), ("word", 7), ("great", 3)], "term string, count long")
    rows = spark.createDataFrame([("d", 0, '# helo, wrold!'), ("d", 1, "London is grat 2024 [illegible] wrod"), ("d", 2, "zzzzzz")], "doc_id string, line_index int, raw_text string")
    found = {r["line_index"]: r["corrected_text"] for r in fuzzy.corrected(rows, dictionary).collect()}
    assert found == {0: "hello, world!", 1: "London is great 2024 [illegible] word", 2: "zzzzzz"}
    kept = {r["line_index"]: r["corrected_text"] for r in fuzzy.corrected(rows, dictionary, ["helo"]).collect()}
    assert kept[0].startswith("helo,")


def test_correction_of_lines_of_equal_and_no_keys(spark):
    dictionary = spark.createDataFrame([("hello", 9), ("world", 5)], "term string, count long")
    rows = spark.createDataFrame([("d", 0, "helo hello"), ("d", 0, "wrold xyzzy helo helo,"), ("d", 0, "helo hello"), (None, 0, "wrold"), (None, None, None), ("e", 1, "heLLo! [illegible] WRold qqqQ")], "doc_id string, line_index int, raw_text string")
    want = ["", "hello hello", "hello hello", "hello! [illegible] WRold qqqQ", "world", "world xyzzy hello hello,"]
    assert sorted(r["corrected_text"] for r in fuzzy.corrected(rows, dictionary).collect()) == want


def test_correction_moves_unknown_words_alone(spark):
    dictionary = spark.createDataFrame([("hello", 9)], "term string, count long")
    rows = spark.range(0, 4000, 1, 4).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("line_index"), F.when(F.col("id") == 7, "helo hello").otherwise(F.repeat(F.lit("hello "), 50)).alias("raw_text"))
    plan = fuzzy.corrected(rows, dictionary)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # no row for each word beside the stored unknown ones
    assert fuzzy.corrected(rows, dictionary).where("corrected_text = 'hello hello'").count() == 1


def test_correction_finds_every_near_term(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    terms = sorted({word(rng.randrange(3, 10)) for _ in range(80)})
    words = sorted({word(rng.randrange(3, 11)) for _ in range(80)})
    dictionary = spark.createDataFrame([(t, 1 + i % 5) for i, t in enumerate(terms)], "term string, count long")
    want = {}
    for w in words:
        near = sorted((fuzzy.alignment_distance(w, t, 2), -(1 + i % 5), t) for i, t in enumerate(terms))
        if near[0][0] <= 2:
            want[w] = (near[0][2], near[0][0])
    asked = spark.createDataFrame([(w,) for w in [*words, words[0], None, ""]], "word string")
    for limit in (fuzzy.GRAPH_BYTES, 0):  # walked, and joined
        assert {r["word"]: (r["term"], r["distance"]) for r in fuzzy.closest_terms(asked, dictionary, limit=limit).collect()} == want
    assert fuzzy.closest_terms(asked, dictionary.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_word_graph_walk_equals_all_pairs(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ab日🤖"[: 2 + seed]) for _ in range(n))
    terms, words = sorted({word(rng.randrange(1, 9)) for _ in range(60)}), sorted({word(rng.randrange(1, 12)) for _ in range(150)})
    counts = np.array([1 + i % 3 for i in range(len(terms))])
    shuffled = rng.sample(range(len(terms)), len(terms))
    graph = fuzzy.WordGraph([terms[i] for i in shuffled], counts[shuffled])
    for most in (0, 1, 2, 3):
        want = []
        for w in words:
            near = sorted((fuzzy.alignment_distance(w, t, most), -int(counts[i]), t) for i, t in enumerate(terms))
            want += [(w, near[0][2], near[0][0])] if near[0][0] <= most else []
        assert sorted(graph.nearest(words, most)) == sorted(want)
    assert fuzzy.WordGraph([], np.zeros(0, np.int64)).nearest(words, 2) == [] and graph.nearest([], 2) == []


def test_walks_from_both_ends_spend_one_edit_on_a_half(monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(10))
    words = [word() for _ in range(60)]
    # Near terms by two edits, in one half or in both.
    terms = sorted({w[:i] + "x" + w[i + 1 : j] + w[j + 1 :] for w in words for i in range(9) for j in range(i + 1, 10)} | {w[:4] + w[5] + w[4] + w[6:9] + "x" for w in words})
    graph = fuzzy.WordGraph(terms, np.ones(len(terms), np.int64))
    sizes = np.full(len(words), 10)
    # Without heads every pair of two edits is walked from one end; with them either end finds those of its half.
    whole = [x for x in graph.forward.within(words, 2, sizes, 2)]
    halves = graph.forward.within(words, 2, sizes // 2, 1), graph.backward.within([w[::-1] for w in words], 2, sizes // 2, 1)
    pairs = lambda found: {(w, t, d) for x in found for w, d, t in zip(*(c.tolist() for c in x), strict=True)}
    assert pairs(whole) == pairs(halves[0]) | pairs(halves[1]) and pairs(whole) > pairs(halves[0]) and pairs(whole) > pairs(halves[1])
    assert graph.nearest(["a" * 5_000_000], 2) == []  # longer than any term: not laid out


def test_decoding(spark):
    table = {(): [0, 0, 0.0, 0.6, 0.4], (3,): [0, 0, 0.5, 0.25, 0.25], (4,): [0, 0, 0.9, 0.05, 0.05]}

    def step(state, ids):
        return table.get(tuple(ids[1:]), [0, 0, 1.0, 0, 0])

    assert G.greedy(None, step, 5) == [3]
    assert G.beam(None, step, 5, 2) == [4]  # 0.4 * 0.9 beats 0.6 * 0.5
    df = spark.createDataFrame([([1.0, 5.0, 5.0],)], "x array<double>")
    assert df.select(G.likeliest("x")).first()[0] == 1
    top = df.select(G.top_k("x", 2).alias("t")).first()["t"]
    assert [t["id"] for t in top] == [1, 2] and abs(top[0]["p"] - top[1]["p"]) < 1e-12


def test_beam_takes_the_least_of_ended_and_live():
    def step(state, ids):
        return [0, 0, 0.1, 0.9]

    assert G.beam(None, step, 5, 2) == [3] * 5  # 0.9 ** 5 beats every ended one, at most 0.1


def test_beam_decode_query_keeps_long_sequences(spark):
    from linework.plans import registry

    rows = registry.QUERIES["beam_decode"](spark, "/root/testdata/sf0.001").collect()
    assert max(len(r["ids"].split()) for r in rows) == 127


@pytest.mark.parametrize("penalty", [1.0, 1.1, 3.0])
def test_batched_beams_equal_a_loop(penalty):
    """Random models over five ids, whose ends come early and late; the penalty on ids a beam has."""
    rng = np.random.default_rng(7)
    tables = rng.dirichlet([0.6] * 5, (40, 5))
    tables[::4, :, G.EOS] = 0  # without an end
    tables[1, :] = 0.2  # all alike: ties go by beam, then id

    def steps(states, ids):
        return np.log(np.maximum(tables[states[:, 0].astype(int)[:, None], ids[:, :, -1]], 1e-12))

    def plain(table, most, width):
        live, ended = [(0.0, [G.BOS])], []
        for _ in range(most):
            grown = []
            for cost, ids in live:
                price = -np.log(np.maximum(table[ids[-1]], 1e-12))
                price = [c * penalty if k in ids else c for k, c in enumerate(price.tolist())]
                grown += [(cost + price[k], [*ids, k]) for k in sorted(range(5), key=lambda k: (price[k], k))[:width]]
            live = []
            for x in sorted(grown, key=lambda x: x[0])[:width]:
                (ended if x[1][-1] == G.EOS else live).append(x)
            if not live:
                break
        return [x for x in min(ended + live, key=lambda x: x[0])[1][1:] if x != G.EOS]

    for width in (1, 3, 7):
        assert G.beams(np.arange(40)[:, None], steps, 12, width, penalty) == [plain(t, 12, width) for t in tables]


def test_decoding_null_states(spark):
    rows = spark.createDataFrame([(1, [0.1, 0.9]), (2, None)], "id int, x array<double>")
    found = {r["id"]: list(r["ids"]) for r in G.decode_batches(rows, "x", lambda states, ids: np.tile(np.log([1e-9, 1e-9, 0.3, 0.7]), (len(states), ids.shape[1], 1)), most=3, width=2).collect()}
    assert found == {1: [3, 3, 3], 2: []}


def test_losses(spark):
    import math

    rows = spark.createDataFrame([([1.0, 2.0], 0), ([1.0, 2.0], -100)], "x array<double>, y int")
    ce = -math.log(math.exp(1) / (math.exp(1) + math.exp(2)))
    assert abs(losses.focal_loss(rows, "x", "y").first()["focal_loss"] - (1 - math.exp(-ce)) ** 2 * ce) < 1e-12
    assert losses.focal_loss(rows.where("y < 0"), "x", "y").first()["focal_loss"] == 0
    log = spark.createDataFrame([("r", e, v) for e, v in enumerate([5.0, 4.0, 4.0, 4.5, 6.0, 3.0])], "run string, epoch int, v double")
    found = losses.best_so_far(log, "v", 3, "run").orderBy("epoch").collect()
    assert [r["improved"] for r in found] == [True, True, False, False, False, True]
    assert [r["stopped"] for r in found] == [False] * 4 + [True] * 2


def test_numbered_lines_are_not_sorted(spark, tmp_path):
    from linework.plans import canonical as C

    spark.createDataFrame([(1, "a\n\n \nb"), (2, None), (3, "\nc")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = K.postprocess(C.written_lines(spark, str(tmp_path)), number="number")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert sorted(map(tuple, rows.select(*K.postprocess(C.lines(spark, str(tmp_path))).columns).collect())) == sorted(map(tuple, K.postprocess(C.lines(spark, str(tmp_path))).collect()))
    assert rows.count() == 3


def test_confidence_csv_deals_text_thinly(spark, tmp_path):
    """A part's distinct lines stay under what a Parquet file keeps in a dictionary, so that a line is written once and not by its words."""
    from linework.plans import registry

    n = 1500 * spark.sparkContext.defaultParallelism
    word = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.sha2(F.concat_ws("-", "id", k.cast("string")), 512))
    spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", word).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(1).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    rows = registry.QUERIES["confidence_csv"](spark, str(tmp_path))
    parts = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("rows"), F.sum(F.when(F.col("word_id") == "1", F.octet_length("line_text"))).alias("bytes")).collect()
    assert sum(x["rows"] for x in parts) == 8 * n
    assert max(x["bytes"] for x in parts) < 1 << 20


def test_blanks_are_walked_once(spark):
    """Cleaning takes time by the length of a text, also where it has a long run of blanks, and finds them as the SQL's patterns do."""
    import time

    n = 300_000
    rows = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(" "), n), F.lit("b"), F.repeat(F.lit("."), n), F.lit("c..")).alias("t"))
    began = time.time()
    assert rows.select(F.length(T.strip("t")).alias("s"), F.length(T.clean_noise("t")).alias("c"), F.size(T.split_words("t")).alias("w")).first()[:] == (2 * n + 5, n + 4, 2)
    assert time.time() - began < 20
    signs = ["\t", "\x0b", "\x1b", "\x1c", " ", ".", "\x84", "\x85", "\xa0", "\u1680", "\u200a", "\u200b", "\u3000", "\u201c", "a", "Ell", "\U0001f600"]
    draw = random.Random(3)
    texts = spark.createDataFrame([("".join(draw.choices(signs, k=draw.randint(0, 9))),) for _ in range(4000)], "t string")
    plain = lambda c: F.regexp_replace(c, rf"^[{T.WHITE}]+|[{T.WHITE}]+\z", "")
    cleaned = plain(F.regexp_replace(F.regexp_replace(F.regexp_replace("t", T.NOISE_PREFIX, ""), rf"[{T.WHITE}.]{{2,}}\z", ""), " {2,}", " "))
    words = F.filter(F.split("t", f"[{T.WHITE}]+"), lambda w: w != "")
    assert texts.where((plain("t") != T.strip("t")) | (cleaned != T.clean_noise("t")) | (words != T.split_words("t"))).count() == 0
