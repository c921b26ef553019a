"""Every query over the document-recognition operators, with the SQL that checks it where SQL can say it."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linework import sinks
from linework.config import CONFIG
from linework.filesink import listed_files, save_files
from linework.functions import text as T
from linework.operators import boxes as B
from linework.operators import confidence as K
from linework.operators import datasets as S
from linework.operators import decoding as G
from linework.operators import fuzzy, losses, pixels, schedules
from linework.operators import metrics as M
from linework.operators import signal as P
from linework.plans import canonical as C
from linework.sources.multipage import paged_files
from linework.storage import shared_path, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
D, R = CONFIG.detection, CONFIG.recognition
#: Bytes of documents' text in a part whose rows repeat that text.
PART_BYTES = 640 << 10


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def _rounded_all(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


W = T.WHITE


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^[{W}]+|[{W}]+\\z', '', 'g')"


def cleaned(x: str) -> str:
    return stripped(f"regexp_replace(regexp_replace(regexp_replace({x}, '{T.NOISE_PREFIX}', ''), '[{W}.]{{2,}}\\z', ''), ' {{2,}}', ' ', 'g')")


def words_of(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{W}]+'), lambda w: w <> '')"


POST = f"""{C.LINES}, post AS (
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_index) - 1 AS line_index, raw_text, {cleaned('raw_text')} AS corrected_text,
           tag, confidence, confidence < 0.75 AS is_low_confidence, needs_review
    FROM lines WHERE {stripped('raw_text')} <> '')"""


# Lines and documents


@query(f"WITH {C.LINES} SELECT doc_id, line_index, raw_text, tag, confidence FROM lines")
def line_explode(spark, sf):
    return C.lines(spark, sf).select("doc_id", "line_index", "raw_text", "tag", "confidence")


@query(f"WITH {C.LINES} SELECT doc_id, line_index, {cleaned('raw_text')} AS cleaned FROM lines")
def noise_clean(spark, sf):
    return C.lines(spark, sf).select("doc_id", "line_index", T.clean_noise("raw_text").alias("cleaned"))


@query(f"WITH {POST} SELECT doc_id, line_index, corrected_text, confidence, is_low_confidence, tag FROM post")
def confidence_flags(spark, sf):
    return K.postprocess(C.written_lines(spark, sf), number="number").select("doc_id", "line_index", "corrected_text", "confidence", "is_low_confidence", "tag")


@query(
    f"""WITH {POST} SELECT doc_id, count(*) AS lines, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (is_low_confidence) AS low_confidence_count,
    md5(string_agg(corrected_text, chr(10) ORDER BY line_index)) AS text_md5 FROM post GROUP BY doc_id"""
)
def doc_summary(spark, sf):
    return K.summaries(K.postprocess(C.written_lines(spark, sf), number="number")).select("doc_id", "lines", *rounded("mean_confidence"), "low_confidence_count", F.md5("full_text").alias("text_md5"))


@query(f"WITH {POST} SELECT doc_id, line_index, corrected_text AS line_text, confidence FROM post WHERE contains(lower(corrected_text), 'tion the')")
def keyword_search(spark, sf):
    return K.keyword_search(K.postprocess(C.written_lines(spark, sf), number="number"), "  Tion The ")


@query(
    """WITH c AS (SELECT conv_id AS doc_id, turn AS line_index, coalesce(text, '') AS t FROM conversations)
    SELECT doc_id, line_index FROM c WHERE contains(lower(t), 'der')"""
)
def conversation_search(spark, sf):
    rows = C.table(spark, sf, "conversations")
    return rows.where(T.keyword_hit(F.coalesce("text", F.lit("")), "DER")).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line_index"))


@query(
    f"""WITH {POST}, s AS (SELECT doc_id, count(*) AS lines, round(avg(confidence), 6) AS mean_confidence FROM post GROUP BY doc_id)
    SELECT doc_id, coalesce(lines, 0) AS lines, coalesce(mean_confidence, 0.0) AS mean_confidence, round(strlen(coalesce(text, '')) / 64, 2) AS inference_sec FROM documents LEFT JOIN s USING (doc_id)"""
)
def batch_summary(spark, sf):
    seconds = C.table(spark, sf, "documents").select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) / 64).alias("seconds"))
    return sinks.batch_summary(K.postprocess(C.written_lines(spark, sf), number="number"), seconds, digits=6)


@query(
    f"""WITH {POST} SELECT doc_id, line_index, ((line_index // 41) + 1)::INT AS page, 792 - (line_index % 41) * 18 AS y,
    CASE WHEN is_low_confidence THEN 'red' ELSE 'black' END AS colour FROM post"""
)
def page_layout(spark, sf):
    return sinks.page_layout(K.postprocess(C.written_lines(spark, sf), number="number")).drop("corrected_text")


@query(
    f"""WITH {POST}, w AS (SELECT *, {words_of('corrected_text')} AS ws FROM post),
    e AS (SELECT *, unnest(CASE WHEN len(ws) = 0 THEN [0] ELSE range(1, len(ws) + 1) END) AS k FROM w)
    SELECT doc_id, line_index + 1 AS line_id, CASE WHEN k = 0 THEN '' ELSE k::VARCHAR END AS word_id, CASE WHEN k = 0 THEN corrected_text ELSE ws[k] END AS word,
    round(confidence, 4) AS word_confidence, is_low_confidence AS word_low_conf, round(confidence, 4) AS line_confidence, is_low_confidence AS line_low_confidence,
    needs_review AS hallucination_risk, corrected_text AS line_text FROM e"""
)
def confidence_csv(spark, sf):
    """A word's row has its whole line, so what is written repeats each line by its words. Parts of little text keep a column's distinct
    lines under the megabyte up to which a Parquet file stores each once, in its dictionary."""
    rows = K.postprocess(C.written_lines(spark, sf, PART_BYTES), number="number")
    words = F.transform(T.split_words("corrected_text"), lambda w: F.struct(w.alias("word"), F.col("confidence").alias("confidence"), F.col("is_low_confidence").alias("low")))
    return sinks.confidence_rows(rows.withColumn("word_confidences", words))


@query(
    """SELECT page_id::VARCHAR AS page_id, '{"input_image":"' || page_id || '","method":"' || ['otsu', 'adaptive_gaussian', 'sauvola'][strlen(coalesce(html, '')) % 3 + 1] || '","stages":["resize"' ||
    CASE WHEN strlen(coalesce(html, '')) % 2 = 1 THEN ',"deskew"' ELSE '' END || ',"binarise"],"timestamp":"' || strftime(TIMESTAMP '2024-01-01' + to_seconds(strlen(coalesce(html, ''))), '%Y-%m-%dT%H:%M:%S') || '"}' AS value FROM pages"""
)
def metadata_rows(spark, sf):
    size = F.octet_length(F.coalesce("html", F.lit("")))
    stages = F.array_compact(F.array(F.lit("resize"), F.when(size % 2 == 1, "deskew"), F.lit("binarise")))
    rows = C.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("page_id"), F.element_at(F.array(*map(F.lit, pixels.METHODS)), (size % 3 + 1).cast("int")).alias("method"), stages.alias("stages"), size.alias("size"))
    stamp = F.date_format(F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("size")), "yyyy-MM-dd'T'HH:mm:ss")
    return sinks.metadata_json(rows, stamp)


# Metrics


@query(f"WITH {C.PAIRS} SELECT round(sum(levenshtein(prediction, reference)) / sum(greatest(1, length(reference))), 6) AS cer, count(*) AS num_pairs FROM pairs")
def cer_overall(spark, sf):
    return M.character_error_rate(C.eval_pairs(spark, sf)).select(*rounded("cer"), "num_pairs")


BY_TAG = f"""WITH {C.PAIRS}, e AS (SELECT tag, levenshtein(prediction, reference) AS d, length(reference) AS n FROM pairs)
    SELECT CASE WHEN grouping(tag) = 1 THEN 'all' ELSE tag END AS tag, round(sum(d) / sum(greatest(1, n)), 6) AS cer, count(*) AS num_pairs, sum(d)::BIGINT AS edits, sum(n)::BIGINT AS chars
    FROM e GROUP BY GROUPING SETS ((tag), ())"""


@query(BY_TAG)
def cer_by_difficulty(spark, sf):
    return M.rates_by_tag(C.eval_pairs(spark, sf)).select("tag", *rounded("cer"), "num_pairs", "edits", "chars")


@query(
    f"""WITH {C.PAIRS} SELECT doc_id, line_index, levenshtein(prediction, reference) AS edits, round(levenshtein(prediction, reference) / greatest(1, length(reference)), 6) AS cer,
    round(CASE WHEN reference = '' THEN 1.0 ELSE levenshtein(prediction, reference) / length(reference) END, 6) AS quick_cer FROM pairs"""
)
def sample_report(spark, sf):
    rows = M.with_errors(C.eval_pairs(spark, sf), words=False)
    return rows.select("doc_id", "line_index", F.col("char_edits").alias("edits"), F.round(F.col("char_edits") / F.greatest(F.lit(1), F.col("chars")), 6).alias("cer"), F.round(T.quick_cer("prediction", "reference"), 6).alias("quick_cer"))


#: Edits of words: each line's distinct words become one character each, as far as there are that many; in lines of more, the
#: corruption, which keeps words in their places, makes as many edits as places differ.
WORD_EDITS = f"""{C.PAIRS}, ws AS (SELECT *, {words_of('prediction')} AS p, {words_of('reference')} AS r FROM pairs), kinds AS (SELECT *, list_distinct(list_concat(p, r)) AS kinds FROM ws),
    we AS (SELECT doc_id, line_index, tag, needs_review, levenshtein(prediction, reference) AS d, length(reference) AS n, len(r) AS words,
    CASE WHEN len(kinds) <= 90 THEN levenshtein(array_to_string(list_transform(p, lambda w: chr((32 + list_position(kinds, w))::INT)), ''), array_to_string(list_transform(r, lambda w: chr((32 + list_position(kinds, w))::INT)), ''))
    ELSE len(list_filter(list_zip(p, r), lambda z: z[1] IS DISTINCT FROM z[2])) END AS wd FROM kinds)"""


def _rates(kind: str, where: str) -> str:
    part = f" FILTER (WHERE {where})" if where else ""
    return f"""round(coalesce(sum(d){part} / sum(greatest(1, n)){part}, 0), 6) AS cer{kind}, round(coalesce(sum(wd){part} / sum(greatest(1, words)){part}, 0), 6) AS wer{kind}"""


@query(
    f"""WITH {WORD_EDITS}, s AS (SELECT * REPLACE (CASE WHEN (doc_id + line_index) % 13 <> 0 THEN d END AS d, CASE WHEN (doc_id + line_index) % 13 <> 0 THEN wd END AS wd,
      CASE WHEN (doc_id + line_index) % 13 <> 0 THEN greatest(1, n) END AS n, CASE WHEN (doc_id + line_index) % 13 <> 0 THEN greatest(1, words) END AS words) FROM we)
    SELECT round(sum(d) / sum(n), 6) AS cer, round(sum(wd) / sum(words), 6) AS wer, round(greatest(0, 1 - sum(wd) / sum(words)), 6) AS accuracy, count(*) AS num_samples, 0.0::DOUBLE AS inference_time_sec,
    round(coalesce(sum(d) FILTER (tag = 'clean') / sum(n) FILTER (tag = 'clean'), 0), 6) AS cer_clean, round(coalesce(sum(wd) FILTER (tag = 'clean') / sum(words) FILTER (tag = 'clean'), 0), 6) AS wer_clean, count(*) FILTER (tag = 'clean') AS num_clean,
    round(coalesce(sum(d) FILTER (tag = 'hard') / sum(n) FILTER (tag = 'hard'), 0), 6) AS cer_hard, round(coalesce(sum(wd) FILTER (tag = 'hard') / sum(words) FILTER (tag = 'hard'), 0), 6) AS wer_hard, count(*) FILTER (tag = 'hard') AS num_hard,
    count(*) FILTER (needs_review) AS num_needs_review FROM s"""
)
def eval_report(spark, sf):
    """Predictions of all lines; every thirteenth line has no reference."""
    rows = C.eval_pairs(spark, sf)
    truth = rows.where((F.col("doc_id") + F.col("line_index")) % 13 != 0).select("doc_id", "line_index", "reference")
    return _rounded_all(M.evaluate(M.paired(rows.drop("reference"), truth, "doc_id", "line_index", every=True)))


@query(
    f"""WITH {WORD_EDITS} SELECT CASE WHEN grouping(tag) = 1 THEN 'all' ELSE tag END AS tag, round(sum(d) / sum(greatest(1, n)), 6) AS cer, count(*) AS num_pairs, sum(d)::BIGINT AS edits, sum(n)::BIGINT AS chars,
    round(sum(wd) / sum(greatest(1, words)), 6) AS wer FROM we GROUP BY GROUPING SETS ((tag), ())"""
)
def wer_by_difficulty(spark, sf):
    return _rounded_all(M.rates_by_tag(C.eval_pairs(spark, sf), words=True))


@query(
    f"""WITH {C.PAIRS}, w AS (SELECT doc_id, line_index, list_distinct({words_of('lower(reference)')}) AS r, {words_of('lower(prediction)')} AS p FROM pairs)
    SELECT doc_id, line_index, round(CASE WHEN len(r) = 0 THEN 1.0 ELSE len(list_intersect(r, p)) / len(r) END, 6) AS word_accuracy FROM w"""
)
def word_accuracy(spark, sf):
    return M.word_accuracy(C.eval_pairs(spark, sf)).select("doc_id", "line_index", *rounded("word_accuracy"))


@query(
    f"""WITH {C.LINES}, truths AS (SELECT item_id AS truth_id, list_distinct({words_of('lower(text)')}) AS ws FROM benchmark), tw AS (SELECT truth_id, unnest(ws) AS word FROM truths),
    sizes AS (SELECT truth_id, len(ws) AS size FROM truths), pw AS (SELECT doc_id, line_index, unnest(list_distinct({words_of('lower(raw_text)')})) AS word FROM lines),
    met AS (SELECT doc_id, line_index, truth_id, count(*) / any_value(size) AS score FROM pw JOIN tw USING (word) JOIN sizes USING (truth_id) GROUP BY ALL)
    SELECT l.doc_id, l.line_index, round(coalesce(max(score), 0.0), 6) AS overlap FROM lines l LEFT JOIN met m ON l.doc_id = m.doc_id AND l.line_index = m.line_index GROUP BY ALL"""
)
def best_match(spark, sf):
    said = C.lines(spark, sf).select(F.struct("doc_id", "line_index").alias("line_id"), F.col("raw_text").alias("text"))
    found = M.best_matches(said, C.table(spark, sf, "benchmark").select(F.col("item_id").alias("truth_id"), F.col("text").alias("truth")))
    return found.select("line_id.doc_id", "line_id.line_index", *rounded("overlap"))


# Tokens and confidences


@query(
    f"""WITH {C.TOKENS}, s AS (SELECT *, sum(CASE WHEN tok[1] = ' ' OR tok_index = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY line_index ORDER BY tok_index) AS k FROM tokens),
    w AS (SELECT line_index, k, trim(string_agg(ltrim(tok), '' ORDER BY tok_index)) AS word, avg(p) AS confidence FROM s GROUP BY line_index, k)
    SELECT line_index, row_number() OVER (PARTITION BY line_index ORDER BY k) - 1 AS word_index, word, round(confidence, 6) AS confidence, confidence < 0.75 AS low FROM w WHERE word <> ''"""
)
def word_confidence(spark, sf):
    return K.word_confidences(C.tokens(spark, sf), "line_index").select("line_index", "word_index", "word", *rounded("confidence"), "low")


@query(
    f"""WITH {C.TOKENS}, s AS (SELECT *, p < {R.token_floor} AS low, lag(p < {R.token_floor}, 1, false) OVER (PARTITION BY line_index ORDER BY tok_index) AS before FROM tokens)
    SELECT line_index, round(avg(p), 6) AS confidence, CASE WHEN avg(p) < {R.line_floor} THEN '{R.illegible_line}' ELSE
    trim(coalesce(string_agg(CASE WHEN low THEN '{R.illegible}' ELSE tok END, ' ' ORDER BY tok_index) FILTER (CASE WHEN low THEN NOT before ELSE tok <> '' END), '')) END AS text FROM s GROUP BY line_index"""
)
def illegible_mask(spark, sf):
    return K.masked_lines(C.tokens(spark, sf), "line_index").select("line_index", *rounded("confidence"), "text")


@query(f"WITH {C.TOKENS} SELECT line_index, tok_index, tok, round(p, 6) AS p FROM tokens")
def softmax_confidence(spark, sf):
    return C.tokens(spark, sf).select("line_index", "tok_index", "tok", *rounded("p"))


@query(
    f"""WITH {C.STEPS}, e AS (SELECT line_index, tok_index, unnest(range(len(logits))) AS id, unnest(logits) AS x FROM steps), z AS (SELECT *, max(x) OVER w AS m FROM e WINDOW w AS (PARTITION BY line_index, tok_index)),
    p AS (SELECT *, exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY line_index, tok_index) AS p, row_number() OVER (PARTITION BY line_index, tok_index ORDER BY x DESC, id) AS rank FROM z)
    SELECT line_index, tok_index, rank, id, round(p, 6) AS p FROM p WHERE rank <= 3"""
)
def topk_tokens(spark, sf):
    rows = C.steps(spark, sf).select("line_index", "tok_index", F.posexplode(G.top_k("logits", 3)).alias("pos", "t"))
    return rows.select("line_index", "tok_index", (F.col("pos") + 1).alias("rank"), "t.id", F.round("t.p", 6).alias("p"))


@query(
    f"""WITH {C.STEPS}, g AS (SELECT line_index, tok_index, list_position(logits, list_max(logits)) - 1 AS id, 1 / list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))) AS p FROM steps),
    e AS (SELECT line_index, min(tok_index) AS stop FROM g WHERE id = {T.EOS} GROUP BY line_index) SELECT g.line_index, tok_index, id, round(p, 6) AS p FROM g LEFT JOIN e ON g.line_index = e.line_index WHERE stop IS NULL OR tok_index < stop"""
)
def greedy_tokens(spark, sf):
    return _rounded_all(G.step_tokens(C.steps(spark, sf), "logits", "line_index"))


def _state_steps(states, ids):
    """A stand-in model: the state's scores turned by the last id. Its costs are multiples of 2^-20, so that sums are exact and ties are ties."""
    x = states - states.max(1, keepdims=True)
    price = np.rint((np.log(np.exp(x).sum(1, keepdims=True)) - x) * 2**20) / 2**20
    turned = (np.arange(states.shape[1]) - ids[:, :, -1:]) % states.shape[1]
    return -np.take_along_axis(price[:, None, :], turned, 2)


def _beam_sql(penalty: float, most: int) -> str:
    """Beams as a recursive table: the next ids' costs of a state turned by the last id, the five best of a beam, the five best of a row."""
    again = f"CASE WHEN list_contains(ids, (k + ids[-1]) % 64) THEN {penalty} ELSE 1 END" if penalty != 1 else "1"
    return f"""WITH RECURSIVE {C.STEPS}, e AS (SELECT line_index, tok_index, unnest(range(64)) AS k, unnest(list_transform(logits, lambda x: x - list_max(logits))) AS x FROM steps),
    p AS (SELECT *, least(round((ln(sum(exp(x)) OVER (PARTITION BY line_index, tok_index)) - x) * 1048576) / 1048576, -ln(1e-12)) AS c FROM e),
    prices AS (SELECT *, row_number() OVER (PARTITION BY line_index, tok_index ORDER BY c, k) AS nth FROM p),
    f AS (SELECT line_index, tok_index, 0 AS t, 1 AS slot, 0.0::DOUBLE AS cost, [{T.BOS}] AS ids, false AS ended FROM steps UNION ALL
      SELECT line_index, tok_index, t + 1, row_number() OVER (PARTITION BY line_index, tok_index ORDER BY cost, slot, price, id), cost, list_append(ids, id), id = {T.EOS}
      FROM (SELECT line_index, tok_index, t, slot, price, cost + price AS cost, ids, id FROM
              (SELECT line_index, tok_index, t, slot, cost, ids, ((k + ids[-1]) % 64)::INT AS id, c * {again} AS price
               FROM (SELECT * FROM f WHERE NOT ended AND t < {most}) JOIN prices USING (line_index, tok_index) WHERE nth <= {8 if penalty == 1 else 64})
            QUALIFY row_number() OVER (PARTITION BY line_index, tok_index, slot ORDER BY price, id) <= 5)
      QUALIFY row_number() OVER (PARTITION BY line_index, tok_index ORDER BY cost, slot, price, id) <= 5)
    SELECT line_index, tok_index, array_to_string(list_filter(ids[2:], lambda x: x <> {T.EOS}), ' ') AS ids FROM f WHERE ended OR t = {most}
    QUALIFY row_number() OVER (PARTITION BY line_index, tok_index ORDER BY cost, ended DESC, t, slot) = 1"""


def _decoded(spark, sf, most: int, penalty: float):
    rows = C.steps(spark, sf).select("line_index", "tok_index", "logits")
    found = G.decode_batches(rows, "logits", _state_steps, most=most, width=5, penalty=penalty)
    return found.select("line_index", "tok_index", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(_beam_sql(1, 127))
def beam_decode(spark, sf):
    # The reference's max_text_length of 128 counts the begin token; its beam width is 5.
    return _decoded(spark, sf, 127, 1.0)


@query(_beam_sql(1.125, 64))
def penalised_decode(spark, sf):
    """Up to the reference's 64 new ids, those a beam has already costing more: by 9/8, so that sums stay exact (1.1 is in the tests)."""
    return _decoded(spark, sf, 64, 1.125)


@query(
    f"""WITH {C.STEPS}, c AS (SELECT ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits))))) + list_max(logits) - logits[label + 1] AS ce FROM steps WHERE label <> 1)
    SELECT round(coalesce(sum(power(1 - exp(-ce), 2.0) * ce), 0.0) / greatest(1, count(*)), 6) AS focal_loss, count(*) AS n_labels FROM c"""
)
def focal_loss(spark, sf):
    rows = C.steps(spark, sf).withColumn("target", F.when(F.col("label") == 1, CONFIG.training.ignore_index).otherwise(F.col("label")))
    return losses.focal_loss(rows, "logits", "target").select(*rounded("focal_loss"), "n_labels")


@query(
    """WITH p AS (SELECT label, 1 / (1 + exp(-40 * unnest(embedding)::DOUBLE)) AS pred, (unnest(range(64)) % 3 = 0)::INT::DOUBLE AS target FROM embeddings)
    SELECT label, round((sum(CASE WHEN pred > 0.5 AND target > 0.5 THEN 1 ELSE 0 END) + 1e-6) / (sum(CASE WHEN pred > 0.5 OR target > 0.5 THEN 1 ELSE 0 END) + 1e-6), 6) AS iou,
    round(1 - (2 * sum(pred * target) + 1) / (sum(pred) + sum(target) + 1), 6) AS dice_loss FROM p GROUP BY label"""
)
def iou_dice(spark, sf):
    rows = C.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "e"))
    rows = rows.select("label", (1 / (1 + F.exp(-40 * F.col("e").cast("double")))).alias("pred"), (F.col("i") % 3 == 0).cast("double").alias("target"))
    return losses.overlap_scores(rows, "label").select("label", *rounded("iou", "dice_loss"))


@query(
    f"""WITH {C.TOKENS}, cols AS (SELECT line_index, tok_index * 4 + k AS x, CASE WHEN k = 0 THEN p ELSE 0.0 END AS v FROM tokens, (SELECT unnest(range(4)) AS k)),
    sm AS (SELECT line_index, x, sum(v) OVER (PARTITION BY line_index ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS s FROM cols), lit AS (SELECT line_index, x, s > max(s) OVER (PARTITION BY line_index) * 0.05 AS is_on FROM sm),
    runs AS (SELECT line_index, count(*) FILTER (is_on AND NOT before) AS runs FROM (SELECT *, lag(is_on, 1, false) OVER (PARTITION BY line_index ORDER BY x) AS before FROM lit) GROUP BY line_index),
    said AS (SELECT line_index, avg(p) AS mean, string_agg(tok, ' ' ORDER BY tok_index) AS t FROM tokens GROUP BY line_index),
    n AS (SELECT line_index, mean, t, len(list_filter({words_of('t')}, lambda w: w[1] <> '[')) AS n FROM said)
    SELECT line_index, runs::INT AS ink_words, CASE WHEN trim(t) = '' OR mean >= {R.risk_confidence} OR runs = 0 THEN false ELSE greatest(1, n) / greatest({R.risk_min_words}, runs) > {R.risk_ratio} END AS risk FROM n JOIN runs USING (line_index)"""
)
def hallucination_flags(spark, sf):
    tokens = C.tokens(spark, sf).groupBy("line_index").agg(F.array_sort(F.collect_list(F.struct("tok_index", "tok", "p"))).alias("ts"))
    shown = F.array_join(F.transform("ts", lambda t: t["tok"]), " ")
    ink = F.flatten(F.transform("ts", lambda t: F.array(t["p"], F.lit(0.0), F.lit(0.0), F.lit(0.0))))
    return tokens.select("line_index", K.hallucination_risk(shown, F.transform("ts", lambda t: t["p"]), K.ink_words(ink)).alias("risk"), K.ink_words(ink).alias("ink_words"))


@query(
    """WITH v AS (SELECT map_from_entries(list_transform(range(32, 127), lambda c: {'k': chr(c::INT), 'v': c - 28})) AS m), b AS (SELECT item_id, regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '?', 'g') AS t FROM benchmark)
    SELECT item_id, length(t) + 2 AS n, md5(array_to_string(list_concat([1], list_transform(CASE WHEN t = '' THEN [] ELSE string_split(t, '') END, lambda c: coalesce(m[c], 3)), [2]), ',')) AS ids_md5 FROM b, v"""
)
def character_ids(spark, sf):
    vocabulary = F.from_json(F.lit(json.dumps(T.character_vocabulary())), "map<string,int>")
    ids = T.encode_characters(C.ascii_only(F.coalesce("text", F.lit(""))), vocabulary)
    return C.table(spark, sf, "benchmark").select("item_id", F.size(ids).alias("n"), F.md5(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")).alias("ids_md5"))


# Profiles

GAUSS = P.gaussian_weights(D.smooth_window)
SMOOTH = (
    f"{C.PROFILE}, smoothed AS (SELECT page_id, y, ink, "
    + " + ".join(f"{w!r}::DOUBLE * coalesce({'lag' if k >= 5 else 'lead'}(ink, {abs(k - 5)}) OVER o, 0)" for k, w in enumerate(GAUSS))
    + " AS smooth FROM profile WINDOW o AS (PARTITION BY page_id ORDER BY y))"
)
CUTS = f"""{SMOOTH}, peaks AS (SELECT *, max(smooth) OVER (PARTITION BY page_id) AS peak FROM smoothed), low AS (SELECT *, peak > 0 AND smooth < peak * {D.valley_depth} AS is_low FROM peaks),
    st AS (SELECT *, is_low AND NOT lag(is_low, 1, false) OVER o AS is_start, lead(y) OVER o AS next_y FROM low WINDOW o AS (PARTITION BY page_id ORDER BY y)),
    isl AS (SELECT *, sum(is_start::INT) OVER (PARTITION BY page_id ORDER BY y) AS run FROM st),
    cuts AS (SELECT page_id, ((min(y) + max_by(next_y, y)) // 2)::INT AS cut FROM isl WHERE is_low GROUP BY page_id, run HAVING max_by(coalesce(next_y, -1), y) >= 0)"""
SEAMS = f"""{CUTS}, seams AS (SELECT DISTINCT page_id, y AS cut FROM (SELECT c.page_id, c.cut, p.y, row_number() OVER (PARTITION BY c.page_id, c.cut ORDER BY p.ink, p.y) AS r
    FROM cuts c JOIN profile p ON p.page_id = c.page_id AND p.y BETWEEN c.cut - {D.seam} AND c.cut + {D.seam}) WHERE r = 1)"""


@query(f"WITH {SMOOTH} SELECT page_id, y, round(smooth, 6) AS smooth FROM smoothed")
def smooth_profile(spark, sf):
    return P.smooth(C.profile(spark, sf)).select("page_id", "y", *rounded("smooth"))


@query(f"WITH {CUTS} SELECT page_id, cut FROM cuts")
def valley_cuts(spark, sf):
    return P.valley_cuts(C.profile(spark, sf))


@query(f"WITH {SEAMS} SELECT page_id, cut FROM seams")
def seam_cuts(spark, sf):
    rows = C.profile(spark, sf)
    return P.refined_cuts(rows, P.valley_cuts(rows))


BANDS = f"""{SEAMS}, banded AS (SELECT p.page_id, p.y, p.ink, count(s.cut) OVER (PARTITION BY p.page_id ORDER BY p.y) AS band FROM profile p LEFT JOIN seams s ON s.page_id = p.page_id AND s.cut = p.y),
    bands AS (SELECT page_id, 0 AS x1, min(y)::INT AS y1, {C.PAGE_WIDTH} AS x2, (max(y) + 1)::INT AS y2 FROM banded GROUP BY page_id, band HAVING max(y) + 1 - min(y) >= {D.min_height} AND sum(ink) >= 5)"""


def _sizes(rows):
    return rows.select("page_id").distinct().withColumn("width", F.lit(C.PAGE_WIDTH)).withColumn("height", F.lit(C.SLOTS))


@query(f"WITH {BANDS} SELECT page_id, x1, y1, x2, y2 FROM bands")
def profile_boxes(spark, sf):
    rows = C.profile(spark, sf)
    return P.profile_boxes(rows, _sizes(rows))


@query(
    f"""WITH {C.PROFILE}, k AS (SELECT *, max(ink) OVER (PARTITION BY page_id) AS peak FROM profile), o AS (SELECT *, peak > 0 AND ink > peak * {D.peak_share} AS is_on FROM k)
    SELECT page_id, count(*) FILTER (is_on AND NOT before) AS runs FROM (SELECT *, lag(is_on, 1, false) OVER (PARTITION BY page_id ORDER BY y) AS before FROM o) GROUP BY page_id"""
)
def run_count(spark, sf):
    return P.run_count(C.profile(spark, sf))


@query(
    f"""WITH {C.PROFILE}, s AS (SELECT page_id, y, sum(ink) OVER (PARTITION BY page_id ORDER BY y ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) / 11 AS smooth FROM profile), k AS (SELECT *, max(smooth) OVER (PARTITION BY page_id) AS peak FROM s),
    o AS (SELECT *, peak > 0 AND smooth > peak * 0.08 AS is_on FROM k), st AS (SELECT *, is_on AND NOT lag(is_on, 1, false) OVER w AS is_start, lead(y) OVER w AS next_y FROM o WINDOW w AS (PARTITION BY page_id ORDER BY y)),
    r AS (SELECT *, sum(is_start::INT) OVER (PARTITION BY page_id ORDER BY y) AS run FROM st), runs AS (SELECT page_id, min(y) AS a, coalesce(max_by(coalesce(next_y, 143), y), 143) AS b FROM r WHERE is_on GROUP BY page_id, run)
    SELECT page_id, greatest(0, a - {D.padding})::INT AS y1, least({C.SLOTS}, b + {D.padding})::INT AS y2 FROM runs WHERE b - a >= {D.min_height}"""
)
def run_boxes(spark, sf):
    return P.run_boxes(C.profile(spark, sf))


@query(
    f"""SELECT vec_id, CASE WHEN max(ink) > 0 AND var_pop(ink) / (max(ink) * max(ink)) > {D.hard_variance} THEN 'hard' ELSE 'clean' END AS difficulty_tag
    FROM (SELECT vec_id, (unnest(embedding)::DOUBLE > 0)::INT * 3.0::DOUBLE AS ink FROM embeddings) GROUP BY vec_id"""
)
def difficulty_tags(spark, sf):
    rows = C.table(spark, sf, "embeddings").select("vec_id", F.explode("embedding").alias("e")).select("vec_id", ((F.col("e").cast("double") > 0).cast("int") * 3.0).alias("ink"))
    return P.difficulty(rows, "vec_id")


@query(
    """WITH h AS (SELECT lang AS grp, (ascii(upper(substr(text, 1, 1))) + doc_id) % 256 AS level, count(*) AS n FROM documents WHERE length(text) > 0 GROUP BY ALL),
    c AS (SELECT grp, level, sum(n) OVER w AS n0, sum(n * level) OVER w AS s0, sum(n) OVER (PARTITION BY grp) AS n, sum(n * level) OVER (PARTITION BY grp) AS s FROM h WINDOW w AS (PARTITION BY grp ORDER BY level)),
    v AS (SELECT grp, level, CASE WHEN n0 > 0 AND n0 < n THEN round(n0::DOUBLE * (n - n0) * power(s0 / n0 - (s - s0) / (n - n0), 2), 6) ELSE 0 END AS v FROM c)
    SELECT grp, arg_max(level, (v, -level)) AS threshold FROM v GROUP BY grp"""
)
def otsu_threshold(spark, sf):
    docs = C.table(spark, sf, "documents").where(F.length("text") > 0)
    level = (F.ascii(F.upper(F.substring("text", 1, 1))) + F.col("doc_id")) % 256
    return P.otsu(docs.groupBy(F.col("lang").alias("grp"), level.alias("level")).agg(F.count("*").alias("n")), "grp")


@query(
    f"""WITH {C.BOXES}, h AS (SELECT *, y2 - y1 AS height FROM boxes), s AS (SELECT page_id, median(height) AS median_height FROM h GROUP BY page_id)
    SELECT h.page_id, seq, height, median_height FROM h JOIN s ON h.page_id = s.page_id WHERE height > median_height * {D.tall_ratio}"""
)
def height_outliers(spark, sf):
    empty = C.profile(spark, sf).select(F.col("page_id").cast("long").alias("page_id"), "y", "ink")
    return P.verify_segmentation(empty, C.boxes(spark, sf))[1]


@query(
    f"""WITH {BANDS}, o AS (SELECT *, peak > 0 AND smooth > peak * {D.peak_share} AS is_on FROM peaks),
    r AS (SELECT page_id, count(*) FILTER (is_on AND NOT before) AS rises FROM (SELECT *, lag(is_on, 1, false) OVER (PARTITION BY page_id ORDER BY y) AS before FROM o) GROUP BY page_id),
    st2 AS (SELECT page_id, count(*) AS n, median(y2 - y1)::DOUBLE AS med FROM bands GROUP BY page_id), tall AS (SELECT b.page_id, count(*) AS tall FROM bands b JOIN st2 USING (page_id) WHERE y2 - y1 > med * {D.tall_ratio} GROUP BY b.page_id),
    f AS (SELECT r.page_id, CASE WHEN n > 0 THEN rises ELSE 0 END AS peak_estimate, coalesce(n, 0) AS detected_count, med AS median_height, coalesce(tall, 0) AS merged_count FROM r LEFT JOIN st2 USING (page_id) LEFT JOIN tall USING (page_id)),
    g AS (SELECT *, detected_count < peak_estimate * {D.peak_tolerance} AS too_few FROM f)
    SELECT *, CASE WHEN detected_count = 0 THEN 'No lines detected.' WHEN too_few OR merged_count > 0 THEN 'Line segmentation warning: ' ||
    concat_ws('; ', CASE WHEN too_few THEN 'detected ' || detected_count || ' but projection suggests ~' || peak_estimate END, CASE WHEN merged_count > 0 THEN merged_count || ' crop(s) may be merged lines' END) END AS warning FROM g"""
)
def segmentation_check(spark, sf):
    rows = C.profile(spark, sf)
    return P.verify_segmentation(rows, P.profile_boxes(rows, _sizes(rows)).withColumn("seq", F.col("y1")))[0]


# Boxes


@query(f"WITH {C.BOXES} SELECT page_id, greatest(1.0, list_sort(list(y2 - y1))[(count(*) // 2) + 1])::DOUBLE AS line_height FROM boxes GROUP BY page_id")
def upper_median(spark, sf):
    return B.upper_medians(C.boxes(spark, sf), F.col("y2") - F.col("y1"), "page_id", name="line_height")


@query(f"WITH {C.BOXES} SELECT page_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM boxes GROUP BY page_id")
def merged_bbox(spark, sf):
    return B.hull(C.boxes(spark, sf), "page_id")


@query(
    f"""WITH {C.BOXES}, p AS (SELECT page_id, seq, greatest(0, x1 - 4) AS x1, greatest(0, y1 - 4) AS y1, least(700, x2 + 4) AS x2, least({C.PAGE_HEIGHT}, y2 + 4) AS y2 FROM boxes)
    SELECT * FROM p WHERE y2 - y1 >= 8 AND x2 - x1 >= 8"""
)
def padded_boxes(spark, sf):
    return B.padded(C.boxes(spark, sf), F.lit(700), F.lit(C.PAGE_HEIGHT))


@query(f"WITH {C.BOXES} SELECT page_id, seq, trunc(x1 * 0.51)::INT // 2 AS x1, trunc(y1 * 0.37)::INT // 2 AS y1, trunc(x2 * 0.51)::INT // 2 AS x2, trunc(y2 * 0.37)::INT // 2 AS y2 FROM boxes")
def scaled_boxes(spark, sf):
    return B.scaled(C.boxes(spark, sf), 0.51, 0.37)


@query(
    f"""WITH {C.BOXES}, pts AS (SELECT row_number() OVER () AS rid, page_id, seq AS point_id, (y1 + y2) / 2 + seq % 40 AS cy FROM boxes),
    r AS (SELECT p.page_id, point_id, b.seq, abs(cy - (y1 + y2) / 2) AS distance, row_number() OVER (PARTITION BY rid ORDER BY abs(cy - (y1 + y2) / 2), b.seq) AS k FROM pts p JOIN boxes b ON p.page_id = b.page_id)
    SELECT page_id, point_id, seq, distance FROM r WHERE k = 1"""
)
def nearest_line(spark, sf):
    rows = C.boxes(spark, sf)
    points = rows.select("page_id", F.col("seq").alias("point_id"), ((F.col("y1") + F.col("y2")) / 2.0 + F.col("seq") % 40).alias("cy"))
    return B.nearest_line(points, rows)


@query(
    f"""WITH {C.BOXES}, s AS (SELECT page_id, seq, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, y1, y2 FROM boxes),
    n AS (SELECT *, lead(seq) OVER o AS next_seq, lead(cx) OVER o AS nx, lead(cy) OVER o AS ny, lead(y1) OVER o AS ny1 FROM s WINDOW o AS (PARTITION BY page_id ORDER BY cy, seq))
    SELECT page_id, seq, next_seq, (cx + nx) / 2 AS mx, (cy + ny) / 2 AS my, ny1 - y2 AS gap FROM n WHERE next_seq IS NOT NULL"""
)
def adjacent_midpoints(spark, sf):
    return B.adjacent(C.boxes(spark, sf))


def _turned(c: str, a: str, b: str) -> str:
    x, y = f"({a} - 500.0)", f"({b} - 700.0)"
    return f"(cos(t) * {x} + sin(t) * {y} + 500.0)" if c == "x" else f"(cos(t) * {y} - sin(t) * {x} + 700.0)"


CORNERS = {c: ", ".join(_turned(c, a, b) for a in ("x1", "x2") for b in ("y1", "y2")) for c in "xy"}


@query(
    f"""WITH {C.BOXES}, a AS (SELECT *, radians((page_id % 7 - 3)::DOUBLE) AS t, page_id % 2 = 0 AS f FROM boxes),
    r AS (SELECT page_id, seq, f, least(greatest(trunc(least({CORNERS['x']}))::INT, 0), 999) AS a1, least(greatest(trunc(greatest({CORNERS['x']}))::INT, 0), 999) AS a2,
    least(greatest(trunc(least({CORNERS['y']}))::INT, 0), 1399) AS y1, least(greatest(trunc(greatest({CORNERS['y']}))::INT, 0), 1399) AS y2 FROM a)
    SELECT page_id, seq, CASE WHEN f THEN 1000 - a2 ELSE a1 END AS x1, y1, CASE WHEN f THEN 1000 - a1 ELSE a2 END AS x2, y2 FROM r WHERE a2 > a1 AND y2 > y1"""
)
def rotate_flip_boxes(spark, sf):
    rows = C.boxes(spark, sf)
    return B.rotated(rows, F.lit(C.PAGE_WIDTH), F.lit(C.PAGE_HEIGHT), (F.col("page_id") % 7 - 3).cast("double"), F.col("page_id") % 2 == 0)


@query(f"WITH {C.BOXES} SELECT page_id, seq, row_number() OVER (PARTITION BY page_id ORDER BY y1, seq) - 1 AS rank FROM boxes")
def box_order(spark, sf):
    return B.in_order(C.boxes(spark, sf)).select("page_id", "seq", "rank")


@query(
    f"""WITH RECURSIVE {C.BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y1, seq, x1, x2, y2) AS k FROM boxes),
    f AS (SELECT page_id, k, 0 AS m, x1, y1, x2, y2 FROM o WHERE k = 1 UNION ALL
      SELECT page_id, k, CASE WHEN meet THEN m ELSE m + 1 END, CASE WHEN meet THEN least(a1, x1) ELSE x1 END, CASE WHEN meet THEN least(b1, y1) ELSE y1 END, CASE WHEN meet THEN greatest(a2, x2) ELSE x2 END, CASE WHEN meet THEN greatest(b2, y2) ELSE y2 END
      FROM (SELECT o.*, f.m, f.x1 AS a1, f.y1 AS b1, f.x2 AS a2, f.y2 AS b2, least(o.y2 - o.y1, f.y2 - f.y1) > 0 AND (least(o.y2, f.y2) - greatest(o.y1, f.y1)) / least(o.y2 - o.y1, f.y2 - f.y1) > {D.merge_overlap} AS meet
            FROM f JOIN o ON o.page_id = f.page_id AND o.k = f.k + 1))
    SELECT page_id, m AS seq, x1, y1, x2, y2 FROM f QUALIFY row_number() OVER (PARTITION BY page_id, m ORDER BY k DESC) = 1"""
)
def merge_boxes(spark, sf):
    return B.merged(C.boxes(spark, sf))


def _grouped(ratio: float) -> str:
    """SQL of the line of each word: a fold over a page's words with the lines' ranges so far as a list."""
    return f"""{C.BOXES}, med AS (SELECT page_id, greatest(1.0, list_sort(list(y2 - y1))[(count(*) // 2) + 1])::DOUBLE * {ratio} AS reach FROM boxes GROUP BY page_id),
    o AS (SELECT b.*, reach, (y1 + y2) / 2 AS mid, row_number() OVER (PARTITION BY page_id ORDER BY (y1 + y2) / 2, seq, x1, y1, x2, y2) AS k FROM boxes b JOIN med USING (page_id)),
    f AS (SELECT page_id, k, [{{'a': y1, 'b': y2}}] AS g, 1 AS line FROM o WHERE k = 1 UNION ALL
      SELECT page_id, k, CASE WHEN place IS NULL OR place = 0 THEN list_append(g, {{'a': y1, 'b': y2}}) ELSE list_transform(g, lambda r, i: CASE WHEN i = place THEN {{'a': least(r.a, y1), 'b': greatest(r.b, y2)}} ELSE r END) END,
             CASE WHEN place IS NULL OR place = 0 THEN len(g) + 1 ELSE place END
      FROM (SELECT o.*, f.g, list_position(list_transform(f.g, lambda r: abs(o.mid - (r.a + r.b) / 2) < o.reach), true) AS place FROM f JOIN o ON o.page_id = f.page_id AND o.k = f.k + 1)),
    w AS (SELECT o.*, line, min(o.y1) OVER (PARTITION BY o.page_id, line) AS top FROM o JOIN f ON o.page_id = f.page_id AND o.k = f.k),
    placed AS (SELECT page_id, dense_rank() OVER (PARTITION BY page_id ORDER BY top, line) - 1 AS line_index, row_number() OVER (PARTITION BY page_id, line ORDER BY x1, k) - 1 AS word_order, seq AS idx, x1, y1, x2, y2 FROM w)"""


@query(f"WITH RECURSIVE {_grouped(D.strip_group_ratio)} SELECT * FROM placed")
def line_groups(spark, sf):
    return B.grouped_lines(C.boxes(spark, sf).withColumnRenamed("seq", "idx"), D.strip_group_ratio)


@query(f"WITH RECURSIVE {_grouped(D.strip_group_ratio)} SELECT * FROM placed QUALIFY count(*) OVER (PARTITION BY page_id, line_index) >= 2")
def full_line_groups(spark, sf):
    """Lines of two words and more; the others keep their number."""
    return B.grouped_lines(C.boxes(spark, sf).withColumnRenamed("seq", "idx"), D.strip_group_ratio, least=2)


@query(
    f"""WITH RECURSIVE {_grouped(D.group_ratio)} SELECT *, coalesce(sum(x2 - x1 + {D.strip_gap}) OVER (PARTITION BY page_id, line_index ORDER BY word_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS strip_x,
    ((max(y2 - y1) OVER (PARTITION BY page_id, line_index) - (y2 - y1)) // 2)::INT AS strip_y, max(y2 - y1) OVER (PARTITION BY page_id, line_index) AS strip_height FROM placed"""
)
def strip_layout(spark, sf):
    return B.strip_offsets(B.grouped_lines(C.boxes(spark, sf).withColumnRenamed("seq", "idx")))


@query(
    f"""WITH {C.BOXES} SELECT page_id, seq, greatest(x2 - x1, y2 - y1) AS longest,
    trunc((x2 - x1) * least(900 / least(x2 - x1, y2 - y1), 2048 / greatest(x2 - x1, y2 - y1)))::INT AS width, trunc((y2 - y1) * least(900 / least(x2 - x1, y2 - y1), 2048 / greatest(x2 - x1, y2 - y1)))::INT AS height FROM boxes"""
)
def working_sizes(spark, sf):
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return C.boxes(spark, sf).withColumn("s", T.resized(w, h)).select("page_id", "seq", F.greatest(w, h).alias("longest"), "s.width", "s.height")


# Datasets


@query(f"WITH {C.STEMS} SELECT s.path, coalesce(b.text, '') AS text FROM stems s LEFT JOIN benchmark b ON s.stem = 'p' || b.item_id")
def stem_left_join(spark, sf):
    labels = C.table(spark, sf, "benchmark").select(F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("stem"), "text")
    return S.labelled(C.stems(spark, sf), labels).select("path", "text")


@query(
    f"""WITH {C.STEMS}, r AS (SELECT stem, ext, row_number() OVER (PARTITION BY stem ORDER BY list_position(['png', 'jpg', 'bmp'], ext)) AS k FROM stems WHERE ext IN ('png', 'jpg', 'bmp'))
    SELECT s.path, r.ext AS mask_ext FROM stems s JOIN r ON s.stem = r.stem AND k = 1"""
)
def priority_join(spark, sf):
    files = C.stems(spark, sf)
    return S.masked_pairs(files, files.select("stem", "ext", F.col("path").alias("mask"))).select("path", "mask_ext")


@query("SELECT doc_id, unnest(CASE WHEN quality = 0 THEN [0, 1, 2] ELSE [0] END) AS copy FROM labels")
def oversample(spark, sf):
    return S.oversampled(C.table(spark, sf, "labels").select("doc_id", "quality"), F.col("quality") == 0).select("doc_id", "copy")


@query("SELECT 'a' AS source, text FROM benchmark UNION ALL SELECT 'b' AS source, coalesce(text, '') AS text FROM conversations WHERE role = 'user'")
def combined_sets(spark, sf):
    first = C.table(spark, sf, "benchmark").select(F.lit("a").alias("source"), "text")
    second = C.table(spark, sf, "conversations").where("role = 'user'").select(F.lit("b").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    return S.combined(first, second)


@query(
    f"""WITH h AS (SELECT doc_id, ('0x' || substr(md5('{CONFIG.training.seed}:' || doc_id), 1, 15))::BIGINT AS h FROM documents)
    SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY h, doc_id) <= greatest(1, floor(count(*) OVER () * 0.15)) THEN 'val' ELSE 'train' END AS split FROM h"""
)
def exact_split(spark, sf):
    return S.exact_split(C.table(spark, sf, "documents").select("doc_id"), "doc_id", 0.15)


@query(
    """WITH p AS (SELECT DISTINCT url AS path FROM pages), k AS (SELECT path, row_number() OVER (ORDER BY path COLLATE C) - 1 AS i FROM p)
    SELECT path, copy, i * 3 + copy AS aug_index FROM k CROSS JOIN (SELECT unnest(range(3)) AS copy)"""
)
def augment_fanout(spark, sf):
    return S.augmented(C.table(spark, sf, "pages").select(F.col("url").alias("path")).distinct(), 3)


@query(
    """WITH n AS (SELECT conv_id, turn, coalesce(length(text), 0) % 9 AS n, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 AS batch FROM conversations)
    SELECT conv_id, batch, turn, max(n) OVER (PARTITION BY conv_id, batch) AS width, (max(n) OVER (PARTITION BY conv_id, batch) - n) AS padding FROM n"""
)
def padded_batches(spark, sf):
    rows = C.table(spark, sf, "conversations").select("conv_id", "turn", F.array_repeat(F.lit(7), (F.coalesce(F.length("text"), F.lit(0)) % 9).cast("int")).alias("ids"))
    found = S.batches(rows, "ids", "turn", 2, "conv_id")
    return found.select("conv_id", "batch", "turn", F.size("ids").alias("width"), F.size(F.filter("mask", lambda x: x)).alias("padding"))


@query(
    """WITH b AS (SELECT unnest(['otsu', 'adaptive_gaussian', 'sauvola']) AS name, unnest([0, 1, 2]) AS ord), s AS (SELECT doc_id, name, ord, -(((doc_id * (ord + 3)) % 4)::DOUBLE) AS score FROM documents CROSS JOIN b),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS k FROM s) SELECT doc_id, name AS method FROM r WHERE k = 1"""
)
def argmax_tie(spark, sf):
    scores = F.array(*[-((F.col("doc_id") * (i + 3)) % 4).cast("double") for i in range(len(pixels.METHODS))])
    rows = C.table(spark, sf, "documents").select("doc_id", scores.alias("scores"))
    names = list(pixels.METHODS)

    def run(batches):
        for batch in batches:
            yield batch[["doc_id"]].assign(method=[names[pixels.best_of(list(x))] for x in batch["scores"]])

    return rows.mapInPandas(run, "doc_id long, method string")


@query(
    """WITH e AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch, value FROM events), b AS (SELECT *, min(value) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
    i AS (SELECT *, before IS NULL OR value < before AS improved FROM b), g AS (SELECT *, sum(improved::INT) OVER (PARTITION BY run ORDER BY epoch) AS island FROM i),
    m AS (SELECT *, row_number() OVER (PARTITION BY run, island ORDER BY epoch) - 1 AS misses FROM g)
    SELECT run, epoch, improved, least(value, coalesce(before, value)) AS best, misses, max((misses >= 3)::INT) OVER (PARTITION BY run ORDER BY epoch) = 1 AS stopped FROM m"""
)
def early_stop(spark, sf):
    from pyspark.sql import Window

    log = C.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("epoch"), "value")
    return losses.best_so_far(log, "value", 3, "run").select("run", "epoch", "improved", "best", "misses", "stopped")


@query(
    """WITH RECURSIVE e AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch, value, count(*) OVER (PARTITION BY user_id) AS total FROM events),
    f AS (SELECT run, 0::BIGINT AS epoch, 'inf'::DOUBLE AS best, 0 AS bad, 0.001::DOUBLE AS rate FROM e WHERE epoch = 1 UNION ALL
      SELECT run, epoch, best, CASE WHEN misses > 3 THEN 0 ELSE misses END, CASE WHEN misses > 3 AND rate - rate * 0.5::DOUBLE > 1e-8 THEN rate * 0.5::DOUBLE ELSE rate END
      FROM (SELECT e.run, e.epoch, CASE WHEN value < best * (1 - 1e-4) THEN value ELSE best END AS best, CASE WHEN value < best * (1 - 1e-4) THEN 0 ELSE bad + 1 END AS misses, rate
            FROM f JOIN e ON e.run = f.run AND e.epoch = f.epoch + 1))
    SELECT run, epoch, best, bad, round(rate * 1e6, 6) AS millionths, round(1e6 * CASE WHEN epoch - 1 < 10 THEN (epoch - 1) / 10 ELSE greatest(0, (total - epoch + 1) / greatest(1, total - 10)) END, 6) AS warm_millionths
    FROM f JOIN e USING (run, epoch)"""
)
def rate_schedules(spark, sf):
    """Rates that fall on a plateau, as that of the region model's training, and that rise and fall evenly, as the line model's, over each user's events."""
    from pyspark.sql import Window

    log = C.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("epoch"), "value", F.count("*").over(Window.partitionBy("user_id")).alias("total"))
    rates = schedules.plateau_rates(log, "value", 0.001, "run")
    warm = log.select("run", "epoch", F.round(1e6 * schedules.warm_up(F.col("epoch") - 1, 10, F.col("total")), 6).alias("warm_millionths"))
    return rates.select("run", "epoch", "best", "bad", F.round(F.col("rate") * 1e6, 6).alias("millionths")).join(warm, ["run", "epoch"])


# Corrections and pixels


# Files


@query(
    """WITH d AS (SELECT doc_id, doc_id // 64 AS file, encode(coalesce(text, '')) AS raw FROM documents), p AS (SELECT *, greatest(32, ceil(octet_length(raw) / 64))::INT AS height FROM d)
    SELECT 'f' || lpad(file::VARCHAR, 12, '0') || '.pgm' AS file, (row_number() OVER (PARTITION BY file ORDER BY doc_id))::INT AS page_no, height, 64 AS width, 1 AS channels,
    sha256(raw || unhex(repeat('FF', height * 64 - octet_length(raw)))) AS pixels_sha256 FROM p"""
)
def page_files(spark, sf):
    """Documents as pages, 64 to a file: files written by executors, then read page by page over ranges of bytes."""
    folder = shared_path(spark, "pages")
    pages = C.raster_pages(spark, sf).withColumn("number", F.col("page_id").cast("long"))
    part = F.concat(F.encode(F.format_string("P5\n%d %d\n255\n", "width", "height"), "UTF-8"), "pixels")
    files = pages.withColumn("part", part).groupBy(F.expr("number div 64").alias("file")).agg(F.expr("listagg(part) within group (order by number)").alias("content"))
    save_files(files.select(F.format_string("f%012d.pgm", "file").alias("name"), "content"), folder)
    found = paged_files(spark, folder, mode="FAILFAST", split_bytes=1 << 17, task_bytes=1 << 24)
    return found.select(F.regexp_extract("page_id", r"([^/]*) \[page", 1).alias("file"), "page_no", "height", "width", "channels", F.sha2("pixels", 256).alias("pixels_sha256"))


@query(
    f"""WITH {POST} SELECT doc_id, md5(string_agg(corrected_text, chr(10) ORDER BY line_index)) AS text_md5, (sum(strlen(corrected_text) + 1) - 1)::BIGINT AS text_bytes,
    max(line_index // 41 + 1)::BIGINT AS pdf_pages, count(*) AS pdf_lines, count(*) FILTER (is_low_confidence) AS pdf_red FROM post GROUP BY doc_id"""
)
def document_files(spark, sf):
    """A text file and a PDF file for each document, read back."""
    folder, lines = shared_path(spark, "results"), K.postprocess(C.written_lines(spark, sf), number="number")
    sinks.save_text_files(lines, f"{folder}/text", lists=f"{folder}/text-lists")
    sinks.save_pdf_files(lines, f"{folder}/pdf", lists=f"{folder}/pdf-lists")
    name = F.regexp_extract("name", r"([0-9]+)\.(txt|pdf)$", 1).cast("long").alias("doc_id")
    texts = listed_files(spark, f"{folder}/text", f"{folder}/text-lists").select(name, F.md5("content").alias("text_md5"), F.octet_length("content").cast("long").alias("text_bytes"))
    raw = F.decode("content", "ISO-8859-1")
    counts = [F.regexp_count(raw, F.lit(x)).cast("long").alias(c) for c, x in (("pdf_pages", "/Type /Page /"), ("pdf_lines", r"(?m)^(0 0 0|1 0 0) rg BT"), ("pdf_red", r"(?m)^1 0 0 rg BT"))]
    pdfs = listed_files(spark, f"{folder}/pdf", f"{folder}/pdf-lists").select(name, *counts)
    return texts.join(pdfs, "doc_id")


def _swapped_sql(a: str, b: str) -> str:
    """Whether swapping two neighbours makes a of b."""
    return f"(len({a}) = len({b}) AND len(list_filter(range(1, len({a})), lambda j: {a}[:j - 1] || {a}[j + 1] || {a}[j] || {a}[j + 2:] = {b})) > 0)"


def _one_swap_and_one_more(shift: int) -> str:
    """Whether w and t meet in a swap behind i - 1 signs of w and i - 1 + shift of t, and one more edit beside it."""
    x, y, u, v = "w[:i - 1]", "w[i + 2:]", f"t[:i - 1 + {shift}]", f"t[i + 2 + {shift}:]"
    swap = f"i + {shift} >= 1 AND w[i] = t[i + 1 + {shift}] AND w[i + 1] = t[i + {shift}]"
    return f"({swap} AND (levenshtein({x}, {u}) + levenshtein({y}, {v}) <= 1 OR ({x} = {u} AND {_swapped_sql(y, v)})))"


DELETED = """SELECT DISTINCT s, v FROM (SELECT s, unnest(flatten(list_transform(range(1, len(s) + 2), lambda i: list_transform(range(i, len(s) + 2), lambda j:
      CASE WHEN i = j THEN s[:i - 1] || s[i + 1:] ELSE s[:i - 1] || s[i + 1:j - 1] || s[j + 1:] END)))) AS v FROM {0})"""
NEAREST = f"""{C.LINES}, split AS (SELECT unnest({words_of('lower(raw_text)')}) AS s FROM lines), counted AS (SELECT s, count(*) AS n FROM split WHERE regexp_matches(s, '^[a-z'']+$') GROUP BY s),
    terms AS (SELECT s, n FROM counted WHERE n >= 5), unknown AS (SELECT s FROM counted WHERE n < 5),
    met AS (SELECT DISTINCT a.s AS w, b.s AS t FROM ({DELETED.format('unknown')}) a JOIN ({DELETED.format('terms')}) b USING (v) WHERE abs(len(a.s) - len(b.s)) <= 2),
    near AS (SELECT w, t, CASE WHEN levenshtein(w, t) <= 1 OR {_swapped_sql('w', 't')} THEN 1 WHEN levenshtein(w, t) = 2
      OR len(list_filter(range(1, len(w)), lambda i: {' OR '.join(_one_swap_and_one_more(k) for k in (-1, 0, 1))})) > 0 THEN 2 END AS distance FROM met),
    ranked AS (SELECT w, t, distance, row_number() OVER (PARTITION BY w ORDER BY distance, n DESC, t) AS k FROM near JOIN terms ON t = s WHERE distance IS NOT NULL)"""


@query(f"WITH {NEAREST} SELECT w AS word, t AS term, distance FROM ranked WHERE k = 1 UNION ALL SELECT s, s, 0 FROM terms")
def nearest_terms(spark, sf):
    """Every word of letters and its nearest term among those that occur five times or more."""
    words = stored(fuzzy.word_counts(C.lines(spark, sf)), "counts")
    return fuzzy.closest_terms(words.select(F.col("term").alias("word")), words.where("count >= 5"))


@query()
def fuzzy_correct(spark, sf):
    rows = C.lines(spark, sf)
    dictionary = fuzzy.word_counts(rows).where("count >= 5")
    return fuzzy.corrected(rows.select("doc_id", "line_index", "raw_text"), dictionary).select("doc_id", "line_index", "corrected_text")


@query()
def binarised_pages(spark, sf):
    def one(row):
        binary, method, scores = pixels.binarised(pixels._page(row))
        yield row.page_id, method, float(scores[method]), int((binary == pixels.INK).sum())

    return pixels._mapped(C.raster_pages(spark, sf), "page_id string, method string, score double, ink long", one)


@query("SELECT doc_id::VARCHAR AS page_id, greatest(32, ceil(strlen(coalesce(text, '')) / 64))::INT AS height FROM documents")
def raster_sizes(spark, sf):
    return C.raster_pages(spark, sf).select("page_id", "height")


@query()
def page_components(spark, sf):
    def one(row):
        stats = pixels.components(pixels.otsu(pixels._page(row)) == pixels.INK)[1]
        yield row.page_id, len(stats), int(stats[:, 4].sum()), int(stats[:, 4].max()) if len(stats) else 0

    return pixels._mapped(C.raster_pages(spark, sf), "page_id string, components int, ink long, largest long", one)


from linework.plans import parts  # noqa: E402, F401  registers its queries
