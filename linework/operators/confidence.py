"""Line and document results: confidences, masking, review flags, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.config import CONFIG
from linework.functions.text import WORD_START, clean_noise, keyword_hit, let, quick_cer, split_words, strip

R, P = CONFIG.recognition, CONFIG.postprocessing


def postprocess(lines: DataFrame, corrected: Column | None = None, *doc: str, number: str | None = None) -> DataFrame:
    """Lines whose raw text is not blank, numbered anew from 0 within their document, cleaned and flagged.

    Lines without blank ones that have their number in a column, as `number` says, are neither moved nor sorted.
    """
    doc = doc or ("doc_id",)
    kept = lines if number else lines.where(strip("raw_text") != "")
    place = F.col(number) if number else F.row_number().over(Window.partitionBy(*doc).orderBy("line_index")) - 1
    return kept.withColumns(
        {"line_index": place, "corrected_text": clean_noise("raw_text") if corrected is None else corrected, "is_low_confidence": F.col("confidence") < P.low_confidence}
    ).drop(*[number] if number else [])


def summaries(lines: DataFrame, *doc: str, text: bool = True) -> DataFrame:
    """Per document: lines, mean confidence, low-confidence lines and, if wanted, the full text."""
    doc = doc or ("doc_id",)
    full = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "corrected_text"))), lambda x: x["corrected_text"]), "\n")
    out = [F.count("*").alias("lines"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"), F.count_if("is_low_confidence").alias("low_confidence_count")]
    return lines.groupBy(*doc).agg(*out, *([full.alias("full_text")] if text else []))


def keyword_search(lines: DataFrame, keyword: str) -> DataFrame:
    return lines.where(keyword_hit("corrected_text", keyword)).select("doc_id", "line_index", F.col("corrected_text").alias("line_text"), "confidence")


def word_confidences(tokens: DataFrame, *line: str, threshold: float = R.word_floor) -> DataFrame:
    """Words of token rows: a token that begins with a word mark or space starts one. One row per word, from 0."""
    line = line or ("doc_id", "line_index")
    order = Window.partitionBy(*line).orderBy("tok_index")
    starts = (F.col("tok").startswith(WORD_START) | F.col("tok").startswith(" ") | (F.row_number().over(order) == 1)).cast("int")
    piece = F.regexp_replace(F.regexp_replace("tok", f"^{WORD_START}+", ""), r"^\s+", "")
    grouped = tokens.withColumn("piece", piece).withColumn("word_no", F.sum(starts).over(order)).groupBy(*line, "word_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tok_index", "piece"))), lambda x: x["piece"]), "").alias("word"), F.avg("p").alias("confidence")
    )
    words = grouped.withColumn("word", strip("word")).where("word <> ''")
    index = F.row_number().over(Window.partitionBy(*line).orderBy("word_no")) - 1
    return words.select(*line, index.alias("word_index"), "word", "confidence", (F.col("confidence") < threshold).alias("low"))


def line_confidences(tokens: DataFrame, *line: str) -> DataFrame:
    line = line or ("doc_id", "line_index")
    return tokens.groupBy(*line).agg(F.avg("p").alias("confidence"), F.count("*").alias("tokens"))


def masked_text(tokens: Column, confidence: Column, token_floor: float = R.token_floor, line_floor: float = R.line_floor) -> Column:
    """Text of an ordered array of struct(tok, p): runs of doubtful tokens become one mark, doubtful lines another."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("hidden"))
    walked = F.aggregate(
        tokens, start,
        lambda acc, t: F.when(
            t["p"] < token_floor, F.struct(F.when(acc["hidden"], acc["out"]).otherwise(F.array_append(acc["out"], F.lit(R.illegible))).alias("out"), F.lit(True).alias("hidden"))
        ).otherwise(F.struct(F.array_append(acc["out"], t["tok"]).alias("out"), F.lit(False).alias("hidden"))),
    )
    text = strip(F.array_join(F.filter(walked["out"], lambda x: x != ""), " "))
    return F.when(confidence < line_floor, R.illegible_line).otherwise(text)


def masked_lines(tokens: DataFrame, *line: str) -> DataFrame:
    """Token rows to masked lines; a line's tokens stay together, lines are spread."""
    line = line or ("doc_id", "line_index")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("tok_index", "tok", "p"))), lambda x: F.struct(x["tok"].alias("tok"), x["p"].alias("p")))
    rows = tokens.groupBy(*line).agg(ordered.alias("toks"), F.avg("p").alias("confidence"))
    return rows.select(*line, "confidence", masked_text(F.col("toks"), F.col("confidence")).alias("text"))


def ink_words(columns: Column, share: float = 0.05) -> Column:
    """Ink runs of a line's column sums: smoothed over five, above a share of the highest."""
    n = F.size(columns)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def mean(i: Column) -> Column:
        around = F.slice(columns, F.greatest(i - 2, F.lit(0)) + 1, F.least(i + 3, n) - F.greatest(i - 2, F.lit(0)))
        return F.aggregate(around, F.lit(0.0), lambda a, x: a + x) / 5

    def runs(smooth: Column, top: Column) -> Column:
        start = F.struct(F.lit(False).alias("on"), F.lit(0).alias("n"))
        return F.aggregate(smooth, start, lambda acc, v: F.struct((v > top).alias("on"), (acc["n"] + F.when((v > top) & ~acc["on"], 1).otherwise(0)).alias("n")))["n"]

    return let(F.transform(at, mean), lambda smooth: let(F.array_max(smooth) * share, lambda top: runs(smooth, top)))


def hallucination_risk(text: Column, probabilities: Column, runs: Column) -> Column:
    """Whether an unsure line has far more words than its ink: runs counts the ink runs."""
    mean = F.aggregate(probabilities, F.lit(0.0), lambda a, x: a + x) / F.size(probabilities)
    said = F.size(F.filter(split_words(text), lambda w: ~w.startswith("[")))
    ratio = F.greatest(F.lit(1), said) / F.greatest(F.lit(R.risk_min_words), runs)
    doubtful = (strip(text) != "") & (F.size(probabilities) > 0)
    return F.when(~doubtful, False).when(mean >= R.risk_confidence, False).when(runs == 0, False).otherwise(ratio > R.risk_ratio)


def second_opinion_review(lines: DataFrame, opinions: DataFrame, *keys: str) -> DataFrame:
    """lines with needs_review set where an unsure valid line differs from a second reading (keys, second_text)."""
    met = lines.join(opinions, list(keys), "left").withColumn("second_text", F.coalesce("second_text", F.lit("")))
    asked = (F.col("confidence") < R.review_confidence) & F.col("valid") & (F.col("second_text") != "")
    return met.withColumn("needs_review", F.col("needs_review") | (asked & (quick_cer("raw_text", "second_text") > R.review_cer)))


def valid_crop(height: Column | str, width: Column | str) -> Column:
    d = CONFIG.detection
    h, w = (F.col(x) if isinstance(x, str) else x for x in (height, width))
    return F.coalesce((h >= d.min_height) & (w >= d.min_width), F.lit(False))


def with_empty_results(crops: DataFrame) -> DataFrame:
    """Crops that can't be read keep their place with empty text and no confidence."""
    ok = valid_crop("height", "width")
    return crops.withColumns({"valid": ok, "raw_text": F.when(ok, F.col("raw_text")).otherwise(""), "confidence": F.when(ok, F.col("confidence")).otherwise(0.0)})
