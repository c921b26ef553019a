"""Error rates of recognised text against references."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.functions.text import edit_distance, split_words, word_distance, word_overlap


def paired(predictions: DataFrame, references: DataFrame, *keys: str, every: bool = False) -> DataFrame:
    """Rows of both sides with equal keys: what only one side has goes. With every, predictions stay, without a reference."""
    return predictions.join(references, list(keys), "left" if every else "inner")


def with_errors(pairs: DataFrame, words: bool = True) -> DataFrame:
    """pairs (prediction, reference) with edit counts and reference lengths of characters and words."""
    out = pairs.withColumns({"char_edits": edit_distance("prediction", "reference"), "chars": F.length("reference")})
    if words:
        p, r = split_words("prediction"), split_words("reference")
        out = out.withColumns({"word_edits": word_distance(p, r), "words": F.size(r)})
    return out


def rate(edits: str, length: str, where: Column | None = None) -> Column:
    """Edits of all pairs over all reference lengths, at least 1 each; 0 without pairs. Rows without a length are no pairs."""
    e, n = F.col(edits), F.when(F.col(length).isNotNull(), F.greatest(F.lit(1), F.col(length)))
    if where is not None:
        e, n = F.when(where, e), F.when(where, n)
    return F.coalesce(F.sum(e) / F.sum(n), F.lit(0.0))


def character_error_rate(pairs: DataFrame) -> DataFrame:
    return with_errors(pairs, words=False).agg(rate("char_edits", "chars").alias("cer"), F.count("*").alias("num_pairs"))


def word_error_rate(pairs: DataFrame) -> DataFrame:
    return with_errors(pairs).agg(rate("word_edits", "words").alias("wer"), F.count("*").alias("num_pairs"))


def evaluate(pairs: DataFrame, seconds: float = 0.0, tagged: bool = True) -> DataFrame:
    """One row: rates of all pairs, of clean and of hard ones, and how many need review.

    pairs has prediction, reference, tag and needs_review; other tags count in the total alone. Predictions of a null reference
    are samples, as all counts are of predictions, but no rate has them.
    """
    clean, hard = (F.col("tag") == t if tagged else F.lit(False) for t in ("clean", "hard"))
    wer = rate("word_edits", "words")
    return with_errors(pairs).agg(
        rate("char_edits", "chars").alias("cer"), wer.alias("wer"), F.greatest(F.lit(0.0), 1 - wer).alias("accuracy"),
        F.count("*").alias("num_samples"), F.lit(seconds).alias("inference_time_sec"),
        rate("char_edits", "chars", clean).alias("cer_clean"), rate("word_edits", "words", clean).alias("wer_clean"), F.count_if(clean).alias("num_clean"),
        rate("char_edits", "chars", hard).alias("cer_hard"), rate("word_edits", "words", hard).alias("wer_hard"), F.count_if(hard).alias("num_hard"),
        F.count_if("needs_review").alias("num_needs_review"),
    )


def rates_by_tag(pairs: DataFrame, words: bool = False) -> DataFrame:
    """A row for each tag and one for the total (tag 'all'), in one pass by grouping sets."""
    rows = with_errors(pairs, words)
    measures = [rate("char_edits", "chars").alias("cer"), F.count("*").alias("num_pairs"), F.sum("char_edits").alias("edits"), F.sum("chars").alias("chars")]
    if words:
        measures.append(rate("word_edits", "words").alias("wer"))
    return rows.groupingSets([["tag"], []], "tag").agg(F.grouping("tag").alias("g"), *measures).withColumn("tag", F.when(F.col("g") == 1, "all").otherwise(F.col("tag"))).drop("g")


def report(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rates of each sample, and of all, clean and hard ones: two tidy tables."""
    rows = with_errors(pairs)
    each = rows.select("sample_id", "prediction", "reference", "tag", (F.col("char_edits") / F.greatest(F.lit(1), F.col("chars"))).alias("cer"), (F.col("word_edits") / F.greatest(F.lit(1), F.col("words"))).alias("wer"), "needs_review")
    return each, rates_by_tag(pairs, words=True).where(F.col("tag").isin("all", "clean", "hard"))


#: Distinct words of all truths, at most, that go to every worker; with more of them words are joined.
INDEXED_WORDS = 2_000_000


def best_matches(predictions: DataFrame, truths: DataFrame, indexed: int = INDEXED_WORDS) -> DataFrame:
    """Each prediction (line_id, text) with its best word overlap over all truths (truth_id, truth).

    Only truths that share a word can overlap; other predictions have 0, or 1 where some truth has no words. Ties take the
    smallest truth_id. Truths whose words are few go to every worker as lists by word, so that a word in all of them makes no
    pairs to shuffle; with more, lines and truths are joined by their words.
    """
    words = truths.select("truth_id", F.explode(F.array_distinct(split_words(F.lower("truth")))).alias("word"))
    said = predictions.withColumn("_words", F.array_distinct(split_words(F.lower("text"))))
    some = words.limit(indexed + 1).toArrow()  # bounded whatever the truths are
    if some.num_rows <= indexed:
        best = _by_lists(said, some)
    else:
        best = _by_join(said.select("line_id", F.explode("_words").alias("word")), words, predictions)
    blank = truths.where(F.size(split_words("truth")) == 0).agg(F.min("truth_id").alias("blank"))
    score = F.when(F.col("blank").isNotNull(), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
    truth = F.when(F.col("blank").isNotNull() & (F.coalesce("score", F.lit(0.0)) < 1.0), F.col("blank")).otherwise(F.col("_truth"))
    return best.crossJoin(F.broadcast(blank)).select("line_id", truth.alias("truth_id"), score.alias("overlap"))


def _by_join(said: DataFrame, words: DataFrame, predictions: DataFrame) -> DataFrame:
    sizes = words.groupBy("truth_id").agg(F.count("*").alias("size"))
    met = said.join(words, "word").groupBy("line_id", "truth_id").agg(F.count("*").alias("shared")).join(sizes, "truth_id")
    best = met.groupBy("line_id").agg(F.max(F.struct((F.col("shared") / F.col("size")).alias("score"), (-F.col("truth_id")).alias("t"))).alias("b"))
    return predictions.select("line_id").join(best, "line_id", "left").select("line_id", F.col("b.score").alias("score"), (-F.col("b.t")).alias("_truth"))


def _by_lists(said: DataFrame, words: pa.Table) -> DataFrame:
    ids, at = np.unique(words["truth_id"].to_numpy(), return_inverse=True)
    sizes = np.maximum(np.bincount(at, minlength=len(ids)), 1)
    kinds = words["word"].combine_chunks().dictionary_encode()
    places = kinds.indices.to_numpy()
    order = np.argsort(places, kind="stable")
    lists = np.split(at[order], np.cumsum(np.bincount(places, minlength=len(kinds.dictionary)))[:-1]) if len(places) else []
    index = dict(zip(kinds.dictionary.to_pylist(), lists, strict=True))
    line = said.schema["line_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, found = [], []
            for own in batch.column("_words").to_pylist():
                met = [index[w] for w in own or () if w in index]
                if not met:
                    scores.append(None), found.append(None)
                    continue
                shares = np.bincount(np.concatenate(met), minlength=len(ids)) / sizes
                best = int(shares.argmax())
                scores.append(float(shares[best])), found.append(int(ids[best]))
            yield pa.RecordBatch.from_arrays([batch.column("line_id"), pa.array(scores, pa.float64()), pa.array(found, pa.int64())], ["line_id", "score", "_truth"])

    return said.select("line_id", "_words").mapInArrow(run, f"line_id {line.simpleString()}, score double, _truth long")


def word_accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("word_accuracy", word_overlap("reference", "prediction"))
