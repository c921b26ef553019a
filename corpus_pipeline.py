"""A corpus from raw documents to packed sequences: quality, exact copies, near copies, personal data, packing.

Each stage takes what its predecessor kept, as a table with the columns of documents, and the last returns the pieces of
the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.llm import bottomk, knn_quality, lsm_dedup, packing, pii_weak
from linework.llm.common import read_table, stored, without
from linework.llm.queries import SPACE_TOKENIZER, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' vote does not reject.

    A row goes by its own text, so rows that repeat a doc_id, or have none, may fare differently, and those of equal texts
    alike. Null and empty texts score the labels' mean. Other columns, whatever their names, stay; an empty table gives none.
    """
    scored = knn_quality.scores(docs, read_table(spark, sf_dir, "labels"))
    return without(docs, scored.where("predicted = 0"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of the smallest doc_id, of null ones or repeated rows any one."""
    return lsm_dedup.kept_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 or more join, rows that repeat a doc_id and text with it.

    Texts that share a doc_id, or have none, are documents each. Texts without words are linked with nothing and stay.
    """
    return without(docs, bottomk.near_duplicates(docs, percent=80).where("not kept"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced by their kind; null texts stay null. n_chars, where it is a column, follows."""
    hidden = pii_weak.redact(docs)
    if "n_chars" not in docs.columns:
        return hidden
    return hidden.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences; null texts are a piece of the closing 0, repeated rows are packed each."""
    return packing.pack_documents(docs, tokenizer_path(SPACE_TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("packed", packed),
]

#: The vote of the first stage has no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each stored before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
