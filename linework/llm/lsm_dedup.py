"""Exact deduplication by a log-structured merge index, in DataFrame operations only.

Each input split is a memtable. Flushing hashes its normalised texts and writes one run sorted by digest (level 0), with
the file format's own Bloom filter and min/max statistics on the digest. Compaction merges the runs of level 0 with those
of level 1, with map-side combining, and writes new sorted runs: one row per digest with its smallest identifier and row
count. Digests of more than one row are hits. A bitmap filter over the hits' digests tells at once most rows that are
alone, so only rows that may be hits are joined; another over the hits' identifiers gates the second reading of the texts,
and each hit's bytes are compared with the text that stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.llm.common import documents, gated, parted, shared_dir, stored, whole_row

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WHITE, " ")


class DigestIndex:
    """Sorted digest runs in levels, under one path of the shared folder: runs as flushed, and runs as compacted."""

    RUN = "doc_id long, digest binary"
    MERGED = "digest binary, keep_id long, group_size long"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}"
        self._flushed: list[str] = []
        self._level0: list[str] = []
        self._level1: str | None = None

    def _write(self, runs: DataFrame, level: int) -> str:
        path = f"{self.path}/level-{level}/{uuid.uuid4().hex}"
        runs.write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)
        return path

    def flush(self, docs: DataFrame) -> DataFrame:
        """Writes one sorted run per input split; returns the runs just written (doc_id, digest)."""
        rows = documents(docs).select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))
        path = self._write(rows.sortWithinPartitions("digest", "doc_id"), 0)
        self._level0.append(path)
        self._flushed.append(path)
        return self.spark.read.schema(self.RUN).parquet(path)

    def runs(self) -> DataFrame:
        """(doc_id, digest) of all runs as flushed."""
        return self.spark.read.schema(self.RUN).parquet(*self._flushed) if self._flushed else self.spark.createDataFrame([], self.RUN)

    def compact(self) -> DataFrame:
        """Merges what was flushed since into level 1 and returns it: digest, keep_id (smallest identifier), group_size."""
        if self._level0:
            new = self.spark.read.schema(self.RUN).parquet(*self._level0).groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
            if self._level1:
                new = new.unionByName(self.merged()).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
            self._level1 = self._write(new.sortWithinPartitions("digest"), 1)
            self._level0 = []
        return self.merged()

    def merged(self) -> DataFrame:
        """The runs of level 1."""
        return self.spark.read.schema(self.MERGED).parquet(self._level1) if self._level1 else self.spark.createDataFrame([], self.MERGED)

    def lookup(self, digest_hex: str) -> DataFrame:
        """Rows of one digest; the runs' statistics and Bloom filters skip the others."""
        return self.runs().where(F.col("digest") == F.unhex(F.lit(digest_hex)))


def exact_dedup(docs: DataFrame, filter_limit: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of blanks becomes one space; null and empty texts are equal, and texts of
    any length are hashed whole. Rows that share a doc_id and text count as members of their group each and are alike, so all
    of them are kept or none; rows that share a doc_id only are told apart by their texts. A null doc_id comes after all
    others: a group of null doc_ids alone has a null keep_id, and its rows are kept. Should bytes differ under one
    digest, the rows that differ from the text that stays are grouped by their bytes instead. Extra columns are ignored; an
    empty table gives no rows.
    """
    limit = {} if filter_limit is None else {"limit": filter_limit}
    index = DigestIndex(docs.sparkSession)
    runs = index.flush(docs)
    hits = stored(index.compact().where("group_size > 1"), "hit-level")
    near, alone = parted(runs, F.col("digest"), hits, "digest", hits.count(), **limit)
    alone = alone.select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    met = near.join(hits, "digest", "left").select(
        "doc_id", "digest", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size")
    )
    met = stored(met, "near")
    asked = stored(met.where("group_size > 1").select("doc_id", "digest", "keep_id").distinct(), "hits")
    texts = gated(documents(docs), F.col("doc_id"), asked, "doc_id", asked.count(), **limit)
    texts = texts.select(F.col("doc_id").alias("_id"), normalised(F.col("text")).alias("body")).withColumn("_own", F.unhex(F.sha2("body", 256)))
    # A doc_id may repeat with another text: a body answers only for its own digest. Null-safe, as a null check on the digest
    # would be pushed below the filter and hash every text.
    bodies = texts.join(asked, F.col("_id").eqNullSafe(F.col("doc_id")) & F.col("_own").eqNullSafe(F.col("digest")))
    bodies = stored(bodies.select("doc_id", "digest", "keep_id", "body"), "hit-texts")
    stays = bodies.where("doc_id <=> keep_id").dropDuplicates(["digest"]).select("digest", F.col("body").alias("kept_body"))
    wrong = stored(bodies.join(stays, "digest").where("body <> kept_body").select("doc_id", "digest", "body"), "unequal")
    joined = alone.unionByName(met)
    if not wrong.isEmpty():
        joined = _regrouped(joined, wrong)
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _regrouped(joined: DataFrame, wrong: DataFrame) -> DataFrame:
    """Results after rows that only share a digest have left its group."""
    groups = wrong.groupBy("digest", "body").agg(F.min("doc_id").alias("own_keep"), F.count("*").alias("own_size"))
    moved = wrong.join(groups, ["digest", "body"]).select(F.col("digest").alias("_digest"), F.col("doc_id").alias("_id"), "own_keep", "own_size").distinct()
    left = wrong.groupBy("digest").agg(F.count("*").alias("gone"))
    return (
        joined.join(moved, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").join(left, "digest", "left")
        .select(
            "doc_id", "digest", F.when(F.col("own_size").isNotNull(), F.col("own_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("own_size", F.col("group_size") - F.coalesce("gone", F.lit(0))).alias("group_size"),
        )
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns: one row of each group of equal texts, of equal doc_ids any one.

    Only rows of groups of equal texts are moved.
    """
    body = normalised(F.coalesce(F.col("text").cast("string"), F.lit("")))
    grouped = stored(exact_dedup(docs).where("group_size > 1").select(F.col("doc_id").alias("_id"), "kept", F.col("text_sha256").alias("_sha")).distinct(), "grouped")
    near, far = parted(docs, F.col("doc_id").cast("long"), grouped, "_id", grouped.count())
    near = near.select(whole_row(near).alias("row"), F.col("doc_id").cast("long").alias("_own_id"), F.sha2(body, 256).alias("_own"))
    met = near.join(grouped, F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_sha")), "left")
    alone = met.where("kept is null").select("row.*")
    stays = met.where("kept").dropDuplicates(["_own_id", "_own"]).select("row.*")
    return far.unionByName(alone).unionByName(stays)
