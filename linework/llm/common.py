"""What the training-data operators share: inputs, durable intermediate tables, size-checked filters."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits in one bitmap of bitmap_construct_agg.
BITMAP_BITS = 8 * 4096
#: A filter is broadcast only up to this size. With more keys each has fewer bits, so more rows pass; under one bit a key there
#: is no filter, and the rows go straight to the join.
FILTER_LIMIT_BYTES = 64 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text of a documents table; null text counts as empty and extra columns go."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one serves a local session; a cluster must name it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = checkpoint.get() if checkpoint.isDefined() else None
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="linework-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Rows of an Arrow batch while a table is stored: texts make batches large, and both sides of the pipe hold some of them.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: cuts lineage, and survives lost executors.

    While it is written, Arrow batches have BATCH_ROWS rows at most; the session's own setting comes back after.
    """
    conf = df.sparkSession.conf
    path, before = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", conf.get(_BATCH)
    conf.set(_BATCH, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        conf.set(_BATCH, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slot(key: Column, buckets: int) -> tuple[Column, Column]:
    """Bucket and bit of a key in a bitmap filter of that many buckets."""
    h = F.pmod(F.xxhash64(key), F.lit(buckets * BITMAP_BITS))
    return F.floor(h / BITMAP_BITS).cast("int"), (h % BITMAP_BITS).cast("long")


def filter_buckets(n: int, bits_per_key: int = 12) -> int:
    return max(1, -(-n * bits_per_key // BITMAP_BITS))


def key_filter(keys: DataFrame, column: str, buckets: int) -> DataFrame:
    """One 4 KB bitmap per bucket, built by native aggregation."""
    bucket, bit = slot(F.col(column), buckets)
    return keys.select(bucket.alias("_bucket"), bit.alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one, so that no name of theirs meets one of ours."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns])


def _buckets(n_keys: int, limit: int) -> int:
    """Bitmaps of a filter of n_keys within limit; 0 for no filter."""
    most = limit // (BITMAP_BITS // 8)
    return min(filter_buckets(n_keys), most) if n_keys <= most * BITMAP_BITS else 0


def _probed(df: DataFrame, key: Column, keys: DataFrame, column: str, buckets: int) -> DataFrame:
    """row, and maybe: whether its key may be among keys. A null key is one like any other."""
    bucket, bit = slot(key, buckets)
    probe = df.select(whole_row(df).alias("row"), bucket.alias("_bucket"), bit.alias("_bit"))
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    maybe = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) != 0, F.lit(False))
    return probe.join(F.broadcast(key_filter(keys, column, buckets)), "_bucket", "left").select("row", maybe.alias("maybe"))


def gated(df: DataFrame, key: Column, keys: DataFrame, column: str, n_keys: int, limit: int = FILTER_LIMIT_BYTES) -> DataFrame:
    """Rows of df whose key may be among keys (false positives pass). With too many keys for the limit every row passes."""
    buckets = _buckets(n_keys, limit)
    return _probed(df, key, keys, column, buckets).where("maybe").select("row.*") if buckets else df


def parted(df: DataFrame, key: Column, keys: DataFrame, column: str, n_keys: int, limit: int = FILTER_LIMIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be among keys, and the rows whose key is not. With too many keys for the limit all are in the first."""
    buckets = _buckets(n_keys, limit)
    if not buckets:
        return df, df.where(F.lit(False))
    probed = _probed(df, key, keys, column, buckets)
    return probed.where("maybe").select("row.*"), probed.where("not maybe").select("row.*")


def text_key(text: Column | str = "text") -> Column:
    """A hash that tells texts apart that share a doc_id; null counts as empty."""
    return F.xxhash64(F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit("")))


def without(df: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of df but those of dropped's (doc_id, text_key): of rows that share a doc_id only the one with that text goes, a null
    doc_id is one like any other. Few rows move: only those that the filter can't clear."""
    dropped = stored(dropped.select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_gone_key")).distinct(), "dropped")
    near, far = parted(df, F.col("doc_id").cast("long"), dropped, "_gone", dropped.count())
    keyed = near.select(whole_row(near).alias("row"), F.col("doc_id").cast("long").alias("_id"), text_key().alias("_key"))
    left = keyed.join(dropped, F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_key") == F.col("_gone_key")), "left_anti")
    return left.select("row.*").unionByName(far)
