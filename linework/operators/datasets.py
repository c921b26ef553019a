"""Training-set assembly: joins by stem, unions, oversampling, exact splits, batches."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.config import CONFIG
from linework.functions.text import PAD
from linework.storage import shared_dir

T = CONFIG.training
#: Fixed order of preference of mask files.
MASK_PRIORITY = ("png", "jpg", "bmp")


def stem(path: Column | str) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def labelled(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images with the text of their stem's label, or empty text."""
    return images.join(labels.select("stem", "text"), "stem", "left").withColumn("text", F.coalesce("text", F.lit("")))


def masked_pairs(images: DataFrame, masks: DataFrame, priority: tuple[str, ...] = MASK_PRIORITY) -> DataFrame:
    """Images that have a mask of their stem, with the one of the most preferred kind (stem, ext, mask)."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("ext"))
    best = masks.where(rank > 0).groupBy("stem").agg(F.min(F.struct(rank.alias("r"), "mask", "ext")).alias("m")).select("stem", "m.mask", F.col("m.ext").alias("mask_ext"))
    return images.join(best, "stem", "inner")


def required(pairs: DataFrame, what: str = "image with a mask") -> DataFrame:
    """pairs, unless there are none: training on nothing is an error."""
    if pairs.isEmpty():
        raise FileNotFoundError(f"no {what}")
    return pairs


def combined(*parts: DataFrame | Callable[[], DataFrame], optional: tuple[Callable[[], DataFrame], ...] = ()) -> DataFrame:
    """All rows of the parts that are there; none at all is an error. An optional part that can't be opened is left out with a warning."""
    there = [p if isinstance(p, DataFrame) else p() for p in parts]
    for part in optional:
        try:
            there.append(part())
        except (AnalysisException, OSError) as e:
            logging.getLogger("linework").warning("a dataset is left out: %s", str(e).splitlines()[0])
    if not there:
        raise ValueError("no dataset to combine")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), there)


def oversampled(rows: DataFrame, hard: Column, times: int = T.oversample) -> DataFrame:
    """rows with each hard one there `times` times, numbered by copy from 0."""
    return rows.withColumn("copy", F.explode(F.when(hard, F.sequence(F.lit(0), F.lit(times - 1))).otherwise(F.array(F.lit(0)))))


def exact_split(rows: DataFrame, key: str, fraction: float, seed: int = T.seed, name: str = "split") -> DataFrame:
    """rows marked 'val' or 'train'; exactly max(1, floor(n * fraction)) are 'val', those of the smallest seeded hashes.

    Hashes are the first 60 bits of md5 of seed:key. The place of the last one comes from counts of hash ranges, so no task
    ranks all rows: one range is ranked.
    """
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")
    marked = rows.withColumn("_h", order).withColumn("_b", F.shiftright("_h", 44))
    counts = marked.groupBy("_b").agg(F.count("*").alias("n"))
    n = counts.agg(F.sum("n")).first()[0] or 0
    want = max(1, int(n * fraction)) if n else 0
    left, edge = want, None
    for r in counts.orderBy("_b").toLocalIterator():  # 65,536 ranges at most
        if left <= r["n"]:
            edge = r["_b"]
            break
        left -= r["n"]
    if edge is None:
        return marked.withColumn(name, F.lit("train")).drop("_h", "_b")
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    inside = marked.where(F.col("_b") == edge).withColumn("_r", rank)
    inside = inside.withColumn(name, F.when(F.col("_r") <= left, "val").otherwise("train")).drop("_r")
    outside = marked.where(F.col("_b") != edge).withColumn(name, F.when(F.col("_b") < edge, "val").otherwise("train"))
    return outside.unionByName(inside).drop("_h", "_b")


def augmented(images: DataFrame, copies: int) -> DataFrame:
    """Each image `copies` times, with a running number over all: images by path, then copies."""
    out = images.join(numbered(images.select("path").distinct(), "path"), "path").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return out.withColumn("aug_index", F.col("_place") * copies + F.col("copy")).drop("_place")


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Distinct rows with _place, their number from 0 in order of key, without ranking all in one task.

    Rows are dealt by ranges of the key and fixed by a checkpoint; a row's place is its place in its range and the sizes of the
    ranges before.
    """
    shared_dir(rows.sparkSession)  # where checkpoints go
    fixed = rows.repartitionByRange(key).sortWithinPartitions(key).checkpoint()
    at = F.monotonically_increasing_id()
    placed = fixed.withColumns({"_range": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", before.alias("_before"))  # a row for each partition
    return placed.join(F.broadcast(offsets), "_range").withColumn("_place", F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def surviving_boxes(original: DataFrame, changed: DataFrame) -> DataFrame:
    """Boxes of changed copies; a copy that lost all of its own has the original's."""
    kept = changed.select("path", "copy").distinct()
    lost = original.join(kept.hint("shuffle_hash"), ["path", "copy"], "left_anti")  # boxes are met as they come, not sorted
    return changed.unionByName(lost)


def batches(rows: DataFrame, ids: str, order: str, size: int, *group: str) -> DataFrame:
    """(group, batch, order, ids, mask): id arrays padded to their batch's longest; mask is true on padding."""
    at = F.floor((F.row_number().over(Window.partitionBy(*group).orderBy(order)) - 1) / size)
    rows = rows.withColumn("batch", at)
    longest = F.max(F.size(ids)).over(Window.partitionBy(*group, "batch"))
    short = longest - F.size(ids)
    return rows.withColumn("_short", short).select(
        *group, "batch", order, F.concat(F.col(ids), F.array_repeat(F.lit(PAD), F.col("_short"))).alias(ids), F.concat(F.array_repeat(F.lit(False), F.size(ids)), F.array_repeat(F.lit(True), F.col("_short"))).alias("mask")
    )


def training_labels(ids: Column, pad: int = PAD, ignore: int = T.ignore_index) -> Column:
    """ids with padding as the index that losses ignore."""
    return F.transform(ids, lambda x: F.when(x == pad, ignore).otherwise(x))


def decoded_labels(ids: Column, pad: int = PAD, ignore: int = T.ignore_index) -> Column:
    return F.transform(ids, lambda x: F.when(x == ignore, pad).otherwise(x))
