"""Losses over arrays of scores, and what an epoch log says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.config import CONFIG
from linework.functions.text import let

T = CONFIG.training


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _shifted(logits: Column | str) -> Column:
    """exp of each score less the highest."""
    logits = F.col(logits) if isinstance(logits, str) else logits
    return let(F.array_max(logits).cast("double"), lambda top: F.transform(logits, lambda x: F.exp(x.cast("double") - top)))


def softmax(logits: Column | str) -> Column:
    return let(_shifted(logits), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def top_probability(logits: Column | str) -> Column:
    """Probability of the likeliest entry."""
    return 1 / total(_shifted(logits))


def cross_entropy(logits: Column | str, label: Column | str) -> Column:
    logits, label = (F.col(x) if isinstance(x, str) else x for x in (logits, label))
    return F.log(total(_shifted(logits))) + F.array_max(logits) - F.get(logits, label)


def focal_loss(rows: DataFrame, logits: str, label: str, gamma: float = T.focal_gamma, ignore: int = T.ignore_index) -> DataFrame:
    """Mean over labels not ignored of (1 - p) ** gamma times cross entropy; 0 where all are ignored."""
    some = rows.where(F.col(label) != ignore).withColumn("_ce", cross_entropy(logits, label))
    return some.agg((F.coalesce(F.sum(F.pow(1 - F.exp(-F.col("_ce")), gamma) * F.col("_ce")), F.lit(0.0)) / F.greatest(F.lit(1), F.count("*"))).alias("focal_loss"), F.count("*").alias("n_labels"))


def overlap_scores(pixels: DataFrame, *group: str, threshold: float = 0.5, smooth: float = 1.0) -> DataFrame:
    """iou, dice_loss and bce_dice_loss of (group, pred, target) pixels, pred in (0, 1)."""
    p, t = F.col("pred"), F.col("target")
    on = (p > threshold).cast("int")
    mine = (t > 0.5).cast("int")
    both, either = F.sum(on * mine), F.sum(F.greatest(on, mine))
    dice = 1 - (2 * F.sum(p * t) + smooth) / (F.sum(p) + F.sum(t) + smooth)
    safe = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    bce = F.avg(-(t * F.log(safe) + (1 - t) * F.log(1 - safe)))
    return pixels.groupBy(*group).agg(((both + 1e-6) / (either + 1e-6)).alias("iou"), dice.alias("dice_loss"), (0.5 * bce + 0.5 * dice).alias("bce_dice_loss"))


def map_loss(pixels: DataFrame, *group: str) -> DataFrame:
    """Squared error of the character map plus that of the affinity map."""
    error = [F.avg(F.pow(F.col(f"{m}_pred") - F.col(f"{m}_target"), 2)) for m in ("char", "affinity")]
    return pixels.groupBy(*group).agg((error[0] + error[1]).alias("loss"))


def best_so_far(log: DataFrame, metric: str, patience: int = T.patience, *run: str) -> DataFrame:
    """An epoch log with the best metric up to each epoch, whether it is new, how many epochs since, and whether to stop."""
    order = Window.partitionBy(*run).orderBy("epoch")
    before = F.min(metric).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = log.withColumn("improved", before.isNull() | (F.col(metric) < before)).withColumn("best", F.min(metric).over(order))
    rows = rows.withColumn("_run", F.sum(F.col("improved").cast("int")).over(order))
    misses = F.row_number().over(Window.partitionBy(*run, "_run").orderBy("epoch")) - 1
    rows = rows.withColumn("misses", misses).withColumn("_stop", (F.col("misses") >= patience).cast("int"))
    return rows.withColumn("stopped", F.max("_stop").over(order) == 1).drop("_run", "_stop")
