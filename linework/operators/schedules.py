"""Learning rates over a training log."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.operators.folds import folded

#: Fixed: the share that a metric must fall by to count as better, and the least change of a rate.
THRESHOLD, EPSILON = 1e-4, 1e-8


def plateau_rates(log: DataFrame, metric: str, rate: float, *run: str, factor: float = 0.5, patience: int = 3, least: float = 0.0) -> DataFrame:
    """(run, epoch, best, bad, rate): the rate after each epoch of a log (run, epoch, metric).

    An epoch is better if its metric is under the best by a share of it. After more than `patience` others in a row the rate
    falls by the factor and the count begins anew: what counts depends on what was done, so this is a fold and no window.
    It holds three numbers of a run. A null metric, or one that is no number, is no better; epochs of one number go by metric.
    """

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        current: tuple | None = None
        best, bad, now = math.inf, 0, rate
        for *name, epoch, value in rows:
            if name != current:
                current, best, bad, now = name, math.inf, 0, rate
            if value is not None and value < best * (1 - THRESHOLD):
                best, bad = value, 0
            else:
                bad += 1
            if bad > patience:
                lower = max(now * factor, least)
                if now - lower > EPSILON:
                    now = lower
                bad = 0
            yield (*name, epoch, best, bad, now)

    kinds = {f.name: f.dataType.simpleString() for f in log.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*run, "epoch")) + ", best double, bad int, rate double"
    some = log.select(*run, "epoch", F.col(metric).cast("double").alias(metric))
    return folded(some, fold, schema, [*run, "epoch", metric], [*run, "epoch", metric], groups=len(run))


def warm_up(step: Column | str, warmup: Column | int, total: Column | int) -> Column:
    """The share of the full rate at a step, from 0: rising evenly over warmup steps, then falling to 0 at total."""
    step = F.col(step) if isinstance(step, str) else step
    warmup, total = (x if isinstance(x, Column) else F.lit(x) for x in (warmup, total))
    falling = F.greatest(F.lit(0.0), (total - step) / F.greatest(F.lit(1), total - warmup))
    return F.when(step < warmup, step / F.greatest(F.lit(1), warmup)).otherwise(falling)
