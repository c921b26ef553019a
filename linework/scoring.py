"""Models behind one interface: anything that turns batches of rows into batches of rows."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.config import CONFIG
from linework.operators.boxes import by_page


class Scorer(Protocol):
    """A model: the schema it gives, and its predictions. load() runs once per worker; a missing checkpoint must raise."""

    schema: str

    def load(self) -> object: ...

    def predict(self, model: object, rows: pd.DataFrame) -> pd.DataFrame: ...


class MissingCheckpoint(RuntimeError):
    """A model is asked for whose checkpoint isn't there. Nothing stands in for it silently."""


def checkpoint(path: str | None) -> str:
    """The path, if a file is there; else MissingCheckpoint. For load() of scorers."""
    if not path or not os.path.isfile(path):
        raise MissingCheckpoint(f"no checkpoint at {path!r}: train the model first, or switch it off")
    return path


def scored(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """rows through the scorer, the model loaded once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = scorer.load()
        for batch in batches:
            yield scorer.predict(model, batch)

    return rows.mapInPandas(run, scorer.schema)


def scored_regions(regions: DataFrame, scorer: Scorer, least: int = CONFIG.detection.region_min_side) -> DataFrame:
    """Regions (page_id, seq, box, pixels, height, width) through a scorer of the boxes in them; small ones pass as they are."""
    large = (F.col("height") >= least) & (F.col("width") >= least)
    box = ("page_id", "seq", "x1", "y1", "x2", "y2")
    return scored(regions.where(large), scorer).select(*box).unionByName(regions.where(~large).select(*box))


def highest(regions: DataFrame) -> DataFrame:
    """(page_id, x, y, value) of regions' score maps (page_id, x1, y1, x2, y2, scores: rows of values) laid on their page, the highest where they overlap.

    A map is stretched to its region, each pixel taking the score at its place.
    """
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    rows = by_page(regions.where((w > 0) & (h > 0))).withColumn("y", F.explode(F.sequence(F.col("y1"), F.col("y2") - 1)))
    line = F.get("scores", F.floor((F.col("y") - F.col("y1")) * F.size("scores") / h).cast("int"))
    rows = rows.withColumn("line", line).withColumn("x", F.explode(F.sequence(F.col("x1"), F.col("x2") - 1)))
    value = F.get("line", F.floor((F.col("x") - F.col("x1")) * F.size("line") / w).cast("int"))
    return rows.select("page_id", "x", "y", value.alias("value")).groupBy("page_id", "x", "y").agg(F.max("value").alias("value"))


def with_fallback(primary: DataFrame, fallback: Callable[[DataFrame], DataFrame], inputs: DataFrame, key: str) -> DataFrame:
    """The primary's rows, and the fallback's for inputs of which the primary has none."""
    missing = inputs.join(primary.select(key).distinct(), key, "left_anti")
    return primary.unionByName(fallback(missing))


def routed(lines: DataFrame, second: DataFrame, threshold: float, *keys: str) -> DataFrame:
    """Each line's reading, or the second one's where the first is less sure than threshold."""
    met = lines.join(second.select(*keys, F.col("raw_text").alias("_text"), F.col("confidence").alias("_p")), list(keys), "left")
    turn = (F.col("confidence") < threshold) & F.col("_text").isNotNull()
    return met.withColumns({"raw_text": F.when(turn, F.col("_text")).otherwise(F.col("raw_text")), "confidence": F.when(turn, F.col("_p")).otherwise(F.col("confidence"))}).drop("_text", "_p")
