"""One-dimensional ink profiles: smoothing, valleys, cuts, runs. Windows are always within a page."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.config import CONFIG

D = CONFIG.detection


def gaussian_weights(window: int) -> list[float]:
    raw = [math.exp(-0.5 * (k - window // 2) ** 2 / (window / 4) ** 2) for k in range(window)]
    return [x / sum(raw) for x in raw]


def smooth(profile: DataFrame, window: int = D.smooth_window, value: str = "ink", out: str = "smooth", page: str = "page_id") -> DataFrame:
    """profile with the value smoothed by a centred Gaussian; beyond the page is 0. Windows under 3 change nothing.

    As in "same" convolution, an even window leans to the earlier side.
    """
    if window < 3:
        return profile.withColumn(out, F.col(value).cast("double"))
    order = Window.partitionBy(page).orderBy("y")
    half = (window - 1) // 2
    weights = gaussian_weights(window)
    terms = [F.lit(w) * F.coalesce(F.lag(value, k - half).over(order) if k >= half else F.lead(value, half - k).over(order), F.lit(0)) for k, w in enumerate(weights)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return profile.withColumn(out, total)


def box_smooth(profile: DataFrame, window: int = D.smooth_window, value: str = "ink", out: str = "smooth", page: str = "page_id") -> DataFrame:
    half = window // 2
    return profile.withColumn(out, F.sum(value).over(Window.partitionBy(page).orderBy("y").rowsBetween(-half, half)) / window)


def _islands(profile: DataFrame, on: Column, page: str = "page_id") -> DataFrame:
    """Runs of rows where on holds: page, first and last y, the y after it, or null at the page's end."""
    order = Window.partitionBy(page).orderBy("y")
    rows = profile.withColumn("_on", on).withColumn("_start", (F.col("_on") & ~F.coalesce(F.lag("_on").over(order), F.lit(False))).cast("int"))
    rows = rows.withColumn("_next", F.lead("y").over(order)).withColumn("_run", F.sum("_start").over(order)).where("_on")
    last = F.max(F.struct("y", "_next"))
    return rows.groupBy(page, "_run").agg(F.min("y").alias("first"), last.alias("l")).select(page, "first", F.col("l.y").alias("last"), F.col("l._next").alias("after"))


def valley_cuts(profile: DataFrame, window: int = D.smooth_window, depth: float = D.valley_depth) -> DataFrame:
    """(page_id, cut): the middle of each valley of the smoothed profile that ends before the page does."""
    rows = smooth(profile, window)
    peak = F.max("smooth").over(Window.partitionBy("page_id"))
    low = _islands(rows.withColumn("peak", peak).where("peak > 0"), F.col("smooth") < F.col("peak") * depth)
    return low.where("after is not null").select("page_id", F.floor((F.col("first") + F.col("after")) / 2).cast("int").alias("cut"))


def refined_cuts(profile: DataFrame, cuts: DataFrame, reach: int = D.seam) -> DataFrame:
    """(page_id, cut): each cut moved to the row of least ink within reach, the first on ties; equal cuts become one."""
    near = cuts.select("page_id", "cut", F.explode(F.sequence(F.col("cut") - reach, F.col("cut") + reach)).alias("y"))
    met = near.join(profile.select("page_id", "y", "ink"), ["page_id", "y"])
    return met.groupBy("page_id", "cut").agg(F.min(F.struct("ink", "y")).alias("m")).select("page_id", F.col("m.y").alias("cut")).distinct()


def profile_boxes(profile: DataFrame, sizes: DataFrame, window: int = D.smooth_window) -> DataFrame:
    """(page_id, x1, y1, x2, y2): the page-wide bands between cuts that are high and inked enough.

    sizes has page_id, width, height. Bands join their rows by the running number of cuts at or before them.
    """
    cuts = refined_cuts(profile, valley_cuts(profile, window))
    order = Window.partitionBy("page_id").orderBy("y")
    rows = profile.join(cuts.select("page_id", F.col("cut").alias("y"), F.lit(1).alias("is_cut")), ["page_id", "y"], "left")
    band = F.sum(F.coalesce("is_cut", F.lit(0))).over(order)
    bands = rows.withColumn("band", band).groupBy("page_id", "band").agg(F.min("y").alias("y1"), (F.max("y") + 1).alias("y2"), F.sum("ink").alias("ink"))
    least = F.greatest(F.lit(3), (F.col("width") * D.min_pixel_ratio).cast("int"))
    return bands.join(sizes, "page_id").where((F.col("y2") - F.col("y1") >= D.min_height) & (F.col("ink") >= least)).select("page_id", F.lit(0).alias("x1"), "y1", F.col("width").alias("x2"), "y2")


def refine_regions(regions: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes found inside regions, in the page's coordinates; a region without any stays as it is.

    regions: page_id, region, x1, y1, x2, y2; boxes: page_id, region and local coordinates lx1 to ly2.
    """
    met = regions.join(boxes, ["page_id", "region"], "left")
    return met.select(
        "page_id", "region", (F.col("x1") + F.coalesce("lx1", F.lit(0))).alias("x1"), (F.col("y1") + F.coalesce("ly1", F.lit(0))).alias("y1"),
        F.coalesce(F.col("x1") + F.col("lx2"), F.col("x2")).alias("x2"), F.coalesce(F.col("y1") + F.col("ly2"), F.col("y2")).alias("y2"),
    )


def run_count(profile: DataFrame, share: float = D.peak_share, value: str = "ink") -> DataFrame:
    """(page_id, runs): how often the value rises above a share of the page's peak; 0 for pages without ink."""
    order = Window.partitionBy("page_id").orderBy("y")
    peak = F.max(value).over(Window.partitionBy("page_id"))
    rows = profile.withColumn("peak", peak).withColumn("on", (F.col("peak") > 0) & (F.col(value) > F.col("peak") * share))
    rows = rows.withColumn("rise", F.col("on") & ~F.coalesce(F.lag("on").over(order), F.lit(False)))
    return rows.groupBy("page_id").agg(F.count_if("rise").alias("runs"))


def run_boxes(profile: DataFrame, share: float = 0.08, least: int = D.min_height, pad: int = D.padding) -> DataFrame:
    """(page_id, y1, y2): padded runs of the box-smoothed profile above a share of its peak; one open at the end closes there.

    profile also has height, the page's. Rows of a run are least or more.
    """
    rows = box_smooth(profile)
    peak = F.max("smooth").over(Window.partitionBy("page_id"))
    runs = _islands(rows.withColumn("peak", peak).where("peak > 0"), F.col("smooth") > F.col("peak") * share)
    height = profile.groupBy("page_id").agg(F.max("height").alias("height"))
    stop = F.coalesce("after", F.col("last"))
    return runs.withColumn("stop", stop).where(F.col("stop") - F.col("first") >= least).join(height, "page_id").select(
        "page_id", F.greatest(F.lit(0), F.col("first") - pad).alias("y1"), F.least("height", F.col("stop") + pad).alias("y2")
    )


def difficulty(columns: DataFrame, *line: str) -> DataFrame:
    """(line, difficulty_tag) of column sums (line, x, ink): hard where their variance over the highest is large."""
    top = F.max("ink")
    variance = F.var_pop("ink") / (top * top)
    return columns.groupBy(*line).agg(F.when((top > 0) & (variance > D.hard_variance), "hard").otherwise("clean").alias("difficulty_tag"))


def verify_segmentation(profile: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per page: peaks, detected boxes, median height, too tall boxes, whether too few were found, and a warning or null; and the boxes
    that are too tall. A page without boxes has no peaks counted: its warning says that there are no lines.
    """
    smoothed = smooth(profile).select("page_id", "y", F.col("smooth").alias("ink"))
    peaks = run_count(smoothed).withColumnRenamed("runs", "peak_estimate")
    heights = boxes.withColumn("height", F.col("y2") - F.col("y1"))
    stats = heights.groupBy("page_id").agg(F.count("*").alias("detected_count"), F.median("height").alias("median_height"))
    tall = heights.join(stats, "page_id").where(F.col("height") > F.col("median_height") * D.tall_ratio).select("page_id", "seq", "height", "median_height")
    merged = tall.groupBy("page_id").agg(F.count("*").alias("merged_count"))
    pages = peaks.join(stats, "page_id", "left").join(merged, "page_id", "left").fillna(0, ["detected_count", "merged_count"])
    pages = pages.withColumn("peak_estimate", F.when(F.col("detected_count") > 0, F.col("peak_estimate")).otherwise(0))
    pages = pages.withColumn("too_few", F.col("detected_count") < F.col("peak_estimate") * D.peak_tolerance)
    few = F.when(F.col("too_few"), F.format_string("detected %d but projection suggests ~%d", "detected_count", "peak_estimate"))
    many = F.when(F.col("merged_count") > 0, F.format_string("%d crop(s) may be merged lines", "merged_count"))
    issues = F.concat_ws("; ", few, many)
    warning = F.when(F.col("detected_count") == 0, "No lines detected.").when(issues != "", F.concat(F.lit("Line segmentation warning: "), issues))
    return pages.withColumn("warning", warning), tall


def otsu(histogram: DataFrame, *group: str) -> DataFrame:
    """(group, threshold) of (group, level, n): the level that parts the counts with most variance between, the first on ties."""
    up = Window.partitionBy(*group).orderBy("level")
    everything = Window.partitionBy(*group)
    n0, s0 = F.sum("n").over(up), F.sum(F.col("n") * F.col("level")).over(up)
    n, s = F.sum("n").over(everything), F.sum(F.col("n") * F.col("level")).over(everything)
    rows = histogram.select(*group, "level", n0.alias("n0"), s0.alias("s0"), n.alias("n"), s.alias("s"))
    gap = F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / (F.col("n") - F.col("n0"))
    between = F.when((F.col("n0") > 0) & (F.col("n0") < F.col("n")), F.col("n0") * 1.0 * (F.col("n") - F.col("n0")) * gap * gap).otherwise(0.0)
    return rows.groupBy(*group).agg(F.max(F.struct(F.round(between, 6).alias("v"), (-F.col("level")).alias("l"))).alias("m")).select(*group, (-F.col("m.l")).alias("threshold"))
