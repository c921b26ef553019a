"""From page files to documents: preparation, line detection, recognition, post-processing.

Pages are the unit of pixel work; all between pixel passes is relational. Pages that can't be read, and pages without lines, give
documents without lines rather than nothing.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linework import sinks, sources
from linework.config import CONFIG
from linework.functions.text import clean_noise
from linework.operators import boxes as B
from linework.operators import confidence as K
from linework.operators import fuzzy, pixels
from linework.operators import signal as P
from linework.operators.decoding import Step, decode
from linework.scoring import Scorer, checkpoint, scored, scored_regions, with_fallback

D = CONFIG.detection
CROPS = "page_id string, seq int, x1 int, y1 int, x2 int, y2 int, height int, width int, channels int, pixels binary, difficulty_tag string"
REGIONS = "page_id string, seq int, x1 int, y1 int, x2 int, y2 int, height int, width int, channels int, pixels binary"
WORDS = "page_id string, idx int, x1 int, y1 int, x2 int, y2 int"


def page_sizes(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "width", "height")


def kept(rows: DataFrame) -> DataFrame:
    """rows, whose pixel work is done once however many plans read them: kept on executors' disks, and made anew where one is lost."""
    return rows.persist(StorageLevel.DISK_ONLY)


def region_pixels(binary: DataFrame, regions: DataFrame) -> DataFrame:
    """(page_id, seq, box, height, width, channels, pixels): the part of its page that each region shows; empty ones go."""
    lists = regions.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x1", "y1", "x2", "y2"))).alias("boxes"))

    def one(row) -> Iterator[tuple]:
        page = pixels._page(row)
        for b in row.boxes:
            x1, y1, x2, y2 = max(0, b["x1"]), max(0, b["y1"]), min(row.width, b["x2"]), min(row.height, b["y2"])
            if x2 > x1 and y2 > y1:
                part = np.ascontiguousarray(page[y1:y2, x1:x2])
                yield row.page_id, b["seq"], x1, y1, x2, y2, y2 - y1, x2 - x1, part.size // ((y2 - y1) * (x2 - x1)), part.tobytes()

    some = binary.select("page_id", "height", "width", "channels", "pixels") if "channels" in binary.columns else binary.select("page_id", "height", "width", "pixels")
    return pixels._mapped(some.join(lists, "page_id"), REGIONS, one)


def candidate_regions(pages: DataFrame, first: Scorer | None = None, second: Scorer | None = None) -> DataFrame:
    """(page_id, seq, box): regions of a page detector, then of a region detector within those.

    The first one's boxes stand for a page, or the whole page where it has none or is not used; the second one finds boxes
    inside these, in the page's coordinates, and where it finds none in a page they stand as they are. Small regions pass it by.
    """
    box = ("page_id", "seq", "x1", "y1", "x2", "y2")
    sizes = page_sizes(pages)
    whole = sizes.select("page_id", F.lit(0).alias("seq"), F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.col("width").alias("x2"), F.col("height").alias("y2"))
    found = whole
    if first is not None:
        found = with_fallback(kept(scored(pages, first).select(*box)), lambda rest: whole.join(rest.select("page_id"), "page_id", "left_semi"), sizes, "page_id")
    if second is None:
        return found
    found = kept(found)
    inner = kept(scored_regions(region_pixels(pages, found), second))
    return with_fallback(inner, lambda rest: found.join(rest.select("page_id"), "page_id", "left_semi"), sizes, "page_id")


def bands(binary: DataFrame, regions: DataFrame) -> DataFrame:
    """(page_id, seq, box): the bands of each region's own ink profile, top to bottom; a region without any is one itself."""
    key = F.concat_ws("#", "page_id", F.col("seq").cast("string"))
    parts = kept(region_pixels(binary, regions)).withColumn("region_id", key)
    as_pages = parts.select(F.col("region_id").alias("page_id"), "height", "width", "pixels")
    local = P.profile_boxes(pixels.ink_profile(as_pages), page_sizes(as_pages))
    local = local.select(F.col("page_id").alias("region_id"), *[F.col(c).alias(f"l{c}") for c in ("x1", "y1", "x2", "y2")])
    local = parts.select("region_id", "page_id", F.col("seq").alias("region")).join(local, "region_id").drop("region_id")
    found = P.refine_regions(parts.select("page_id", F.col("seq").alias("region"), "x1", "y1", "x2", "y2"), local)
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("y1", "region", "x1")) - 1
    return found.select("page_id", rank.alias("seq"), "x1", "y1", "x2", "y2")


def detect_lines(binary: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """(page_id, seq, box): lines of binary pages, top to bottom, within regions (page_id, seq, box) where a page has some.

    Bands of the ink profile take the parts that bleed into them, shrink to their ink and are padded.
    """
    sizes = page_sizes(binary)
    whole = sizes.select("page_id", F.lit(0).alias("seq"), F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.col("width").alias("x2"), F.col("height").alias("y2"))
    if regions is not None:
        whole = with_fallback(regions.select(*whole.columns), lambda rest: whole.join(rest.select("page_id"), "page_id", "left_semi"), sizes, "page_id")
    grown = B.bleeding_components(kept(bands(binary, whole)), pixels.component_rows(binary), sizes)
    tight = pixels.tightened_rows(binary, grown)
    return B.padded(tight.join(sizes, "page_id")).select("page_id", "seq", "x1", "y1", "x2", "y2")


def detected(binary: DataFrame, pages: DataFrame | None = None, first: Scorer | None = None, second: Scorer | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(crops, checks, stages) of pages: two detectors in their order if given, bands, difficulty tags, and the check of the segmentation.

    pages are what the detectors look at, else the binary ones. stages: the regions and boxes that crops come of.
    """
    regions = kept(candidate_regions(binary if pages is None else pages, first, second))
    boxes = kept(detect_lines(binary, regions if first or second else None))
    checks, _ = P.verify_segmentation(pixels.ink_profile(binary), boxes)
    stages = regions.withColumn("stage", F.lit("regions")).unionByName(boxes.withColumn("stage", F.lit("lines")))
    return line_crops(binary, boxes), checks, stages


def line_crops(binary: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each box's pixels, with the difficulty that its columns' ink shows."""
    lists = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x1", "y1", "x2", "y2"))).alias("boxes"))

    def one(row) -> Iterator[tuple]:
        page = pixels._page(row, True)
        for b in row.boxes:
            crop = page[b["y1"] : b["y2"], b["x1"] : b["x2"]]
            ink = (crop == pixels.INK).sum(0).astype(float)
            hard = ink.size and ink.max() > 0 and float(np.var(ink / ink.max())) > D.hard_variance
            yield row.page_id, b["seq"], b["x1"], b["y1"], b["x2"], b["y2"], *crop.shape, 1, crop.tobytes(), "hard" if hard else "clean"

    return pixels._mapped(binary.select("page_id", "height", "width", "pixels").join(lists, "page_id"), CROPS, one)


def word_strips(binary: DataFrame) -> DataFrame:
    """Crops of whole lines stitched of their words, left to right with gaps; pages without words have none."""

    def one(row) -> Iterator[tuple]:
        for k, b in enumerate(pixels.word_boxes(pixels._page(row, True))):
            yield row.page_id, k, *b

    words = pixels._mapped(binary.select("page_id", "height", "width", "pixels"), WORDS, one)
    placed = B.strip_offsets(B.grouped_lines(words, D.strip_group_ratio))
    item = F.struct("word_order", "x1", "y1", "x2", "y2", "strip_x", "strip_y", "strip_height")
    lists = placed.groupBy("page_id", "line_index").agg(F.array_sort(F.collect_list(item)).alias("words")).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("line_index", "words"))).alias("lines"))

    def strip(row) -> Iterator[tuple]:
        page = pixels._page(row, True)
        for line in row.lines:
            ws = line["words"]
            out = np.full((ws[0]["strip_height"], max(w["strip_x"] + w["x2"] - w["x1"] for w in ws)), pixels.PAPER, np.uint8)
            for w in ws:
                crop = page[w["y1"] : w["y2"], w["x1"] : w["x2"]]
                out[w["strip_y"] : w["strip_y"] + crop.shape[0], w["strip_x"] : w["strip_x"] + crop.shape[1]] = crop
            box = min(w["x1"] for w in ws), min(w["y1"] for w in ws), max(w["x2"] for w in ws), max(w["y2"] for w in ws)
            yield row.page_id, line["line_index"], *box, *out.shape, 1, out.tobytes(), "clean"

    return pixels._mapped(binary.select("page_id", "height", "width", "pixels").join(lists, "page_id"), CROPS, strip)


def recognise(crops: DataFrame, scorer: Scorer) -> DataFrame:
    """Lines of crops: doc_id, line_index, raw_text, confidence, word_confidences, difficulty_tag, needs_review.

    The scorer gives token rows (page_id, seq, tok_index, tok, p) of the crops that are large enough; the other crops are
    lines of empty text. Doubtful tokens are masked, and unsure lines with more words than ink go to review.
    """
    ok = K.valid_crop("height", "width")
    tokens = scored(crops.where(ok), scorer)
    line = ("page_id", "seq")
    masked = K.masked_lines(tokens, *line).withColumnRenamed("text", "raw_text")
    words = K.word_confidences(tokens, *line).groupBy(*line).agg(F.array_sort(F.collect_list(F.struct("word_index", "word", "confidence", "low"))).alias("ws"))
    words = words.select(*line, F.transform("ws", lambda w: F.struct(w["word"].alias("word"), w["confidence"].alias("confidence"), w["low"].alias("low"))).alias("word_confidences"))
    odds = tokens.groupBy(*line).agg(F.collect_list("p").alias("ps"))

    def ink(row) -> Iterator[tuple]:
        sums = (pixels._page(row, True) == pixels.INK).sum(0).astype(float)
        smooth = np.convolve(sums, np.ones(5) / 5, mode="same") if len(sums) else sums
        on = smooth > (smooth.max() * 0.05 if len(smooth) else 0)
        yield row.page_id, row.seq, int(np.count_nonzero(on & ~np.concatenate([[False], on[:-1]])))

    runs = pixels._mapped(crops.where(ok).select("page_id", "seq", "height", "width", "pixels"), "page_id string, seq int, runs int", ink)
    met = crops.select(*line, "difficulty_tag").join(masked, list(line), "left").join(words, list(line), "left").join(odds, list(line), "left").join(runs, list(line), "left")
    text, p = F.coalesce("raw_text", F.lit("")), F.coalesce("ps", F.array().cast("array<double>"))
    return met.select(
        F.col("page_id").alias("doc_id"), F.col("seq").alias("line_index"), text.alias("raw_text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "word_confidences", "difficulty_tag", K.hallucination_risk(text, p, F.coalesce("runs", F.lit(0))).alias("needs_review"),
    )


def document_lines(lines: DataFrame, dictionary: DataFrame | None = None, whitelist: list[str] | None = None) -> DataFrame:
    """Post-processed lines: blank ones gone, noise cleaned and, given a dictionary, words corrected."""
    if dictionary is None:
        return K.postprocess(lines, clean_noise("raw_text"))
    kept = fuzzy.corrected(lines, dictionary, whitelist)
    return K.postprocess(kept, F.col("corrected_text"))


def documents(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """A row for every page, with its lines' summary or none."""
    found = K.summaries(lines)
    zero = F.lit(0).cast("long")
    return pages.select(F.col("page_id").alias("doc_id")).join(found, "doc_id", "left").select(
        "doc_id", F.coalesce("lines", zero).alias("lines"), F.coalesce("mean_confidence", F.lit(0.0)).alias("mean_confidence"), F.coalesce("low_confidence_count", zero).alias("low_confidence_count"), F.coalesce("full_text", F.lit("")).alias("full_text")
    )


def run(pages: DataFrame, scorer: Scorer, dictionary: DataFrame | None = None, hierarchical: bool = False, strokes: bool = False, first: Scorer | None = None, second: Scorer | None = None, debug: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, lines) of pages. hierarchical reads stitched word strips, and pages without words by their lines.

    first and second are detectors of pages and of regions. With a debug folder each stage's table is written there.
    """
    binary = kept(pixels.preprocess(sources.valid_pages(pages), strokes))
    crops, checks, stages = detected(binary, None, first, second)
    if hierarchical:
        crops = with_fallback(word_strips(binary), lambda rest: crops.join(rest.select("page_id"), "page_id", "left_semi"), binary, "page_id")
    crops = kept(crops)
    lines = document_lines(recognise(crops, scorer), dictionary)
    sinks.save_stages({"original": pages, "binary": binary, "boxes": stages, "segmentation": checks, "crops": crops, "lines": lines}, debug)
    return documents(pages, lines), lines


def run_full_page(pages: DataFrame, page_scorer: Scorer, scorer: Scorer, threshold: float = CONFIG.recognition.route_confidence) -> tuple[DataFrame, DataFrame]:
    """(documents, lines) of pages read whole; those that are read with less mean confidence than threshold, or not at all, are read by lines.

    page_scorer gives (page_id, seq, raw_text, confidence) of pages prepared the way for grid paper.
    """
    valid = sources.valid_pages(pages)
    binary = kept(pixels.preprocess(valid, grid=True))
    whole = kept(scored(binary, page_scorer).select(F.col("page_id").alias("doc_id"), F.col("seq").alias("line_index"), "raw_text", "confidence"))
    sure = whole.groupBy("doc_id").agg(F.avg("confidence").alias("_mean")).where(F.col("_mean") >= threshold).select("doc_id")
    read = whole.join(sure, "doc_id", "left_semi")
    rest = binary.join(sure, binary["page_id"] == sure["doc_id"], "left_anti")
    by_line = recognise(kept(detected(rest)[0]), scorer).select("doc_id", "line_index", "raw_text", "confidence")
    lines = document_lines(read.withColumn("route", F.lit("page")).unionByName(by_line.withColumn("route", F.lit("lines"))))
    return documents(pages, lines), lines


def run_folder(spark: SparkSession, folder: str, scorer: Scorer, suffixes: tuple[str, ...] = sources.files.RAW_SUFFIXES, decoder=sources.decode_pnm, **options) -> tuple[DataFrame, DataFrame]:
    """run() over the page files of a folder."""
    return run(sources.decode_pages(sources.image_files(spark, folder, suffixes), decoder), scorer, **options)


def run_image(spark: SparkSession, path: str, scorer: Scorer, decoder=sources.decode_pnm, **options) -> tuple[DataFrame, DataFrame]:
    """run() over one page file."""
    return run(sources.decode_pages(spark.read.format("binaryFile").load(path), decoder), scorer, **options)


def run_pdf(files: DataFrame, renderer, scorer: Scorer, **options) -> tuple[DataFrame, DataFrame]:
    """run() over the pages of PDF files (path, content)."""
    return run(sources.pdf_pages(files, renderer), scorer, **options)


def predict(crops: DataFrame, path: str, step: Callable[[str], Step], width: int = 1, most: int = CONFIG.training.max_text) -> DataFrame:
    """crops with the ids that a checkpoint's model decodes from their pixels: greedy for a width of one, else by beams.

    step(path) makes the model's step function from a crop's pixels. A checkpoint that isn't there raises MissingCheckpoint at once.
    """
    return decode(crops, "pixels", step(checkpoint(path)), most - 1, width)


def page_masks(pages: DataFrame, scorer: Scorer) -> DataFrame:
    """(page_id, seq, box, score map): the mask that a page detector's model gives for each page, with the boxes read off it.

    The scorer gives (page_id, height, width, scores binary of doubles in rows).
    """
    maps = scored(pages, scorer).select("page_id", F.col("height").alias("rows"), F.col("width").alias("columns"), "scores").join(page_sizes(pages), "page_id")

    def one(row) -> Iterator[tuple]:
        mask = np.frombuffer(row.scores, np.float64).reshape(row.rows, row.columns)
        for k, b in enumerate(pixels.mask_boxes(mask, row.height, row.width)):
            yield row.page_id, k, *b

    return pixels._mapped(maps, "page_id string, seq int, x1 int, y1 int, x2 int, y2 int", one)


class InkScorer:
    """A stand-in recogniser: a token for each ink run of a line, as sure as the run is dense. For tests and dry runs."""

    schema = "page_id string, seq int, tok_index int, tok string, p double"

    def load(self) -> None:
        return None

    def predict(self, model: None, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples():
            ink = (np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width) == 0).mean(0)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], ink > 0, [0]])))
            for k, (a, b) in enumerate(zip(edges[::2], edges[1::2], strict=True)):
                out.append((r.page_id, r.seq, k, f" w{b - a}", float(min(1.0, 0.3 + ink[a:b].mean()))))
        return pd.DataFrame(out, columns=["page_id", "seq", "tok_index", "tok", "p"])
