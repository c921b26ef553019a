"""What results are written as: text, confidence tables, page layouts, reports, metadata."""

import logging
import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.filesink import save_files

#: Fixed: the confidence table's columns.
CONFIDENCE_COLUMNS = ("line_id", "word_id", "word", "word_confidence", "word_low_conf", "line_confidence", "line_low_confidence", "hallucination_risk", "line_text")
#: Points of an A4 page: size, first line, step, lowest line.
PAGE_WIDTH, PAGE_HEIGHT, TOP, STEP, LOWEST = 595, 842, 792, 18, 60


def full_texts(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "corrected_text"))), lambda x: x["corrected_text"]), "\n")
    return lines.groupBy(doc).agg(text.alias("value"))


def save_text(lines: DataFrame, path: str, doc: str = "doc_id", folders: bool = False) -> None:
    """Each document's text as a JSON row (doc, value) of files of bounded size; or, by folders, a text file per document in a folder of
    its own, for few documents: that writer ends the file with a line break; full_texts() has none."""
    texts = full_texts(lines, doc)
    if folders:
        texts.select("value", doc).write.mode("overwrite").partitionBy(doc).text(path)
    else:
        texts.select(doc, "value").write.mode("overwrite").option("maxRecordsPerFile", 100_000).json(path)


def document_name(doc: Column) -> Column:
    """The last part of a document's path without its suffix; a page's label keeps its number."""
    return F.regexp_replace(F.regexp_extract(doc.cast("string"), "([^/]*)$", 1), r"\.[A-Za-z0-9]+(?=( \[page \d+\])?$)", "")


def save_text_files(lines: DataFrame, path: str, doc: str = "doc_id", lists: str | None = None) -> None:
    """A text file for each document: its lines joined by line breaks, with none at the end."""
    save_files(full_texts(lines, doc).select(F.concat(document_name(F.col(doc)), F.lit(".txt")).alias("name"), F.encode("value", "UTF-8").alias("content")), path, lists=lists)


def save_pdf_files(lines: DataFrame, path: str, doc: str = "doc_id", lists: str | None = None) -> None:
    """A PDF file for each document."""
    save_files(pdf_documents(lines, doc).select(F.concat(document_name(F.col(doc)), F.lit(".pdf")).alias("name"), F.col("pdf").alias("content")), path, lists=lists)


def save_stages(stages: dict[str, DataFrame], folder: str | None) -> None:
    """Each stage's table under its name in a folder, for looking at what a run did; nothing without a folder."""
    for name, rows in stages.items() if folder else ():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")


def best_checkpoint(log: DataFrame, metric: str, *run: str) -> DataFrame:
    """The row of each run's epoch log with the lowest metric, the first on ties: whose checkpoint is the one to keep."""
    rank = F.row_number().over(Window.partitionBy(*run).orderBy(F.col(metric).asc_nulls_last(), "epoch"))
    return log.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def confidence_rows(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A row per word, or one for a line without words that has its text as word. Ids count from 1.

    lines has word_confidences: array<struct<word, confidence, low>>. Four decimals are kept as numbers are rounded.
    """
    rows = lines.select(doc, "line_index", "corrected_text", "confidence", "is_low_confidence", "needs_review", F.posexplode_outer("word_confidences").alias("pos", "w"))
    none = F.col("w").isNull()
    return rows.select(
        doc, (F.col("line_index") + 1).alias("line_id"), F.when(none, "").otherwise((F.col("pos") + 1).cast("string")).alias("word_id"), F.when(none, F.col("corrected_text")).otherwise(F.col("w.word")).alias("word"),
        F.round(F.when(none, F.col("confidence")).otherwise(F.col("w.confidence")), 4).alias("word_confidence"), F.when(none, F.col("is_low_confidence")).otherwise(F.col("w.low")).alias("word_low_conf"),
        F.round("confidence", 4).alias("line_confidence"), F.col("is_low_confidence").alias("line_low_confidence"), F.col("needs_review").alias("hallucination_risk"), F.col("corrected_text").alias("line_text"),
    )


def save_confidence_csv(lines: DataFrame, path: str, doc: str = "doc_id") -> None:
    rows = confidence_rows(lines, doc).withColumns({c: F.format_string("%.4f", F.col(c)) for c in ("word_confidence", "line_confidence")})
    rows.repartition(doc).sortWithinPartitions(doc, "line_id", F.col("word_id").try_cast("int")).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').partitionBy(doc).csv(path)


def page_layout(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Where each line stands on A4 pages: page from 1, y in points, red for low confidence."""
    at = F.row_number().over(Window.partitionBy(doc).orderBy("line_index")) - 1
    per_page = (TOP - LOWEST) // STEP + 1
    return lines.select(
        doc, "line_index", (F.floor(at / per_page) + 1).cast("int").alias("page"), (F.lit(TOP) - (at % per_page) * STEP).alias("y"),
        F.when(F.col("is_low_confidence"), "red").otherwise("black").alias("colour"), "corrected_text",
    )


def render_pdf(rows: list[tuple[int, int, str, str]]) -> bytes:
    """A PDF of (page, y, colour, text) rows in a standard font; characters beyond Latin-1 show as '?'."""
    pages: dict[int, list[str]] = {}
    for page, y, colour, text in rows:
        raw = text.encode("latin-1", "replace").decode("latin-1").replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)")
        pages.setdefault(page, []).append(f"{'1 0 0' if colour == 'red' else '0 0 0'} rg BT /F1 11 Tf 50 {y} Td ({raw}) Tj ET")
    order = sorted(pages) or [1]
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{4 + 2 * i} 0 R' for i in range(len(order)))}] /Count {len(order)} >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    for i, page in enumerate(order):
        body = "\n".join(pages.get(page, []))
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {PAGE_WIDTH} {PAGE_HEIGHT}] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>")
        objects.append(f"<< /Length {len(body.encode('latin-1'))} >>\nstream\n{body}\nendstream")
    out, places = b"%PDF-1.4\n", []
    for i, text in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n{text}\nendobj\n".encode("latin-1")
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    return out + f"xref\n0 {len(places) + 1}\n0000000000 65535 f \n{table}trailer << /Size {len(places) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode("latin-1")


def pdf_documents(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, pdf binary): each document's layout rendered, documents in parallel."""
    import pandas as pd

    rows = page_layout(lines, doc).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("line_index", "page", "y", "colour", "corrected_text"))).alias("rows"))

    @F.pandas_udf("binary")
    def render(all_rows: pd.Series) -> pd.Series:
        return pd.Series([render_pdf([(x["page"], x["y"], x["colour"], x["corrected_text"]) for x in one]) for one in all_rows])

    return rows.select(doc, render("rows").alias("pdf"))


def print_results(lines: DataFrame, rows: int = 200) -> None:
    lines.orderBy("doc_id", "line_index").select("line_index", "corrected_text", F.round("confidence", 2).alias("confidence"), "is_low_confidence").show(rows, truncate=False)


def batch_summary(lines: DataFrame, seconds: DataFrame | None = None, doc: str = "doc_id", digits: int = 4) -> DataFrame:
    """(doc, lines, mean_confidence, inference_sec) of every document."""
    rows = lines.groupBy(doc).agg(F.count("*").alias("lines"), F.round(F.avg("confidence"), digits).alias("mean_confidence"))
    if seconds is None:
        return rows
    return seconds.join(rows, doc, "left").select(doc, F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("mean_confidence", F.lit(0.0)).alias("mean_confidence"), F.round("seconds", 2).alias("inference_sec"))


def report_view(each: DataFrame, totals: DataFrame) -> DataFrame:
    """The samples' rows, then a blank one, then the totals as text: one table as spreadsheets have it."""
    blank = F.lit("")
    first = each.select(F.lit(0).alias("part"), F.col("sample_id").cast("long").alias("row"), "prediction", "reference", F.format_string("%.4f", "cer").alias("cer"), F.format_string("%.4f", "wer").alias("wer"), "tag", F.col("needs_review").cast("string").alias("needs_review"))
    place = F.array_position(F.array(*map(F.lit, ("all", "clean", "hard"))), F.col("tag"))
    last = totals.select(F.lit(2).alias("part"), place.cast("long").alias("row"), F.lit("AGGREGATE").alias("prediction"), F.col("tag").alias("reference"), F.format_string("CER=%.4f", "cer").alias("cer"), F.format_string("WER=%.4f", "wer").alias("wer"), F.concat(F.lit("n="), F.col("num_pairs").cast("string")).alias("tag"), blank.alias("needs_review"))
    gap = each.sparkSession.range(1).select(F.lit(1).alias("part"), F.lit(0).cast("long").alias("row"), *[blank.alias(c) for c in ("prediction", "reference", "cer", "wer", "tag", "needs_review")])
    return first.unionByName(gap).unionByName(last)


def metadata_json(pages: DataFrame, stamp: Column | None = None) -> DataFrame:
    """(page_id, value): the preparation of each page as JSON with its time."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss") if stamp is None else stamp
    return pages.select("page_id", F.to_json(F.struct(F.col("page_id").alias("input_image"), "method", "stages", stamp.alias("timestamp"))).alias("value"))


def label_files(boxes: DataFrame) -> DataFrame:
    """(page_id, value): boxes as lines of four numbers."""
    line = F.concat_ws(",", "x1", "y1", "x2", "y2")
    return boxes.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))), lambda x: x["l"]), "\n").alias("value"))


def vocabulary_json(vocabulary: DataFrame) -> DataFrame:
    """(value) of (char, id) rows, in order of id."""
    return vocabulary.agg(F.to_json(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("id", "char"))), lambda x: F.struct(x["char"], x["id"])))).alias("value"))


def get_logger(name: str, path: str | None = None) -> logging.Logger:
    """A logger of the driver: INFO to standard output and, given a path, everything to a file."""
    log = logging.getLogger(name)
    if not log.handlers:
        log.setLevel(logging.DEBUG)
        form = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
        for handler, level in ((logging.StreamHandler(sys.stdout), logging.INFO), *([(logging.FileHandler(path), logging.DEBUG)] if path else [])):
            handler.setLevel(level)
            handler.setFormatter(form)
            log.addHandler(handler)
    return log
