"""File listings and text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.config import CONFIG
from linework.functions.text import PAD, encode_characters, strip
from linework.operators.datasets import stem, suffix, training_labels

#: Fixed: file suffixes of page images.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "tiff", "bmp")
#: What the built-in decoder reads.
RAW_SUFFIXES = ("pgm", "ppm", "pnm")


def image_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES, content: bool = True) -> DataFrame:
    """(path, stem, ext, length[, content]) of a folder's page files, not of its subfolders. Sort by path for order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    out = files.where(suffix(F.col("path")).isin(*suffixes)).select("path", stem(F.col("path")).alias("stem"), suffix(F.col("path")).alias("ext"), "length", *(["content"] if content else []))
    return out


def mask_files(spark: SparkSession, folder: str) -> DataFrame:
    return image_files(spark, folder, ("png", "jpg", "bmp"), content=False).select("stem", "ext", F.col("path").alias("mask"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, text) of a text file, stripped as a whole and cut at line ends."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(strip("value"), r"\r\n|[\n\r\x{B}\x{C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]")).alias("line_no", "text"))


def box_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, seq, x1, y1, x2, y2) of label files with a box of four numbers a line; other lines are skipped.

    Numbers stay as they are written: boxes.scaled() scales them before it cuts them to whole ones.
    """
    rows = spark.read.text(folder, wholetext=True).select(stem(F.input_file_name()).alias("page_id"), F.posexplode(F.split("value", "\n")).alias("seq", "line"))
    parts = F.split(strip("line"), ",")
    numbers = [F.get(parts, i).try_cast("double") for i in range(4)]
    rows = rows.where(F.size(parts) == 4).select("page_id", "seq", *[n.alias(c) for n, c in zip(numbers, ("x1", "y1", "x2", "y2"), strict=True)])
    return rows.dropna().select(F.url_decode("page_id").alias("page_id"), "seq", "x1", "y1", "x2", "y2")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(char, id) of a JSON object of characters and ids."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,int>")).alias("char", "id"))


def word_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(term, count) of a file with a word and its count a line."""
    parts = F.split(strip("value"), r"\s+")
    return spark.read.text(path).select(F.get(parts, 0).alias("term"), F.get(parts, 1).try_cast("long").alias("count")).where("term <> '' and count is not null")


def lines_dataset(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(source, image, text) of an exported line set in Parquet."""
    return spark.read.parquet(path).select(F.lit(source).alias("source"), "image", F.coalesce("text", F.lit("")).alias("text"))


def encoded_lines(lines: DataFrame, vocabulary: Column, most: int = CONFIG.training.max_text) -> DataFrame:
    """lines with the ids of their text, cut to most and padded to it, and the labels that losses read, padding ignored."""
    ids = F.slice(encode_characters("text", vocabulary), 1, most)
    full = F.concat(ids, F.array_repeat(F.lit(PAD), F.lit(most) - F.size(ids)))
    return lines.withColumn("ids", full).withColumn("labels", training_labels(F.col("ids")))
