"""Reads page files: python -m linework (--image FILE | --folder PAGES | --pdf FILE --renderer module:function) --out RESULTS
[--scorer module:Class] [--ground-truth FILE] [--debug FOLDER]."""

import argparse
import importlib

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from linework import sinks, sources
from linework.operators import metrics
from linework.plans import pages


def named(place: str):
    module, _, name = place.partition(":")
    return getattr(importlib.import_module(module), name)


def main() -> None:
    ask = argparse.ArgumentParser(description=__doc__)
    what = ask.add_mutually_exclusive_group(required=True)
    what.add_argument("--image", help="one page file")
    what.add_argument("--folder", help="a folder of page files")
    what.add_argument("--pdf", help="a PDF file, or several by a pattern")
    ask.add_argument("--renderer", help="module:function that gives the pages of a PDF file's bytes")
    ask.add_argument("--debug", help="folder for each stage's table")
    ask.add_argument("--normalize-strokes", action="store_true")
    ask.add_argument("--out", required=True)
    ask.add_argument("--scorer", default="linework.plans.pages:InkScorer", help="module:Class of the recogniser")
    ask.add_argument("--dictionary", help="file of words and counts to correct by")
    ask.add_argument("--hierarchical", action="store_true")
    ask.add_argument("--ground-truth", help="text file of the lines in order")
    args = ask.parse_args()
    log = sinks.get_logger("linework")
    spark = SparkSession.builder.getOrCreate()
    scorer = named(args.scorer)()
    dictionary = sources.word_frequencies(spark, args.dictionary) if args.dictionary else None
    options = {"dictionary": dictionary, "hierarchical": args.hierarchical, "strokes": args.normalize_strokes, "debug": args.debug}
    if args.image:
        docs, lines = pages.run_image(spark, args.image, scorer, **options)
    elif args.folder:
        docs, lines = pages.run_folder(spark, args.folder, scorer, **options)
    else:
        if not args.renderer:
            ask.error("--pdf needs a --renderer")
        docs, lines = pages.run_pdf(spark.read.format("binaryFile").load(args.pdf), named(args.renderer), scorer, **options)
    lines = lines.persist()
    sinks.save_text_files(lines, f"{args.out}/text")
    sinks.save_confidence_csv(lines, f"{args.out}/confidence")
    sinks.save_pdf_files(lines, f"{args.out}/pdf")
    docs.select("doc_id", "lines", "mean_confidence", "low_confidence_count").write.mode("overwrite").option("header", True).csv(f"{args.out}/summary")
    if args.ground_truth:
        truth = sources.ground_truth(spark, args.ground_truth).select(F.col("line_no").alias("line_index"), F.col("text").alias("reference"))
        number = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_index")) - 1
        said = lines.withColumn("line_index", number).select("doc_id", "line_index", F.col("corrected_text").alias("prediction"), F.col("difficulty_tag").alias("tag"), "needs_review")
        metrics.evaluate(metrics.paired(said, truth, "line_index", every=True)).write.mode("overwrite").option("header", True).csv(f"{args.out}/evaluation")
    log.info("results are in %s", args.out)


if __name__ == "__main__":
    main()
