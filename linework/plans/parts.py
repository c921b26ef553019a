"""Queries over single operators, each with its SQL: joins, filters, labels, losses and maps that larger plans are made of."""

from __future__ import annotations

import json

import pandas as pd
import numpy as np
from pyspark.sql import functions as F

from linework import scoring, sinks
from linework.config import CONFIG
from linework.functions import text as T
from linework.operators import boxes as B
from linework.operators import confidence as K
from linework.operators import datasets as S
from linework.operators import losses, pixels
from linework.operators import metrics as M
from linework.operators import signal as P
from linework.plans import canonical as C
from linework.plans.registry import POST, D, R, query, rounded, words_of
from linework.sources import files

CONFIDENCE = "((doc_id * 31 + line_index * 17) % 101) / 100.0::DOUBLE"


# Lines


@query(f"WITH {C.LINES} SELECT doc_id, line_index, raw_text AS prediction, tag FROM lines WHERE line_index % 2 = 0 AND doc_id % 3 <> 0")
def paired_lines(spark, sf):
    rows = C.lines(spark, sf)
    said, truth = rows.where("line_index % 2 = 0").select("doc_id", "line_index", F.col("raw_text").alias("prediction")), rows.where("doc_id % 3 <> 0").select("doc_id", "line_index", "tag")
    return M.paired(said, truth, "doc_id", "line_index")


@query(
    f"""WITH {C.PAIRS} SELECT doc_id, line_index, needs_review OR ({CONFIDENCE} < {R.review_confidence} AND line_index % 2 = 0 AND doc_id % 3 <> 1 AND levenshtein(prediction, reference) / length(reference) > {R.review_cer}) AS needs_review FROM pairs"""
)
def second_opinions(spark, sf):
    rows = C.eval_pairs(spark, sf).select("doc_id", "line_index", F.col("prediction").alias("raw_text"), "reference", "needs_review", (((F.col("doc_id") * 31 + F.col("line_index") * 17) % 101) / 100.0).alias("confidence"), (F.col("line_index") % 2 == 0).alias("valid"))
    second = rows.where("doc_id % 3 <> 1").select("doc_id", "line_index", F.col("reference").alias("second_text"))
    return K.second_opinion_review(rows.drop("reference"), second, "doc_id", "line_index").select("doc_id", "line_index", "needs_review")


@query(
    f"""WITH {C.LINES} SELECT doc_id, line_index, CASE WHEN turn THEN 'second ' || raw_text ELSE raw_text END AS raw_text, CASE WHEN turn THEN 0.9 ELSE confidence END AS confidence
    FROM (SELECT *, confidence < {R.route_confidence} AND line_index % 2 = 0 AS turn FROM lines)"""
)
def confidence_routing(spark, sf):
    rows = C.lines(spark, sf).select("doc_id", "line_index", "raw_text", "confidence")
    second = rows.where("line_index % 2 = 0").select("doc_id", "line_index", F.concat(F.lit("second "), "raw_text").alias("raw_text"), F.lit(0.9).alias("confidence"))
    return scoring.routed(rows, second, R.route_confidence, "doc_id", "line_index")


@query(f"WITH {C.LINES}, sure AS (SELECT doc_id, line_index, raw_text FROM lines WHERE confidence >= 0.9) SELECT * FROM sure UNION ALL SELECT doc_id, line_index, raw_text FROM lines l WHERE line_index = 0 AND NOT EXISTS (SELECT 1 FROM sure s WHERE s.doc_id = l.doc_id)")
def fallback_lines(spark, sf):
    rows = C.lines(spark, sf).select("doc_id", "line_index", "raw_text", "confidence")
    first = rows.where("line_index = 0").select("doc_id", "line_index", "raw_text")
    return scoring.with_fallback(rows.where("confidence >= 0.9").drop("confidence"), lambda rest: first.join(rest.select("doc_id"), "doc_id", "left_semi"), C.table(spark, sf, "documents").select("doc_id"), "doc_id")


@query(
    f"""WITH {C.LINES}, w AS (SELECT unnest({words_of('raw_text')}) AS w FROM lines), c AS (SELECT regexp_extract(w, '^([^a-zA-Z]*)([a-zA-Z'']+)([^a-zA-Z]*)$', 2) AS core FROM w)
    SELECT core, length(core) >= 3 AND NOT regexp_matches(core, '^[A-Z]') AND lower(core) NOT IN ('the', 'and') AS ok, count(*) AS n FROM c WHERE core <> '' GROUP BY ALL"""
)
def correctable_words(spark, sf):
    listed = F.array(F.lit("the"), F.lit("and"))
    core = F.regexp_extract("w", T.WORD_PARTS, 2)
    rows = C.lines(spark, sf).select(F.explode(T.split_words("raw_text")).alias("w")).select(core.alias("core")).where("core <> ''")
    return rows.groupBy("core", T.correctable(F.col("core"), listed).alias("ok")).agg(F.count("*").alias("n"))


@query(f"WITH {C.LINES} SELECT doc_id, line_index, array_to_string({words_of('raw_text')}, ' ') AS text, len({words_of('raw_text')}) AS words FROM lines")
def joined_words(spark, sf):
    words = T.split_words("raw_text")
    return C.lines(spark, sf).select("doc_id", "line_index", T.joined_words(words).alias("text"), F.size(words).cast("long").alias("words"))


@query("SELECT item_id, md5(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '?', 'g'), '[^ -~]', '', 'g')) AS text_md5 FROM benchmark")
def character_round_trip(spark, sf):
    known = T.character_vocabulary()
    vocabulary = F.from_json(F.lit(json.dumps(known)), "map<string,int>")
    inverse = F.map_from_arrays(F.array(*map(F.lit, known.values())), F.array(*map(F.lit, known)))
    ids = T.encode_characters(C.ascii_only(F.coalesce("text", F.lit(""))), vocabulary)
    return C.table(spark, sf, "benchmark").select("item_id", ids.alias("ids")).select("item_id", F.md5(T.decode_characters("ids", inverse)).alias("text_md5"))


MOST = CONFIG.training.max_text


@query(
    f"""WITH v AS (SELECT map_from_entries(list_transform(range(32, 127), lambda c: {{'k': chr(c::INT), 'v': c - 28}})) AS m), b AS (SELECT item_id, regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '?', 'g') AS t FROM benchmark),
    e AS (SELECT item_id, list_concat([1], list_transform(CASE WHEN t = '' THEN [] ELSE string_split(t, '') END, lambda c: coalesce(m[c], 3)), [2])[1:{MOST}] AS ids FROM b, v), f AS (SELECT item_id, list_resize(ids, {MOST}, 0) AS ids FROM e)
    SELECT item_id, md5(array_to_string(ids, ',')) AS ids_md5, md5(array_to_string(list_transform(ids, lambda x: CASE WHEN x = 0 THEN {CONFIG.training.ignore_index} ELSE x END), ',')) AS labels_md5, true AS read_back FROM f"""
)
def encoded_lines(spark, sf):
    vocabulary = F.from_json(F.lit(json.dumps(T.character_vocabulary())), "map<string,int>")
    rows = files.encoded_lines(C.table(spark, sf, "benchmark").select("item_id", C.ascii_only(F.coalesce("text", F.lit(""))).alias("text")), vocabulary)
    digest = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    return rows.select("item_id", digest("ids").alias("ids_md5"), digest("labels").alias("labels_md5"), (S.decoded_labels(F.col("labels")) == F.col("ids")).alias("read_back"))


@query("WITH l AS (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL), n AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS id FROM l) SELECT '{' || string_agg('\"' || lang || '\":' || id, ',' ORDER BY id) || '}' AS value FROM n")
def language_vocabulary(spark, sf):
    langs = C.table(spark, sf, "documents").where("lang is not null").select(F.col("lang").alias("char")).distinct()
    return sinks.vocabulary_json(S.numbered(langs, "char").select("char", F.col("_place").alias("id")))


# Boxes


@query(f"WITH {C.BOXES} SELECT page_id, md5(string_agg(concat_ws(',', x1, y1, x2, y2), chr(10) ORDER BY seq, concat_ws(',', x1, y1, x2, y2))) AS value_md5 FROM boxes GROUP BY page_id")
def label_lines(spark, sf):
    return sinks.label_files(C.boxes(spark, sf)).select("page_id", F.md5("value").alias("value_md5"))


@query(
    f"""WITH {C.BOXES}, f AS (SELECT page_id, seq, unnest([{{'a': 1, 'b': 1, 'c': 5, 'd': 4}}, {{'a': 6, 'b': 2, 'c': 9, 'd': 8}}]) AS l FROM boxes WHERE seq % 2 = 0)
    SELECT b.page_id, b.seq AS region, x1 + coalesce(l.a, 0) AS x1, y1 + coalesce(l.b, 0) AS y1, coalesce(x1 + l.c, x2) AS x2, coalesce(y1 + l.d, y2) AS y2 FROM boxes b LEFT JOIN f ON f.page_id = b.page_id AND f.seq = b.seq"""
)
def refined_regions(spark, sf):
    regions = C.boxes(spark, sf).withColumnRenamed("seq", "region")
    local = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("lx1", "ly1", "lx2", "ly2"), b, strict=True)]) for b in ((1, 1, 5, 4), (6, 2, 9, 8))])).alias("l")
    return P.refine_regions(regions, regions.where("region % 2 = 0").select("page_id", "region", local).select("page_id", "region", "l.*"))


@query(
    f"""WITH {C.BOXES}, c AS (SELECT page_id, seq, y2 - y1 - 12 AS height, x2 - x1 - 40 AS width FROM boxes), v AS (SELECT *, height >= {D.min_height} AND width >= {D.min_width} AS valid FROM c)
    SELECT page_id, seq, valid, CASE WHEN valid THEN 'read' ELSE '' END AS raw_text, CASE WHEN valid THEN 0.5 ELSE 0.0 END AS confidence FROM v"""
)
def crop_results(spark, sf):
    crops = C.boxes(spark, sf).select("page_id", "seq", (F.col("y2") - F.col("y1") - 12).alias("height"), (F.col("x2") - F.col("x1") - 40).alias("width"), F.lit("read").alias("raw_text"), F.lit(0.5).alias("confidence"))
    return K.with_empty_results(crops).select("page_id", "seq", "valid", "raw_text", "confidence")


@query(f"WITH {C.BOXES} SELECT page_id, seq FROM boxes WHERE (x2 - x1) * (y2 - y1) % 600 >= 1000 * 1400 * {D.word_area} AND x2 - x1 >= {D.min_width} AND y2 - y1 >= {D.min_height}")
def word_box_filter(spark, sf):
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) % 600
    return B.large_enough(C.boxes(spark, sf).withColumns({"area": area, "width": F.lit(C.PAGE_WIDTH), "height": F.lit(C.PAGE_HEIGHT)})).select("page_id", "seq")


@query(f"WITH {C.BOXES} SELECT page_id, seq, row_number() OVER (PARTITION BY page_id ORDER BY y1, seq) - 1 AS index FROM boxes WHERE seq::BIGINT * 7 % 100 >= {D.instance_score} * 100")
def scored_instances(spark, sf):
    return B.kept_instances(C.boxes(spark, sf).withColumn("score", (F.col("seq").cast("long") * 7 % 100) / 100.0)).select("page_id", "seq", "index")


@query(
    f"""WITH {C.BOXES}, st AS (SELECT page_id, median(y2 - y1) AS mh, count(*) AS n FROM boxes GROUP BY page_id), c AS (SELECT page_id, row_number() OVER () AS rid, x1 AS x, y1 + 7 AS y, x2 - x1 AS w, (y2 - y1) % 40 + 1 AS h FROM boxes),
    k AS (SELECT c.*, mh, y + h / 2 AS cy FROM c JOIN st USING (page_id) WHERE n > 1 AND h <= greatest({D.min_height}, mh * {D.bleed_height}) AND w <= 1000 * {D.bleed_width}
      AND NOT ((x <= 1 OR y <= 1 OR x + w >= 999 OR y + h >= 1399) AND w * h > 1000 * {D.bleed_edge_area})),
    near AS (SELECT k.*, b.seq, b.y1, b.y2 FROM k JOIN boxes b ON b.page_id = k.page_id QUALIFY row_number() OVER (PARTITION BY rid ORDER BY abs(cy - (b.y1 + b.y2) / 2), b.seq) = 1),
    g AS (SELECT page_id, seq, min(y) AS a, max(y + h) AS b FROM near WHERE y + h >= y1 - greatest({D.padding * 3}, trunc(mh * {D.bleed_reach})) AND y <= y2 + greatest({D.padding * 3}, trunc(mh * {D.bleed_reach})) GROUP BY page_id, seq)
    SELECT o.page_id, o.seq, x1, least(y1, coalesce(a, y1)) AS y1, x2, greatest(y2, coalesce(b, y2)) AS y2 FROM boxes o LEFT JOIN g ON g.page_id = o.page_id AND g.seq = o.seq"""
)
def bleeding_boxes(spark, sf):
    lines = C.boxes(spark, sf)
    w, h, y = F.col("x2") - F.col("x1"), (F.col("y2") - F.col("y1")) % 40 + 1, F.col("y1") + 7
    parts = lines.select("page_id", F.col("x1").alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), (w * h).alias("area"), (y + h / 2.0).alias("cy"))
    pages = lines.select("page_id").distinct().withColumns({"width": F.lit(C.PAGE_WIDTH), "height": F.lit(C.PAGE_HEIGHT)})
    return B.bleeding_components(lines, parts, pages)


class _Halves:
    """A stand-in model: the left half of each region."""

    schema = "page_id long, seq int, x1 int, y1 int, x2 int, y2 int"

    def load(self):
        return None

    def predict(self, model, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(x2=(rows.x1 + rows.x2) // 2)[["page_id", "seq", "x1", "y1", "x2", "y2"]]


@query(f"WITH {C.BOXES} SELECT page_id, seq, x1, y1, CASE WHEN y2 - y1 >= {D.region_min_side} AND x2 - x1 >= {D.region_min_side} THEN (x1 + x2) // 2 ELSE x2 END AS x2, y2 FROM boxes")
def region_scores(spark, sf):
    regions = C.boxes(spark, sf).withColumns({"height": F.col("y2") - F.col("y1"), "width": F.col("x2") - F.col("x1")})
    return scoring.scored_regions(regions, _Halves())


SMALL = "small AS (SELECT page_id, seq, x1 // 20 AS x1, y1 // 20 AS y1, x2 // 20 AS x2, y2 // 20 AS y2 FROM boxes)"


def _small(spark, sf):
    return C.boxes(spark, sf).select("page_id", "seq", *[F.floor(F.col(c) / 20).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(
    f"""WITH {C.BOXES}, {SMALL}, g AS (SELECT *, unnest(range(x1, x2)) AS x FROM small), p AS (SELECT *, unnest(range(y1, y2)) AS y FROM g)
    SELECT page_id, x, y, round(max(exp(-0.5 * (power((x - (x1 + x2) / 2) / greatest(1.0, (x2 - x1) * 0.3), 2) + power((y - (y1 + y2) / 2) / greatest(1.0, (y2 - y1) * 0.3), 2)))), 6) AS value FROM p GROUP BY page_id, x, y"""
)
def gaussian_bumps(spark, sf):
    return B.gaussian_map(_small(spark, sf)).select("page_id", "x", "y", *rounded("value"))


@query(
    f"""WITH {C.BOXES}, {SMALL}, g AS (SELECT *, unnest(range(x1, x2)) AS x FROM small), p AS (SELECT *, unnest(range(y1, y2)) AS y FROM g)
    SELECT page_id, x, y, max([[0.1, 0.5, 0.2], [0.3, 0.9, 0.4]][(y - y1) * 2 // (y2 - y1) + 1][(x - x1) * 3 // (x2 - x1) + 1] + (seq % 7) / 10)::DOUBLE AS value FROM p GROUP BY page_id, x, y"""
)
def overlaid_scores(spark, sf):
    part = (F.col("seq") % 7) / 10
    scores = F.array(*[F.array(*[F.lit(v) + part for v in row]) for row in ((0.1, 0.5, 0.2), (0.3, 0.9, 0.4))])
    return scoring.highest(_small(spark, sf).withColumn("scores", scores))


# Training sets


@query(
    f"""WITH {C.BOXES}, o AS (SELECT page_id AS path, unnest([0, 1]) AS copy, seq, x1, y1, x2, y2 FROM boxes), c AS (SELECT path, copy, seq, x1 + 1 AS x1, y1, x2, y2 FROM o WHERE (seq + copy) % 3 = 0)
    SELECT * FROM c UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.path = o.path AND c.copy = o.copy)"""
)
def surviving_copies(spark, sf):
    first = C.boxes(spark, sf).withColumnRenamed("page_id", "path").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return S.surviving_boxes(first, first.where("(seq + copy) % 3 = 0").withColumn("x1", F.col("x1") + 1))


@query(
    """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS e, unnest(range(64)) AS i FROM embeddings), p AS (SELECT label, 1 / (1 + exp(-40 * e)) AS c, e * e AS a, (i % 3 = 0)::INT::DOUBLE AS ct, (i % 5 = 0)::INT::DOUBLE AS af FROM e),
    s AS (SELECT *, least(greatest(c, 1e-7), 1 - 1e-7) AS q FROM p)
    SELECT label, round(avg(power(c - ct, 2)) + avg(power(a - af, 2)), 6) AS loss, round(0.5 * avg(-(ct * ln(q) + (1 - ct) * ln(1 - q))) + 0.5 * (1 - (2 * sum(c * ct) + 1) / (sum(c) + sum(ct) + 1)), 6) AS bce_dice_loss FROM s GROUP BY label"""
)
def map_losses(spark, sf):
    rows = C.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "e")).withColumn("e", F.col("e").cast("double"))
    rows = rows.select("label", (1 / (1 + F.exp(-40 * F.col("e")))).alias("char_pred"), (F.col("e") * F.col("e")).alias("affinity_pred"), (F.col("i") % 3 == 0).cast("double").alias("char_target"), (F.col("i") % 5 == 0).cast("double").alias("affinity_target"))
    both = losses.overlap_scores(rows.withColumns({"pred": F.col("char_pred"), "target": F.col("char_target")}), "label")
    return losses.map_loss(rows, "label").join(both, "label").select("label", *rounded("loss", "bce_dice_loss"))


@query(
    """WITH e AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch, value FROM events)
    SELECT run, epoch, value FROM e QUALIFY row_number() OVER (PARTITION BY run ORDER BY value, epoch) = 1"""
)
def best_epochs(spark, sf):
    from pyspark.sql import Window

    log = C.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("epoch"), "value")
    return sinks.best_checkpoint(log, "value", "run")


# Pixels

RASTER = """bytes AS (SELECT doc_id, greatest(32, ceil(strlen(coalesce(text, '')) / 64))::INT AS height, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::INT) AS v FROM documents),
    px AS (SELECT doc_id, unnest(range(height * 64)) AS i, unnest(list_resize(v, height * 64, 255)) AS v FROM bytes)"""
#: The level that parts a page's histogram with most variance between, the first on ties; up to it is ink.
LEVELS = f"""{RASTER}, hist AS (SELECT doc_id, v, count(*) AS n FROM px GROUP BY ALL), up AS (SELECT doc_id, v, sum(n) OVER w AS n0, sum(n * v) OVER w AS s0, sum(n) OVER (PARTITION BY doc_id) AS n, sum(n * v) OVER (PARTITION BY doc_id) AS s FROM hist WINDOW w AS (PARTITION BY doc_id ORDER BY v)),
    between AS (SELECT doc_id, v, CASE WHEN n0 < n THEN n0::DOUBLE * (n - n0) * power(s0 / n0 - (s - s0) / (n - n0), 2) ELSE 0 END AS b FROM up),
    best AS (SELECT doc_id, CASE WHEN max(b) = 0 THEN 0 ELSE arg_max(v, (round(b, 3), -v)) END AS level FROM between GROUP BY doc_id),
    inked AS (SELECT px.doc_id, i // 64 AS y, i % 64 AS x FROM px JOIN best USING (doc_id) WHERE v <= level)"""


@query(
    f"""WITH {LEVELS}, p AS (SELECT doc_id, y, count(*) AS n FROM inked GROUP BY ALL), t AS (SELECT doc_id, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2, count(*) AS ink FROM inked GROUP BY doc_id)
    SELECT b.doc_id::VARCHAR AS page_id, coalesce(ink, 0) AS ink, coalesce(x1, 0)::INT AS x1, coalesce(y1, 0)::INT AS y1, coalesce(x2, 64)::INT AS x2, coalesce(y2, height)::INT AS y2, (SELECT count(*) FROM p WHERE p.doc_id = b.doc_id) AS inked_rows,
    coalesce((SELECT max(n) FROM p WHERE p.doc_id = b.doc_id), 0) AS most FROM bytes b LEFT JOIN t ON t.doc_id = b.doc_id"""
)
def page_ink(spark, sf):
    def one(row):
        binary = pixels.otsu(pixels._page(row))
        yield row.page_id, binary.shape[0], binary.shape[1], 1, binary.tobytes()

    binary = pixels._mapped(C.raster_pages(spark, sf), "page_id string, height int, width int, channels int, pixels binary", one)
    whole = binary.select("page_id", F.lit(0).alias("seq"), F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.col("width").alias("x2"), F.col("height").alias("y2"))
    rows = pixels.ink_profile(binary).groupBy("page_id").agg(F.sum("ink").cast("long").alias("ink"), F.count_if(F.col("ink") > 0).alias("inked_rows"), F.max("ink").cast("long").alias("most"))
    return pixels.tightened_rows(binary, whole).drop("seq").join(rows, "page_id").select("page_id", "ink", "x1", "y1", "x2", "y2", "inked_rows", "most")


def _inked(spark, sf, schema, one):
    """one(page_id, ink mask) of each raster page."""

    def run(row):
        yield row.page_id, *one(pixels.otsu(pixels._page(row)) == pixels.INK)

    return pixels._mapped(C.raster_pages(spark, sf), schema, run)


@query(
    f"""WITH {LEVELS}, grid AS (SELECT px.doc_id, i // 64 AS y, i % 64 AS x, v <= level AS ink FROM px JOIN best USING (doc_id)),
    near AS (SELECT *, y - max(CASE WHEN NOT ink THEN y END) OVER (PARTITION BY doc_id, x ORDER BY y) AS up, min(CASE WHEN NOT ink THEN y END) OVER (PARTITION BY doc_id, x ORDER BY y DESC) - y AS down FROM grid),
    g AS (SELECT doc_id, y, x, ink, CASE WHEN ink THEN least(coalesce(up, down), coalesce(down, up)) ELSE 0 END AS g FROM near),
    d AS (SELECT a.doc_id, a.y, a.x, min(b.g * b.g + (a.x - b.x) * (a.x - b.x)) AS d FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.y = b.y AND b.g IS NOT NULL WHERE a.ink GROUP BY ALL)
    SELECT p.doc_id::VARCHAR AS page_id, count(d) AS ink, coalesce(max(d), 0)::BIGINT AS deepest, coalesce(sum(d), 0)::BIGINT AS squares FROM bytes p LEFT JOIN d ON p.doc_id = d.doc_id GROUP BY p.doc_id"""
)
def ink_depths(spark, sf):
    """How deep each page's ink is: pixels with paper on their page, the largest squared distance to it, and the sum of all."""

    def one(ink):
        d = pixels.squared_distances(ink)[ink]
        d = d[np.isfinite(d)]
        return len(d), int(d.max(initial=0)), int(d.sum())

    return _inked(spark, sf, "page_id string, ink long, deepest long, squares long", one)


@query()
def stroke_skeletons(spark, sf):
    """Pixels of each page's middle lines, and its parts before and after thinning."""

    def one(ink):
        lines = pixels.thinned(ink)
        return int(ink.sum()), int(lines.sum()), len(pixels.components(ink)[1]), len(pixels.components(lines)[1])

    return _inked(spark, sf, "page_id string, ink long, skeleton long, parts int, skeleton_parts int", one)


@query(
    f"""WITH {LEVELS}, s AS (SELECT *, lag(x) OVER w = x - 1 AS before, lead(x) OVER w = x + 1 AS after FROM inked WINDOW w AS (PARTITION BY doc_id, y ORDER BY x)),
    k AS (SELECT doc_id, count(*) AS ink, count(*) FILTER (x = 0 OR coalesce(before, false) OR (x < 63 AND coalesce(after, false))) AS kept FROM s GROUP BY doc_id)
    SELECT b.doc_id::VARCHAR AS page_id, coalesce(ink, 0) AS ink, coalesce(kept, 0) AS reconnected FROM bytes b LEFT JOIN k ON k.doc_id = b.doc_id"""
)
def reconnected_ink(spark, sf):
    """Ink before and after the least closing of the light parts."""

    def one(ink):
        return int(ink.sum()), int((pixels.reconnected(np.where(ink, pixels.INK, pixels.PAPER).astype(np.uint8)) == pixels.INK).sum())

    return _inked(spark, sf, "page_id string, ink long, reconnected long", one)
