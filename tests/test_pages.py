import math
"""Profiles, boxes, datasets, pixels, sources and streams on small fixtures."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linework import scoring, sources, streaming
from linework.operators import boxes as B
from linework.operators import datasets as S
from linework.operators import pixels
from linework.operators import signal as P


def profile(spark, pages):
    return spark.createDataFrame([(p, y, int(v)) for p, values in pages.items() for y, v in enumerate(values)], "page_id string, y int, ink long").repartition(3)


def gaussian(values, window=11):
    k = np.exp(-0.5 * (np.arange(window) - window // 2) ** 2 / (window / 4) ** 2)
    return np.convolve(values, k / k.sum(), mode="same") if window >= 3 else np.asarray(values, float)


def cuts_of(values):
    s = gaussian(np.asarray(values, float))
    if s.max() == 0:
        return []
    out, start = [], None
    for i, v in enumerate(s):
        if start is None and v < s.max() * 0.35:
            start = i
        elif start is not None and v >= s.max() * 0.35:
            out.append((start + i) // 2)
            start = None
    return out


def random_pages():
    rng = np.random.default_rng(2)
    pages = {"bar": [200 if 30 <= y < 70 else 0 for y in range(100)], "none": [0] * 40}
    for k in range(8):
        pages[f"r{k}"] = np.repeat(rng.integers(0, 60, 25) * rng.integers(0, 2, 25), rng.integers(3, 9, 25)).tolist()
    return pages


@pytest.mark.parametrize("window", [1, 4, 11])
def test_smoothing(spark, window):
    pages = random_pages()
    rows = P.smooth(profile(spark, pages), window).collect()
    for p, values in pages.items():
        mine = [r["smooth"] for r in sorted((r for r in rows if r["page_id"] == p), key=lambda r: r["y"])]
        assert np.allclose(mine, gaussian(np.asarray(values, float), window))


def test_cuts_seams_and_boxes(spark):
    pages = random_pages()
    df = profile(spark, pages)
    cuts = P.valley_cuts(df)
    found = {}
    for r in cuts.collect():
        found.setdefault(r["page_id"], []).append(r["cut"])
    sizes = spark.createDataFrame([(p, 400, len(v)) for p, v in pages.items()], "page_id string, width int, height int")
    seams, boxes = {}, {}
    for r in P.refined_cuts(df, cuts).collect():
        seams.setdefault(r["page_id"], []).append(r["cut"])
    for r in P.profile_boxes(df, sizes).collect():
        boxes.setdefault(r["page_id"], []).append((r["y1"], r["y2"]))
    for p, values in pages.items():
        want = cuts_of(values)
        assert sorted(found.get(p, [])) == want
        moved = sorted({max(0, c - 3) + int(np.argmin(values[max(0, c - 3) : c + 4])) for c in want})
        assert sorted(seams.get(p, [])) == moved
        edges = [0, *moved, len(values)]
        bands = [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b - a >= 8 and sum(values[a:b]) >= 3]
        assert sorted(boxes.get(p, [])) == bands


def test_runs_and_checks(spark):
    pages = {"a": [0, 9, 9, 0, 9, 0, 0, 9], "b": [0, 0]}
    assert {r["page_id"]: r["runs"] for r in P.run_count(profile(spark, pages)).collect()} == {"a": 3, "b": 0}
    bars = {"p": [50 if y % 40 < 10 else 0 for y in range(200)]}
    boxes = spark.createDataFrame([("p", 0, 0, 0, 9, 10), ("p", 1, 0, 20, 9, 30), ("p", 2, 0, 40, 9, 70)], "page_id string, seq int, x1 int, y1 int, x2 int, y2 int")
    check, tall = P.verify_segmentation(profile(spark, bars), boxes)
    assert check.first()["peak_estimate"] == 5 and check.first()["too_few"] and [r["seq"] for r in tall.collect()] == [2]
    runs = P.run_boxes(profile(spark, bars).withColumn("height", F.lit(200)))
    assert runs.count() == 5 and runs.agg(F.max("y2")).first()[0] <= 200


def test_otsu_forms_agree(spark):
    rng = np.random.default_rng(4)
    gray = np.clip(np.concatenate([rng.normal(60, 12, 900), rng.normal(190, 20, 700)]), 0, 255).astype(np.uint8).reshape(40, 40)
    levels = spark.createDataFrame([("g", int(v), int(n)) for v, n in enumerate(np.bincount(gray.ravel(), minlength=256)) if n], "g string, level int, n long")
    threshold = P.otsu(levels, "g").first()["threshold"]
    assert (np.where(gray > threshold, 255, 0) == pixels.otsu(gray)).all()


def merge(boxes):
    out = []
    for x1, y1, x2, y2 in boxes:
        if out:
            a = out[-1]
            low = min(y2 - y1, a[3] - a[1])
            if low > 0 and (min(y2, a[3]) - max(y1, a[1])) / low > 0.3:
                out[-1] = (min(a[0], x1), min(a[1], y1), max(a[2], x2), max(a[3], y2))
                continue
        out.append((x1, y1, x2, y2))
    return out


def group(words, ratio):
    heights = sorted(w[4] - w[2] for w in words)
    high = max(1.0, float(heights[len(heights) // 2]))
    groups = []
    for w in sorted(words, key=lambda w: ((w[2] + w[4]) / 2, w[0])):
        mid = (w[2] + w[4]) / 2
        for g in groups:
            if abs(mid - (g[0] + g[1]) / 2) < high * ratio:
                g[0], g[1] = min(g[0], w[2]), max(g[1], w[4])
                g[2].append(w)
                break
        else:
            groups.append([w[2], w[4], [w]])
    groups = sorted(groups, key=lambda g: g[0])
    return [[w[0] for w in sorted(g[2], key=lambda w: w[1])] for g in groups]


def test_merging_and_grouping(spark):
    rng = random.Random(7)
    pages = {"label": [(153, 15, 284, 51), (124, 67, 311, 109), (22, 96, 419, 356), (152, 353, 431, 433)]}
    for k in range(25):
        pages[f"p{k}"] = [(x, y, x + rng.randrange(8, 60), y + rng.randrange(1, 40)) for x, y in ((rng.randrange(300), rng.randrange(150)) for _ in range(rng.randrange(1, 14)))]
    rows = [(p, i, *b) for p, boxes in pages.items() for i, b in enumerate(boxes)]
    df = spark.createDataFrame(rows, "page_id string, seq int, x1 int, y1 int, x2 int, y2 int").repartition(5)
    found = {}
    for r in B.merged(df).orderBy("page_id", "seq").collect():
        found.setdefault(r["page_id"], []).append((r["x1"], r["y1"], r["x2"], r["y2"]))
    assert found == {p: merge([b for _, b in sorted(enumerate(v), key=lambda e: (e[1][1], e[0]))]) for p, v in pages.items()}
    assert len(found["label"]) == 3
    for ratio, least in ((0.4, 1), (0.6, 2)):
        lines = {}
        for r in B.grouped_lines(df.withColumnRenamed("seq", "idx"), ratio, least).orderBy("page_id", "line_index", "word_order").collect():
            lines.setdefault((r["page_id"], r["line_index"]), []).append(r["idx"])
        want = {(p, i): g for p, v in pages.items() for i, g in enumerate(group([(k, *b) for k, b in enumerate(v)], ratio)) if len(g) >= least}
        assert lines == want
    strips = B.strip_offsets(B.grouped_lines(df.withColumnRenamed("seq", "idx")))
    assert strips.where("strip_x < 0 or strip_y < 0").count() == 0


def test_geometry(spark):
    df = spark.createDataFrame([("p", 0, 10, 10, 20, 20), ("p", 1, 0, 90, 5, 93)], "page_id string, seq int, x1 int, y1 int, x2 int, y2 int")
    assert [tuple(r) for r in B.padded(df, F.lit(100), F.lit(95)).orderBy("seq").collect()] == [("p", 0, 6, 6, 24, 24), ("p", 1, 0, 86, 9, 95)]
    flat = B.rotated(df, F.lit(100), F.lit(100), F.lit(0.0), F.lit(True)).orderBy("seq").first()
    assert (flat["x1"], flat["x2"]) == (80, 90)
    top = B.gaussian_map(df.where("seq = 0")).orderBy(F.desc("value")).first()
    assert (top["x"], top["y"]) == (15, 15) and top["value"] == 1.0
    lines = spark.createDataFrame([("p", 0, 0, 0, 100, 20), ("p", 1, 0, 40, 100, 60)], df.schema)
    parts = spark.createDataFrame([("p", 1, 20, 18, 6, 10, 50, 23.0, 23.0), ("p", 2, 20, 30, 6, 10, 50, 23.0, 30.0), ("p", 3, 0, 70, 90, 10, 50, 45.0, 75.0)], "page_id string, label int, x int, y int, w int, h int, area long, cx double, cy double")
    pages = spark.createDataFrame([("p", 100, 100)], "page_id string, width int, height int")
    grown = {r["seq"]: (r["y1"], r["y2"]) for r in B.bleeding_components(lines, parts, pages).collect()}
    assert grown == {0: (0, 40), 1: (40, 60)}


def test_hulls_are_those_of_turned_corners(spark):
    """Boxes with a corner in the page's middle, which every turn leaves where it is."""
    corners = [(500, 500 + w, 700, 700 + h) for w in range(41, 91, 7) for h in range(10, 70, 7)] + [(500 - w, 500, 700 - h, 700) for w in range(41, 91, 7) for h in range(10, 70, 7)]
    df = spark.createDataFrame([("p", i, x1, y1, x2, y2, float(a)) for i, (x1, x2, y1, y2) in enumerate(corners) for a in range(-3, 4)], "page_id string, seq int, x1 int, y1 int, x2 int, y2 int, angle double").repartition(2)

    def want(x1, y1, x2, y2, angle):
        c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        xs = [c * (x - 500.0) + s * (y - 700.0) + 500.0 for x in (x1, x2) for y in (y1, y2)]
        ys = [c * (y - 700.0) - s * (x - 500.0) + 700.0 for x in (x1, x2) for y in (y1, y2)]
        return int(min(xs)), int(min(ys)), int(max(xs)), int(max(ys))

    found = {(r["seq"], r["angle"]): (r["x1"], r["y1"], r["x2"], r["y2"]) for r in B.rotated(df, F.lit(1000), F.lit(1400), "angle", F.lit(False)).collect()}
    assert found == {(r["seq"], r["angle"]): want(r["x1"], r["y1"], r["x2"], r["y2"], r["angle"]) for r in df.collect()}


def test_datasets(spark):
    images = spark.createDataFrame([("/i/a.jpg",), ("/i/b.png",), ("/i/c.d.png",)], "path string").withColumn("stem", S.stem(F.col("path")))
    assert [r["stem"] for r in images.orderBy("path").collect()] == ["a", "b", "c.d"]
    labels = spark.createDataFrame([("a", "text")], "stem string, text string")
    assert {r["stem"]: r["text"] for r in S.labelled(images, labels).collect()} == {"a": "text", "b": "", "c.d": ""}
    masks = spark.createDataFrame([("a", "bmp", "m1"), ("a", "jpg", "m2"), ("b", "tiff", "m3")], "stem string, ext string, mask string")
    assert [(r["stem"], r["mask"]) for r in S.masked_pairs(images, masks).collect()] == [("a", "m2")]
    for n in (1, 7, 100, 1001):
        split = S.exact_split(spark.range(n), "id", 0.15)
        assert split.where("split = 'val'").count() == max(1, int(n * 0.15)) and split.count() == n
        assert {tuple(r) for r in split.collect()} == {tuple(r) for r in S.exact_split(spark.range(n).repartition(7), "id", 0.15).collect()}
    assert S.exact_split(spark.range(0), "id", 0.15).count() == 0
    assert S.oversampled(spark.range(4), F.col("id") == 2).count() == 6
    with pytest.raises(ValueError):
        S.combined()
    rows = spark.createDataFrame([(0, [5, 6]), (1, [7]), (2, [8, 9, 9])], "k int, ids array<int>")
    padded = {r["k"]: (r["ids"], r["mask"]) for r in S.batches(rows, "ids", "k", 2).collect()}
    assert padded == {0: ([5, 6], [False, False]), 1: ([7, 0], [False, True]), 2: ([8, 9, 9], [False] * 3)}
    fan = S.augmented(images.select("path"), 2)
    assert sorted(r["aug_index"] for r in fan.collect()) == list(range(6))


def flood(mask):
    seen, out = np.zeros(mask.shape, bool), []
    for y, x in np.argwhere(mask):
        if not seen[y, x]:
            stack, n = [(y, x)], 0
            seen[y, x] = True
            while stack:
                a, b = stack.pop()
                n += 1
                for c in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                    for d in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                        if mask[c, d] and not seen[c, d]:
                            seen[c, d] = True
                            stack.append((c, d))
            out.append(n)
    return sorted(out)


def test_components_equal_flood_fill():
    rng = np.random.default_rng(6)
    for share in (0.05, 0.3, 0.5, 0.9):
        mask = rng.random((30, 41)) < share
        labels, stats = pixels.components(mask)
        assert sorted(stats[:, 4].astype(int).tolist()) == flood(mask)
        assert ((labels > 0) == mask).all()


def test_pixel_operators():
    page = np.full((100, 300), 255, np.uint8)
    page[30:70, 50:250] = 0
    assert pixels.tightened(page, (0, 0, 300, 100)) == (50, 30, 250, 70)
    assert (pixels.sauvola(page) == 0).sum() > 0 and pixels.binary_score(np.full((9, 9), 255, np.uint8)) == -1000.0
    rng = np.random.default_rng(1)
    noisy = rng.random((40, 60)) < 0.3
    for w, h in ((3, 1), (5, 3)):
        grown = np.array([[noisy[max(0, y - h // 2) : y + h // 2 + 1, max(0, x - w // 2) : x + w // 2 + 1].any() for x in range(60)] for y in range(40)])
        assert (pixels.dilate(noisy, w, h) == grown).all()
    assert (pixels.opened(noisy, 3, 3) <= noisy).all() and (pixels.close(noisy, 3, 3) >= noisy).all()
    shadow = np.full((100, 100), 255, np.uint8)
    shadow[:5] = shadow[-4:] = 0
    shadow[50, 40:60] = 0
    clean = pixels.cleared_edges(shadow)
    assert (clean[:5] == 255).all() and (clean[-4:] == 255).all() and (clean[50, 40:60] == 0).all()
    ruled = np.full((120, 200), 255, np.uint8)
    ruled[60] = 0
    ruled[20:40, 30:34] = 0
    out = pixels.without_rulings(ruled)
    assert (out[60] == 255).all() and (out[20:40, 30:34] == 0).all()
    tilted = pixels.rotate(np.where(np.pad(np.zeros((20, 160)), 70, constant_values=1) > 0, 255, 0).astype(np.uint8), 6.0)
    assert abs(abs(pixels.skew(tilted)) - 6) < 1.0
    assert max(pixels.resized(np.full((3000, 4000, 3), 200, np.uint8)).shape) <= 2048
    assert pixels.mask_boxes(np.pad(np.ones((20, 80)), 30).astype(float), 80, 140)[0] == (30, 30, 110, 50)
    crop = pixels.polygon_crop(np.zeros((20, 20), np.uint8), np.array([[2, 2], [17, 2], [17, 17], [2, 17]]), (0, 0, 20, 20))
    assert crop[10, 10] == 0 and crop[0, 0] == 255
    assert pixels.model_input(page).shape == (128, 1024)
    grid = np.full((200, 260), 235, np.uint8)
    grid[::12] = grid[:, ::12] = 190
    for k in range(5):
        grid[90:112, 30 + 40 * k : 42 + 40 * k] = 30
    binary, method, _, stages, _ = pixels.prepared_without_grid(grid)
    assert method in pixels.METHODS and "grid" in stages and set(np.unique(binary)) <= {0, 255}


def test_page_flow(spark, tmp_path):
    page = np.full((64, 96), 230, np.uint8)
    for k in range(6):
        page[20:32, 10 + 12 * k : 15 + 12 * k] = 20
    (tmp_path / "a.pgm").write_bytes(b"P5\n# note\n96 64\n255\n" + page.tobytes())
    (tmp_path / "b.pgm").write_bytes(b"P5\n4 4\n255\n" + bytes(16))
    (tmp_path / "c.pgm").write_bytes(b"broken")
    (tmp_path / "d.txt").write_bytes(b"no page")
    files = sources.image_files(spark, str(tmp_path), ("pgm",))
    pages = sources.decode_pages(files)
    assert pages.count() == 3 and sources.valid_pages(pages).count() == 1
    with pytest.raises(Exception, match="unreadable or small page"):
        sources.valid_pages(pages, strict=True).select("pixels").collect()
    ready = pixels.preprocess(sources.valid_pages(pages))
    row = ready.first()
    assert row["method"] in pixels.METHODS and set(row["scores"]) == set(pixels.METHODS)
    ink = pixels.ink_profile(ready)
    assert ink.where("ink > 0").count() > 0 and pixels.component_rows(ready).count() >= 1
    stream = streaming.ingest(streaming.page_stream(spark, str(tmp_path)), f"{tmp_path}/out", f"{tmp_path}/state")
    stream.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_text_sources(spark, tmp_path):
    (tmp_path / "truth.txt").write_text("\n one\ntwo \r\nthree\n\n")
    assert [r["text"] for r in sources.ground_truth(spark, f"{tmp_path}/truth.txt").orderBy("line_no").collect()] == ["one", "two ", "three"]
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels/images (4)_aug000.txt").write_text("153,15,284,51\na,b\n\n124.9,67,311,109\n1,2,3\n")
    rows = sources.box_labels(spark, f"{tmp_path}/labels").orderBy("seq").collect()
    assert [(r["page_id"], r["x1"], r["y2"]) for r in rows] == [("images (4)_aug000", 153, 51), ("images (4)_aug000", 124.9, 109)]
    (tmp_path / "v.json").write_text('{"<pad>": 0, "a": 4}')
    assert {r["char"]: r["id"] for r in sources.vocabulary(spark, f"{tmp_path}/v.json").collect()} == {"<pad>": 0, "a": 4}


def test_scorers(spark):
    class Fake:
        schema = "page_id string, n long"

        def load(self):
            return 2

        def predict(self, model, rows):
            rows["n"] = rows["page_id"].str.len() * model
            return rows[["page_id", "n"]]

    pages = spark.createDataFrame([("ab",), ("c",)], "page_id string")
    assert {r["page_id"]: r["n"] for r in scoring.scored(pages, Fake()).collect()} == {"ab": 4, "c": 2}
    both = scoring.with_fallback(scoring.scored(pages.where("page_id = 'c'"), Fake()), lambda rest: rest.select("page_id", F.lit(0).cast("long").alias("n")), pages, "page_id")
    assert {r["page_id"]: r["n"] for r in both.collect()} == {"ab": 0, "c": 2}
    class Halves:
        schema = "page_id string, seq int, x1 int, y1 int, x2 int, y2 int"

        def load(self):
            return None

        def predict(self, model, rows):
            rows["x2"] = (rows["x1"] + rows["x2"]) // 2
            return rows[["page_id", "seq", "x1", "y1", "x2", "y2"]]

    regions = spark.createDataFrame([("p", 0, 0, 0, 100, 50, 50, 100), ("p", 1, 0, 0, 100, 20, 20, 100)], "page_id string, seq int, x1 int, y1 int, x2 int, y2 int, height int, width int")
    assert {r["seq"]: r["x2"] for r in scoring.scored_regions(regions, Halves()).collect()} == {0: 50, 1: 100}
    first = spark.createDataFrame([(1, "x", 0.5), (2, "y", 0.9)], "k int, raw_text string, confidence double")
    second = spark.createDataFrame([(1, "better", 0.8), (2, "other", 0.95)], first.schema)
    assert {r["k"]: r["raw_text"] for r in scoring.routed(first, second, 0.6, "k").collect()} == {1: "better", 2: "y"}


def test_pages_to_documents(spark, tmp_path):
    from linework.plans import pages as flow

    rng = np.random.default_rng(3)
    page = np.full((900, 1000), 235, np.uint8)
    for line in range(4):
        for word in range(6):
            x, y = 80 + 140 * word, 120 + 170 * line
            block = rng.random((36, 90)) < 0.55
            page[y : y + 36, x : x + 90][block] = 25
    (tmp_path / "a.pgm").write_bytes(b"P5\n1000 900\n255\n" + page.tobytes())
    (tmp_path / "blank.pgm").write_bytes(b"P5\n1000 900\n255\n" + np.full((900, 1000), 240, np.uint8).tobytes())
    (tmp_path / "bad.pgm").write_bytes(b"no")
    for hierarchical in (False, True):
        docs, lines = flow.run_folder(spark, str(tmp_path), flow.InkScorer(), hierarchical=hierarchical)
        found = {r["doc_id"].rsplit("/", 1)[-1]: r for r in docs.collect()}
        assert set(found) == {"a.pgm", "blank.pgm", "bad.pgm"}
        assert found["a.pgm"]["lines"] == 4 and found["bad.pgm"]["lines"] == 0 and found["blank.pgm"]["full_text"] == ""
        assert lines.where("word_confidences is null").count() == 0


def test_sweeps_of_a_page_of_many_boxes(spark):
    """A hundred thousand boxes in one page, against plain loops; ties, boxes without a coordinate and pages without a name."""
    import time

    rng = np.random.default_rng(11)
    n = 100_000
    y, h = rng.integers(0, 900_000, n), rng.integers(1, 40, n)
    x, w = rng.integers(0, 3000, n), rng.integers(1, 200, n)
    frame = pd.DataFrame({"page_id": 1, "seq": np.arange(n), "x1": x, "y1": y, "x2": x + w, "y2": y + h}).astype("int32")
    df = spark.createDataFrame(frame)
    df.count()
    began = time.time()
    found = [tuple(r)[2:] for r in B.merged(df).orderBy("seq").collect()]
    lines = B.grouped_lines(df.withColumnRenamed("seq", "idx"), 0.6).collect()
    assert time.time() - began < 60  # a fold that copies what it has would take hours
    want, groups, line = [], [], {}
    for _, _, *b in sorted(zip(y.tolist(), range(n), x.tolist(), y.tolist(), (x + w).tolist(), (y + h).tolist(), strict=True)):
        last = want[-1] if want else None
        low = min(b[3] - b[1], last[3] - last[1]) if last else 0
        if low > 0 and (min(b[3], last[3]) - max(b[1], last[1])) / low > B.D.merge_overlap:
            want[-1] = [min(last[0], b[0]), min(last[1], b[1]), max(last[2], b[2]), max(last[3], b[3])]
        else:
            want.append(b)
    assert found == [tuple(b) for b in want]
    limit = float(sorted(h.tolist())[n // 2]) * 0.6
    for mid, i in sorted(((y[i] + y[i] + h[i]) / 2, i) for i in range(n)):
        for k in range(max(0, len(groups) - 50), len(groups)):  # earlier lines lie far above
            if abs(mid - (groups[k][0] + groups[k][1]) / 2) < limit:
                break
        else:
            k = len(groups)
            groups.append([y[i], y[i] + h[i]])
        groups[k] = [min(groups[k][0], y[i]), max(groups[k][1], y[i] + h[i])]
        line[i] = k
    number = {k: j for j, k in enumerate(sorted(range(len(groups)), key=lambda k: (groups[k][0], k)))}
    assert {r["idx"]: r["line_index"] for r in lines} == {i: number[k] for i, k in line.items()}
    odd = spark.createDataFrame([(None, 1, 0, 0, 5, 5), (None, 2, 0, 1, 5, 6), ("p", 1, 0, None, 5, 5)], "page_id string, seq int, x1 int, y1 int, x2 int, y2 int")
    assert [tuple(r) for r in B.merged(odd).collect()] == [(None, 0, 0, 0, 5, 6)]
    assert [tuple(r)[:4] for r in B.grouped_lines(odd.withColumnRenamed("seq", "idx")).orderBy("idx").collect()] == [(None, 0, 0, 1), (None, 0, 1, 2)]
    assert B.grouped_lines(odd.where("false").withColumnRenamed("seq", "idx")).count() == 0


def test_medians_by_counts(spark):
    rows = spark.range(0, 200_000).selectExpr("id % 3 g", "if(id % 11 = 0, null, (id * 7919) % 10007) v")
    for r in B.upper_medians(rows, F.col("v"), "g").collect():
        values = sorted((i * 7919) % 10007 for i in range(200_000) if i % 3 == r["g"] and i % 11)
        assert r["median"] == values[len(values) // 2]
    assert B.upper_medians(spark.createDataFrame([(1, 0), (1, 0)], "g int, v int"), F.col("v"), "g").first()["median"] == 1.0


def test_regions_move_before_they_become_pixels(spark):
    """Pixels outnumber regions: no exchange lies between a region's pixels and their highest value."""
    df = spark.createDataFrame([("p", i, i, 0, i + 9, 9) for i in range(20)], "page_id string, seq int, x1 int, y1 int, x2 int, y2 int")
    for rows in (B.gaussian_map(df), scoring.highest(df.withColumn("scores", F.array(F.array(F.lit(0.5)))))):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate explode") < plan.index("Exchange hashpartitioning")
        assert rows.count() == 28 * 9


def test_components_of_a_large_page_are_joined_at_once():
    """Areas and labels as a plain flood fill has them, and a page of many runs in little time."""
    import time

    draw = np.random.default_rng(4)
    for _ in range(40):
        masks = [draw.random((draw.integers(1, 12), 9)) < draw.random() for _ in range(3)]
        for mask, areas in zip(masks, pixels.component_areas(masks), strict=True):
            labels, n = np.zeros(mask.shape, int), 0
            for y, x in zip(*np.nonzero(mask), strict=True):
                if labels[y, x]:
                    continue
                n, open_ = n + 1, [(y, x)]
                labels[y, x] = n
                while open_:
                    i, j = open_.pop()
                    for k, m in ((k, m) for k in range(i - 1, i + 2) for m in range(j - 1, j + 2)):
                        if 0 <= k < mask.shape[0] and 0 <= m < mask.shape[1] and mask[k, m] and not labels[k, m]:
                            labels[k, m] = n
                            open_.append((k, m))
            got, stats = pixels.components(mask)
            assert (got == labels).all() and stats[:, 4].tolist() == areas.tolist() == np.bincount(labels[mask], minlength=n + 1)[1:].tolist()
    page = draw.random((3000, 1000)) < 0.4
    began = time.process_time()
    got, stats = pixels.components(page)
    assert got.max() == len(stats) and stats[:, 4].sum() == page.sum() and time.process_time() - began < 1.5
