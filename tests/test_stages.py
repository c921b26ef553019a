"""Detection stages, routes, checkpoints, page variants and files: what plans are composed of."""

import math
import os

import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linework import filesink, scoring, sinks
from linework.operators import boxes as B
from linework.operators import datasets as S
from linework.operators import pixels
from linework.operators import signal as P
from linework.plans import pages as flow
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers have no copy of this module

PAGE = "page_id string, page_no int, height int, width int, channels int, pixels binary"


def page_of(lines=3, height=300, width=200):
    page = np.full((height, width), 255, np.uint8)
    for k in range(lines):
        page[40 + 80 * k : 60 + 80 * k, 20:180][np.random.default_rng(k).random((20, 160)) < 0.6] = 0
    return page


def table(spark, *pages):
    return spark.createDataFrame([(f"p{k}", 0, *p.shape, 1, p.tobytes()) for k, p in enumerate(pages)], PAGE)


class Boxes:
    """Boxes by page or region, as a detector gives them."""

    schema = "page_id string, seq int, x1 int, y1 int, x2 int, y2 int"

    def __init__(self, of):
        self.of = of

    def load(self):
        return None

    def predict(self, model, rows: pd.DataFrame) -> pd.DataFrame:
        out = [(r.page_id, k, *b) for r in rows.itertuples() for k, b in enumerate(self.of(r))]
        return pd.DataFrame(out, columns=["page_id", "seq", "x1", "y1", "x2", "y2"])


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_detectors_work_in_order_and_fall_back(spark):
    pages = table(spark, page_of(), page_of(1), np.full((300, 200), 255, np.uint8))
    first = Boxes(lambda r: [(0, 0, 200, 150), (0, 150, 200, 170)] if r.page_id == "p0" else [])
    second = Boxes(lambda r: [(r.x1 + 10, r.y1 + 30, r.x2 - 10, r.y2 - 5)] if r.page_id == "p0" else [])
    box = ("page_id", "x1", "y1", "x2", "y2")
    assert rows_of(flow.candidate_regions(pages, first), *box) == [("p0", 0, 0, 200, 150), ("p0", 0, 150, 200, 170), ("p1", 0, 0, 200, 300), ("p2", 0, 0, 200, 300)]
    # The region of 20 rows is too small for the second one, and pages without its boxes keep their regions.
    assert rows_of(flow.candidate_regions(pages, first, second), *box) == [("p0", 0, 150, 200, 170), ("p0", 10, 30, 190, 145), ("p1", 0, 0, 200, 300), ("p2", 0, 0, 200, 300)]
    crops, checks, stages = flow.detected(pages, None, first, second)
    assert {r["page_id"]: r["warning"] is None for r in checks.collect()}.keys() == {"p0", "p1", "p2"}
    assert {r["stage"] for r in stages.collect()} == {"regions", "lines"}
    assert crops.where("difficulty_tag not in ('clean', 'hard')").count() == 0
    plain = flow.detect_lines(pages)
    assert plain.where("page_id = 'p0'").count() == 3 and plain.where("page_id = 'p1'").count() == 1
    assert all(r["height"] <= 40 for r in plain.where("page_id = 'p0'").withColumn("height", F.col("y2") - F.col("y1")).collect())


def test_segmentation_without_lines_has_no_peaks(spark):
    profile = spark.createDataFrame([("a", y, 9 if y % 20 < 6 else 0, 100) for y in range(100)] + [("b", y, 9 if y % 20 < 6 else 0, 100) for y in range(100)], "page_id string, y int, ink int, height int")
    boxes = spark.createDataFrame([("a", 0, 0, 0, 9, 10), ("a", 1, 0, 20, 9, 60)], "page_id string, seq int, x1 int, y1 int, x2 int, y2 int")
    found = {r["page_id"]: r for r in P.verify_segmentation(profile, boxes)[0].collect()}
    assert found["a"]["peak_estimate"] == 5 and found["a"]["too_few"]
    assert found["a"]["warning"] == "Line segmentation warning: detected 2 but projection suggests ~5"
    assert (found["b"]["peak_estimate"], found["b"]["detected_count"], found["b"]["too_few"], found["b"]["warning"]) == (0, 0, False, "No lines detected.")


class PageReader:
    schema = "page_id string, seq int, raw_text string, confidence double"

    def load(self):
        return None

    def predict(self, model, rows):
        out = [(r.page_id, k, f"whole {k}", 0.9 if r.page_id == "p0" else 0.2) for r in rows.itertuples() for k in range(2)]
        return pd.DataFrame(out, columns=["page_id", "seq", "raw_text", "confidence"])


@pytest.fixture
def prepared(monkeypatch):
    """Pages that are binary already, so that tests of what follows need no pixel chain."""
    monkeypatch.setattr(flow.pixels, "preprocess", lambda pages, strokes=False, grid=False: pages)


def test_unsure_pages_are_read_by_lines(spark, prepared):
    pages = table(spark, page_of(), page_of(1))
    docs, lines = flow.run_full_page(pages, PageReader(), flow.InkScorer())
    lines = lines.persist()
    found = {r["doc_id"]: r["route"] for r in lines.collect()}
    assert found["p0"] == "page" and found["p1"] == "lines" and docs.count() == 2
    assert {r["corrected_text"] for r in lines.where("doc_id = 'p0'").collect()} == {"whole 0", "whole 1"}


def test_a_missing_checkpoint_raises(spark, tmp_path):
    path = f"{tmp_path}/model.bin"
    with pytest.raises(scoring.MissingCheckpoint):
        scoring.checkpoint(path)
    crops = spark.createDataFrame([("p", b"\x01\x02"), ("q", b"\x02")], "page_id string, pixels binary")

    def step(_):
        def scores(state, ids):
            p = np.full(8, 0.01)
            p[5 if len(ids) <= len(state) else 2] = 0.9
            return p

        return scores

    with pytest.raises(scoring.MissingCheckpoint):
        flow.predict(crops, path, step)
    with open(path, "wb") as f:
        f.write(b"x")
    for width in (1, 3):
        assert {r["page_id"]: r["ids"] for r in flow.predict(crops, path, step, width).collect()} == {"p": [5, 5], "q": [5]}


class Masks:
    schema = "page_id string, height int, width int, scores binary"

    def load(self):
        return None

    def predict(self, model, rows):
        mask = np.zeros((150, 100))
        mask[20:40, 10:90] = 0.9
        return pd.DataFrame([(r.page_id, 150, 100, mask.tobytes()) for r in rows.itertuples()], columns=["page_id", "height", "width", "scores"])


def test_masks_of_pages_give_boxes(spark):
    found = flow.page_masks(table(spark, page_of()), Masks()).collect()
    assert len(found) == 1 and found[0]["y1"] in range(36, 45) and found[0]["y2"] in range(76, 85)


def test_stages_are_kept_for_looking(spark, prepared, tmp_path):
    pages = table(spark, page_of())
    flow.run(pages, flow.InkScorer(), debug=f"{tmp_path}/debug")
    assert set(os.listdir(f"{tmp_path}/debug")) == {"original", "binary", "boxes", "segmentation", "crops", "lines"}
    sinks.save_stages({"x": pages}, None)


def test_label_numbers_are_scaled_before_they_are_cut(spark, tmp_path):
    from linework import sources

    os.makedirs(f"{tmp_path}/labels")
    with open(f"{tmp_path}/labels/a.txt", "w") as f:
        f.write("11.9,4,30.2,20\n")
    r = B.scaled(sources.box_labels(spark, f"{tmp_path}/labels"), 0.9, 1.0).first()
    assert (r["x1"], r["y1"], r["x2"], r["y2"]) == (int(11.9 * 0.9) // 2, 2, int(30.2 * 0.9) // 2, 10)


def test_datasets_that_are_missing(spark, tmp_path):
    one = spark.range(3)
    assert S.combined(one, optional=(lambda: spark.read.parquet(f"{tmp_path}/none"),)).count() == 3
    with pytest.raises(ValueError, match="no dataset"):
        S.combined(optional=(lambda: spark.read.parquet(f"{tmp_path}/none"),))
    with pytest.raises(FileNotFoundError):
        S.required(one.limit(0))
    assert S.required(one) is one


def test_numbers_run_over_ranges(spark):
    names = [f"x{i * 37 % 1000:04d}" for i in range(1000)]
    rows = S.numbered(spark.createDataFrame([(n,) for n in names], "path string").repartition(7), "path").collect()
    assert {r["path"]: r["_place"] for r in rows} == {n: i for i, n in enumerate(sorted(names))}


def test_files_are_written_whole(tmp_path):
    path = f"{tmp_path}/out/a.pdf"
    assert filesink.save_file(b"one", path) == path and open(path, "rb").read() == b"one"

    class Refusing:
        def move(self, a, b):
            if b == path:
                raise PermissionError(b)
            os.replace(a, b)

    new = f"{tmp_path}/out/new"
    open(new, "wb").write(b"two")
    other = filesink.moved(Refusing(), new, path)
    assert other != path and open(other, "rb").read() == b"two" and open(path, "rb").read() == b"one" and len(os.listdir(f"{tmp_path}/out")) == 2


def test_oriented_words_and_least_rectangles():
    t = math.radians(20)
    x, y = np.meshgrid(np.arange(-40, 41), np.arange(-8, 9))
    points = np.unique(np.rint(np.stack([x * math.cos(t) - y * math.sin(t), x * math.sin(t) + y * math.cos(t)], -1).reshape(-1, 2)).astype(int) + 100, axis=0)
    angle, corners = pixels.least_rectangle(points)
    assert abs(angle - 20) < 2
    sides = sorted(np.linalg.norm(np.roll(corners, -1, 0) - corners, axis=1))
    assert abs(sides[0] - 16) < 3 and abs(sides[3] - 80) < 3
    page = np.full((200, 200), 255, np.uint8)
    page[points[:, 1], points[:, 0]] = 0
    found = pixels.oriented_word_boxes(page)
    assert len(found) == 1 and abs(found[0][0] - 20) < 8


def test_lightness_and_copies():
    gray = np.arange(256, dtype=np.uint8).reshape(16, 16)
    light = pixels.lightness(gray)
    assert light[0, 0] == 0 and light[15, 15] == 255 and (np.diff(light.ravel().astype(int)) >= 0).all()
    colour = np.zeros((64, 64, 3), np.uint8)
    colour[:, 32:] = (30, 200, 60)
    assert pixels.lightness(colour)[0, 40] == 181  # of a green: L* 71
    assert pixels.equalised_light(colour).shape == (64, 64)
    one, again, other = pixels.jittered(colour, 5), pixels.jittered(colour, 5), pixels.jittered(colour, 6)
    assert (one == again).all() and (one != other).any() and pixels.copy_seed(2) == 281


def test_turned_crops_and_regions():
    page = page_of(1)
    square = np.array([[20, 40], [180, 40], [180, 60], [20, 60]])
    assert pixels.rotated_crop(page, square, 0.0).shape[0] in range(26, 31)
    scores = np.zeros((150, 100))
    scores[20:30, 10:90] = 0.9
    found = pixels.score_boxes(scores, 300, 200)
    assert len(found) == 1 and found[0][1] <= 40 and found[0][3] >= 60


def test_epochs_best(spark):
    log = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.4), (1, 3, 0.4), (2, 1, None), (2, 2, 0.9)], "run int, epoch int, loss double")
    assert rows_of(sinks.best_checkpoint(log, "loss", "run"), "run", "epoch") == [(1, 2), (2, 2)]
