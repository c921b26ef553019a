"""Distances by brute force; middle lines that keep parts and are thin; strokes of even width."""

import numpy as np
import pytest

from linework.operators import pixels


def blobs(seed):
    rng = np.random.default_rng(seed)
    page = rng.random((37, 53)) < (0.2 + 0.1 * (seed % 4))
    for _ in range(5):
        y, x = rng.integers(0, 30, 2)
        page[y : y + rng.integers(2, 12), x : x + rng.integers(2, 25)] = True
    return page


@pytest.mark.parametrize("seed", range(6))
def test_distances_by_brute_force(seed):
    mask = blobs(seed)
    paper = np.argwhere(~mask)
    found = pixels.squared_distances(mask)
    assert (found[~mask] == 0).all()
    for y, x in np.argwhere(mask):
        assert found[y, x] == ((paper - [y, x]) ** 2).sum(1).min()
    assert np.isinf(pixels.squared_distances(np.ones((4, 9), bool))).all() and pixels.squared_distances(np.zeros((3, 3), bool)).sum() == 0
    corner = np.ones((40, 60), bool)
    corner[39, 59] = False
    assert pixels.squared_distances(corner)[0, 0] == 39**2 + 59**2


@pytest.mark.parametrize("seed", range(8))
def test_thinning_keeps_parts_and_leaves_lines(seed):
    mask = pixels.close(blobs(seed), 3, 3) if seed % 2 else blobs(seed)
    lines = pixels.thinned(mask)
    labels, before = pixels.components(mask)
    after = pixels.components(lines)[1]
    assert not (lines & ~mask).any() and len(before) == len(after)
    assert set(np.unique(labels[lines])) == set(range(1, len(before) + 1))
    assert (pixels.thinned(lines) == lines).all()
    block = lines[:-2, :-2] & lines[:-2, 1:-1] & lines[:-2, 2:] & lines[1:-1, :-2] & lines[1:-1, 1:-1] & lines[1:-1, 2:] & lines[2:, :-2] & lines[2:, 1:-1] & lines[2:, 2:]
    assert not block.any()


def test_bars_thin_to_lines_and_get_one_width():
    page = np.zeros((60, 200), bool)
    page[10:13, 10:190] = page[30:43, 10:190] = True
    lines = pixels.thinned(page)
    assert lines.sum(0).max() <= 3 and (lines[:, 60:140].sum(0) == 2).all()
    even = pixels.even_strokes(np.where(page, pixels.INK, pixels.PAPER).astype(np.uint8)) == pixels.INK
    assert len(set(even[:25, 60:140].sum(0)) | set(even[25:, 60:140].sum(0))) == 1
    few = np.full((40, 40), pixels.PAPER, np.uint8)
    few[3, 3] = pixels.INK
    assert (pixels.even_strokes(few) == few).all() and pixels.thinned(np.zeros((0, 0), bool)).shape == (0, 0)
