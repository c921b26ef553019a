"""Page-local pixel operators in NumPy, and their DataFrame forms: one Arrow pass per page.

Binary pages have 0 for ink and 255 for background. Borders of filters mirror the page without its edge row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from linework.config import CONFIG
from linework.schemas import BINARY_PAGES, BOXES, COMPONENTS, PROFILE

C, D = CONFIG.preprocessing, CONFIG.detection
INK, PAPER = 0, 255


def grayscale(bgr: np.ndarray) -> np.ndarray:
    if bgr.ndim == 2 or bgr.shape[2] == 1:
        return bgr.reshape(bgr.shape[:2])
    b, g, r = (bgr[:, :, k].astype(np.float64) for k in range(3))
    return np.floor(0.114 * b + 0.587 * g + 0.299 * r + 0.5).astype(np.uint8)


def resize(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear when growing, area means when shrinking."""
    h, w = a.shape[:2]
    if (h, w) == (height, width):
        return a

    def weights(n: int, m: int) -> np.ndarray:
        out = np.zeros((m, n))
        if m < n:
            edges = np.linspace(0, n, m + 1)
            for i in range(m):
                lo, hi = edges[i], edges[i + 1]
                k = np.arange(int(lo), min(n, math.ceil(hi)))
                out[i, k] = np.minimum(k + 1, hi) - np.maximum(k, lo)
            return out / out.sum(1, keepdims=True)
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = np.floor(at).astype(int)
        hi = np.minimum(lo + 1, n - 1)
        np.add.at(out, (np.arange(m), lo), 1 - (at - lo))
        np.add.at(out, (np.arange(m), hi), at - lo)
        return out

    rows, cols = weights(h, height), weights(w, width)
    flat = a.astype(np.float64).reshape(h, w, -1)
    out = np.einsum("ih,hwc->iwc", rows, flat)
    out = np.einsum("jw,iwc->ijc", cols, out)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8).reshape((height, width) + a.shape[2:])


def resized(a: np.ndarray) -> np.ndarray:
    """A page brought to the working size."""
    h, w = a.shape[:2]
    longest, shortest = max(h, w), min(h, w)
    scale = 1.0
    if longest > C.max_side:
        scale = C.max_side / longest
    elif shortest < C.min_resize_side:
        grow = min(C.min_resize_side / shortest, C.max_side / longest)
        scale = grow if grow > C.grow_from else 1.0
    return a if scale == 1.0 else resize(a, int(w * scale), int(h * scale))


def equalised(gray: np.ndarray, clip: float = C.clahe_clip, tiles: int = C.clahe_tiles) -> np.ndarray:
    """Histogram equalisation by tiles with a clip limit, blended between tile middles."""
    h, w = gray.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    page = np.pad(gray, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric" if h > 1 and w > 1 else "edge")
    maps = np.empty((tiles, tiles, 256))
    limit = max(1, int(clip * th * tw / 256))
    for i in range(tiles):
        for j in range(tiles):
            n = np.bincount(page[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(n - limit, 0).sum())
            n = np.minimum(n, limit) + over // 256
            n[: over % 256] += 1
            maps[i, j] = np.cumsum(n) * 255.0 / (th * tw)
    y = np.clip((np.arange(h) + 0.5) / th - 0.5, 0, tiles - 1)
    x = np.clip((np.arange(w) + 0.5) / tw - 0.5, 0, tiles - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top = maps[y0[:, None], x0[None, :], gray] * (1 - fx) + maps[y0[:, None], x1[None, :], gray] * fx
    low = maps[y1[:, None], x0[None, :], gray] * (1 - fx) + maps[y1[:, None], x1[None, :], gray] * fx
    return np.clip(np.rint(top * (1 - fy) + low * fy), 0, 255).astype(np.uint8)


def contrast(gray: np.ndarray) -> np.ndarray:
    """Equalised only where contrast is low."""
    return gray if float(gray.std()) >= C.clahe_below_std else equalised(gray)


def _mirrored(n: int, r: int, reflect: bool) -> np.ndarray:
    """Places of n pixels with r more at both ends: mirrored without the edge, or the edge again."""
    at = np.arange(-r, n + r)
    return n - 1 - np.abs(n - 1 - np.abs(at)) if reflect else np.clip(at, 0, n - 1)


def convolve(a: np.ndarray, across: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Separable filter with mirrored borders."""
    out = a.astype(np.float64)
    for axis, k in ((1, across), (0, down)):
        r, n = len(k) // 2, out.shape[axis]
        p = out.take(_mirrored(n, r, n > r), axis)
        out, part = np.zeros_like(out), np.empty_like(out)
        for i, w in enumerate(k):
            out += np.multiply(p[:, i : i + n] if axis else p[i : i + n], w, out=part)
    return out


def box_mean(a: np.ndarray, window: int) -> np.ndarray:
    """Mean over a square window, by running sums."""
    r = window // 2
    h, w = a.shape
    reflect = min(a.shape) > r
    p = a.astype(np.float64).take(_mirrored(h, r, reflect), 0).take(_mirrored(w, r, reflect), 1)
    s = np.zeros((p.shape[0] + 1, p.shape[1] + 1))
    np.cumsum(np.cumsum(p, 0), 1, out=s[1:, 1:])
    return (s[window : window + h, window : window + w] - s[:h, window : window + w] - s[window : window + h, :w] + s[:h, :w]) / window**2


def gaussian_kernel(size: int, sigma: float) -> np.ndarray:
    k = np.exp(-0.5 * ((np.arange(size) - size // 2) / sigma) ** 2)
    return k / k.sum()


def denoised(gray: np.ndarray) -> np.ndarray:
    """Blurred only where the Laplacian varies much."""
    p = np.pad(gray.astype(np.float64), 1, mode="reflect" if min(gray.shape) > 1 else "edge")
    laplacian = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]
    if float(laplacian.var()) <= C.blur_above_variance:
        return gray
    k = gaussian_kernel(3, 1.0)
    return np.clip(np.rint(convolve(gray, k, k)), 0, 255).astype(np.uint8)


def otsu(gray: np.ndarray) -> np.ndarray:
    """Ink up to the level that parts the histogram with most variance between, the first on ties."""
    n = np.bincount(gray.ravel(), minlength=256).astype(np.float64)
    levels = np.arange(256)
    n0, s0 = np.cumsum(n), np.cumsum(n * levels)
    n1 = n0[-1] - n0
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((n0 > 0) & (n1 > 0), n0 * n1 * (s0 / n0 - (s0[-1] - s0) / n1) ** 2, 0)
    return np.where(gray > int(np.argmax(between)), PAPER, INK).astype(np.uint8)


def adaptive(gray: np.ndarray) -> np.ndarray:
    """Ink where a pixel is well under the Gaussian mean around it."""
    block = min(max(25, int(min(gray.shape) * 0.035) | 1), 75) | 1
    k = gaussian_kernel(block, 0.3 * ((block - 1) * 0.5 - 1) + 0.8)
    mean = np.rint(convolve(gray, k, k))
    return np.where(gray > mean - C.adaptive_offset, PAPER, INK).astype(np.uint8)


def sauvola(gray: np.ndarray, window: int = C.sauvola_window, k: float = C.sauvola_k) -> np.ndarray:
    mean = box_mean(gray, window)
    deviation = np.sqrt(np.maximum(box_mean(gray.astype(np.float64) ** 2, window) - mean**2, 0))
    return np.where(gray < mean * (1 + k * (deviation / C.sauvola_range - 1)), INK, PAPER).astype(np.uint8)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and stop of each run of a mask's rows, in reading order."""
    h, w = mask.shape
    edged = np.zeros((h, w + 2), np.int8)
    edged[:, 1:-1] = mask
    flat = np.diff(edged.ravel())
    begin, end = np.flatnonzero(flat == 1), np.flatnonzero(flat == -1)
    row = begin // (w + 2)
    return row, begin - row * (w + 2), end - row * (w + 2)


def _roots(row: np.ndarray, start: np.ndarray, stop: np.ndarray, width: int) -> np.ndarray:
    """For each run the first run of its eight-connected component: all pairs that touch are joined at once, until none is apart."""
    line = width + 2
    above = (row - 1) * line
    low = np.searchsorted(row * line + stop, above + start)
    n = np.searchsorted(row * line + start, above + stop, "right") - low  # corners touch
    b = np.repeat(np.arange(len(row)), n)
    a = np.arange(len(b)) + np.repeat(low - (np.cumsum(n) - n), n)
    parent = np.arange(len(row))
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def component_areas(masks: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Areas of each mask's eight-connected components, for masks of one width, one under the other with a row between."""
    if not masks:
        return []
    tops = np.cumsum([0, *[len(m) + 1 for m in masks]])
    page = np.zeros((tops[-1], masks[0].shape[1]), bool)
    for top, m in zip(tops, masks, strict=False):
        page[top : top + len(m)] = m
    row, start, stop = _runs(page)
    roots = _roots(row, start, stop, page.shape[1])
    area = np.bincount(roots, stop - start, len(row))
    first = np.flatnonzero(roots == np.arange(len(row)))
    return np.split(area[first], np.searchsorted(row[first], tops[1:-1]))


def components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels (0 outside) of eight-connected components, and per label x, y, w, h, area, cx, cy.

    Runs of each row are nodes; runs that touch from row to row are joined. Labels follow the first run in reading order.
    """
    h, w = mask.shape
    row, start, stop = _runs(mask.astype(bool))
    labels = np.zeros((h, w), np.int32)
    if not len(row):
        return labels, np.zeros((0, 7))
    roots = _roots(row, start, stop, w)
    _, which = np.unique(roots, return_inverse=True)
    size = stop - start
    stats = np.zeros((which.max() + 1, 7))
    x1, y1 = np.full(len(stats), w), np.full(len(stats), h)
    x2, y2 = np.zeros(len(stats), int), np.zeros(len(stats), int)
    np.minimum.at(x1, which, start)
    np.maximum.at(x2, which, stop)
    np.minimum.at(y1, which, row)
    np.maximum.at(y2, which, row + 1)
    area = np.bincount(which, size)
    stats[:] = np.stack([x1, y1, x2 - x1, y2 - y1, area, np.bincount(which, size * (start + stop - 1) / 2) / area, np.bincount(which, size * row) / area], 1)
    labels[mask.astype(bool)] = np.repeat(which + 1, size)
    return labels, stats


def binary_scores(pages: Sequence[np.ndarray]) -> list[float]:
    """How fit binary pages of one width are to be read: right amount of ink, few specks, few blobs, enough parts."""
    inks = [p == INK for p in pages]
    shares = [float(ink.mean()) for ink in inks]
    fit = [C.score_least_ink < share < C.score_most_ink for share in shares]
    found = iter(component_areas([ink for ink, ok in zip(inks, fit, strict=True) if ok]))
    return [_score(p.size, share, next(found)) if ok else C.score_unfit for p, share, ok in zip(pages, shares, fit, strict=True)]


def _score(size: int, share: float, areas: np.ndarray) -> float:
    areas = areas if len(areas) else np.array([1.0])
    specks, blobs = float((areas <= C.score_speck).mean()), float((areas > size * C.score_blob).mean())
    ink_weight, speck_weight, blob_weight, few_weight = C.score_weights
    return -ink_weight * abs(share - C.score_ink) - speck_weight * specks - blob_weight * blobs - (few_weight if len(areas) < C.score_parts else 0.0)


def binary_score(binary: np.ndarray) -> float:
    return binary_scores([binary])[0]


#: Fixed order: the first of equal scores is taken.
METHODS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"otsu": otsu, "adaptive_gaussian": adaptive, "sauvola": sauvola}


def best_of(scores: Sequence[float]) -> int:
    """Place of the highest score, the first on ties."""
    return max(range(len(scores)), key=scores.__getitem__)


def binarised(gray: np.ndarray) -> tuple[np.ndarray, str, dict[str, float]]:
    pages = {name: f(gray) for name, f in METHODS.items()}
    scores = dict(zip(pages, binary_scores(list(pages.values())), strict=True))
    best = list(METHODS)[best_of(list(scores.values()))]
    return pages[best], best, scores


def _hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, by monotone chains."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(seq: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return np.array(chain(p)[:-1] + chain(p[::-1])[:-1])


def skew(binary: np.ndarray) -> float:
    """Angle in degrees of the least rectangle around the ink, within (-45, 45]; 0 for little ink."""
    ys, xs = np.nonzero(binary == INK)
    if len(xs) < C.deskew_min_ink:
        return 0.0
    edge = np.unique(np.concatenate([np.stack([f(xs[ys == y]), y]) [None] for y in np.unique(ys) for f in (np.min, np.max)]), axis=0)
    hull = _hull(edge.astype(np.float64))
    if len(hull) < 3:
        return 0.0
    sides = np.roll(hull, -1, 0) - hull
    best, angle = math.inf, 0.0
    for a in np.unique(np.arctan2(sides[:, 1], sides[:, 0]) % (math.pi / 2)):
        u = hull @ np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]])
        size = np.ptp(u[:, 0]) * np.ptp(u[:, 1])
        if size < best - 1e-9:
            best, angle = size, math.degrees(a)
    return angle - 90 if angle > 45 else angle


def rotate(a: np.ndarray, angle: float, fill: int = PAPER) -> np.ndarray:
    """a turned about its middle, bilinear, fill outside."""
    h, w = a.shape
    t = math.radians(angle)
    y, x = np.mgrid[:h, :w]
    dx, dy = x - w // 2, y - h // 2
    sx, sy = math.cos(t) * dx - math.sin(t) * dy + w // 2, math.sin(t) * dx + math.cos(t) * dy + h // 2
    p = np.pad(a.astype(np.float64), 1, constant_values=fill)
    sx, sy = np.clip(sx + 1, 0, w + 0.999), np.clip(sy + 1, 0, h + 0.999)
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0
    top = p[y0, x0] * (1 - fx) + p[y0, np.minimum(x0 + 1, w + 1)] * fx
    low = p[np.minimum(y0 + 1, h + 1), x0] * (1 - fx) + p[np.minimum(y0 + 1, h + 1), np.minimum(x0 + 1, w + 1)] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def deskewed(binary: np.ndarray) -> tuple[np.ndarray, float]:
    angle = float(np.clip(skew(binary), -C.deskew_max, C.deskew_max))
    return (binary, 0.0) if abs(angle) < C.deskew_min else (rotate(binary, angle), angle)


def _slide(mask: np.ndarray, width: int, height: int, grow: bool) -> np.ndarray:
    """Dilation (grow) or erosion of a mask by a rectangle, by running sums; outside counts for neither."""
    out = mask.astype(bool)
    for axis, k in ((1, width), (0, height)):
        if k <= 1:
            continue
        left = k // 2
        pad = [(0, 0), (0, 0)]
        pad[axis] = (left, k - 1 - left)
        s = np.cumsum(np.pad(out, pad, constant_values=not grow).astype(np.int32), axis=axis)
        s = np.concatenate([np.zeros_like(s[:, :1] if axis else s[:1]), s], axis=axis)
        n = out.shape[axis]
        count = s[:, k : k + n] - s[:, :n] if axis else s[k : k + n] - s[:n]
        out = count > 0 if grow else count == k
    return out


def dilate(mask: np.ndarray, width: int, height: int, times: int = 1) -> np.ndarray:
    for _ in range(times):
        mask = _slide(mask, width, height, True)
    return mask


def erode(mask: np.ndarray, width: int, height: int) -> np.ndarray:
    return _slide(mask, width, height, False)


def close(mask: np.ndarray, width: int, height: int) -> np.ndarray:
    return erode(dilate(mask, width, height)[:, ::-1][::-1], width, height)[::-1][:, ::-1]


def opened(mask: np.ndarray, width: int, height: int) -> np.ndarray:
    return dilate(erode(mask, width, height)[:, ::-1][::-1], width, height)[::-1][:, ::-1]


def reconnected(binary: np.ndarray) -> np.ndarray:
    """The least closing of the light parts, as binary pages are white on black to it."""
    return np.where(close(binary == PAPER, 2, 1), PAPER, INK).astype(np.uint8)


def cleared_edges(binary: np.ndarray) -> np.ndarray:
    """Dense rows and columns that run in from each edge become paper; scans stop at the first that isn't dense."""
    out = binary.copy()
    for axis in (0, 1):
        page = out if axis == 0 else out.T  # a view
        scan = max(1, int(page.shape[0] * C.edge_scan))
        for rows in (range(scan), range(page.shape[0] - 1, page.shape[0] - 1 - scan, -1)):
            for i in rows:
                if float((page[i] == INK).mean()) < C.edge_ink:
                    break
                page[i] = PAPER
    return out


def _ellipse(size: int) -> np.ndarray:
    r = size // 2
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    return np.abs(x) <= np.rint(r * np.sqrt(np.maximum(0, 1 - (y / max(r, 1)) ** 2)))


def dilate_by(mask: np.ndarray, shape: np.ndarray) -> np.ndarray:
    r = len(shape) // 2
    p = np.pad(mask, r)
    out = np.zeros_like(mask)
    for y, x in np.argwhere(shape):
        out |= p[y : y + mask.shape[0], x : x + mask.shape[1]]
    return out


def without_rulings(binary: np.ndarray) -> np.ndarray:
    """Long straight lines become paper, except near other ink."""
    h, w = binary.shape
    ink = binary == INK
    lines = opened(ink, max(C.ruling_min, int(w * C.ruling_share)), 1) | opened(ink, 1, max(C.ruling_min, int(h * C.ruling_share)))
    if not lines.any():
        return binary
    near = dilate_by(ink & ~lines, _ellipse(5))
    return np.where(lines & ~near, PAPER, binary).astype(np.uint8)


def squared_distances(mask: np.ndarray) -> np.ndarray:
    """The squared distance from each pixel of a mask to the nearest one outside it on the page; infinite where all of the page is in it.

    Two passes: down and up each column, then along the rows the lowest of the columns' parabolas, over as many columns as may still matter.
    """
    h, w = mask.shape
    rows = np.arange(h)[:, None]
    out = ~mask.astype(bool)
    above = rows - np.maximum.accumulate(np.where(out, rows, -(1 << 24)), 0)
    below = np.minimum.accumulate(np.where(out, rows, 1 << 24)[::-1], 0)[::-1] - rows
    column = np.minimum(above, below).astype(np.float64)
    column[column >= 1 << 20] = np.inf
    column *= column
    found = column.copy()
    for dx in range(1, w):
        if not (found > dx * dx).any():
            break
        np.minimum(found[:, dx:], column[:, :-dx] + dx * dx, out=found[:, dx:])
        np.minimum(found[:, :-dx], column[:, dx:] + dx * dx, out=found[:, :-dx])
    return found


def thinned(mask: np.ndarray) -> np.ndarray:
    """Lines of one pixel in the middle of a mask's strokes: two passes take turns at peeling pixels whose loss parts nothing, until none is left."""
    page = np.pad(mask.astype(bool), 1)
    width = page.shape[1]
    flat = page.ravel()
    ring = np.array([-width, 1 - width, 1, 1 + width, width, width - 1, -1, -1 - width])  # from the pixel above, clockwise
    at = np.flatnonzero(flat)
    changed = True
    while changed:
        changed = False
        for second in (False, True):
            n, ne, e, se, s, sw, w, nw = flat[at + ring[:, None]]
            parts = (~n & (ne | e)).astype(np.int8) + (~e & (se | s)) + (~s & (sw | w)) + (~w & (nw | n))
            pairs = np.minimum((nw | n).astype(np.int8) + (ne | e) + (se | s) + (sw | w), (n | ne).astype(np.int8) + (e | se) + (s | sw) + (w | nw))
            side = (n | ne | ~se) & e if not second else (s | sw | ~nw) & w
            gone = (parts == 1) & (pairs >= 2) & (pairs <= 3) & ~side
            if gone.any():
                flat[at[gone]] = False
                at = at[~gone]
                changed = True
    return flat.reshape(page.shape)[1:-1, 1:-1].copy()


def even_strokes(binary: np.ndarray) -> np.ndarray:
    """Ink thinned to its middle lines, and these thickened by its usual depth, between 1 and 2.5; pages with little ink stay."""
    ink = binary == INK
    if int(ink.sum()) < 50:
        return binary
    depth = np.sqrt(squared_distances(ink)[ink])
    r = max(1, int(round(max(1.0, min(float(np.median(depth)), 2.5)))))
    return np.where(dilate_by(thinned(ink), _ellipse(2 * r + 1)), INK, PAPER).astype(np.uint8)


def without_grid(gray: np.ndarray) -> np.ndarray:
    """Periodic lines notched out of the spectrum, then long bright strokes taken off."""
    h, w = gray.shape
    spectrum = np.fft.fftshift(np.fft.fft2(gray.astype(np.float64)))
    size = np.abs(spectrum)
    ys, xs = np.ogrid[:h, :w]
    size[(ys - h // 2) ** 2 + (xs - w // 2) ** 2 < C.notch_radius**2] = 0
    if size.max() > 0:
        spectrum[size > np.percentile(size[size > 0], C.notch_percentile)] = 0
        gray = np.clip(np.abs(np.fft.ifft2(np.fft.ifftshift(spectrum))), 0, 255).astype(np.uint8)
    inverse = 255 - gray
    k = max(20, int(w * C.tophat_share))
    low = np.min(np.lib.stride_tricks.sliding_window_view(np.pad(inverse, ((0, 0), (k // 2, k - 1 - k // 2)), constant_values=255), k, axis=1), axis=2)
    open_ = np.max(np.lib.stride_tricks.sliding_window_view(np.pad(low, ((0, 0), (k - 1 - k // 2, k // 2)), constant_values=0), k, axis=1), axis=2)
    return (255 - open_).astype(np.uint8)


def prepared(page: np.ndarray, strokes: bool = False) -> tuple[np.ndarray, str, dict[str, float], list[str], float]:
    """A colour or gray page to a binary one: the page, method, scores, stages and angle."""
    stages = ["resize", "grayscale", "contrast", "denoise", "binarise", "deskew"]
    gray = denoised(contrast(grayscale(resized(page))))
    binary, method, scores = binarised(gray)
    binary, angle = deskewed(binary)
    if strokes:
        binary = even_strokes(binary)
        stages.append("strokes")
    binary = without_rulings(cleared_edges(reconnected(binary)))
    return binary, method, scores, [*stages, "close", "edges", "rulings"], angle


def lightness(bgr: np.ndarray) -> np.ndarray:
    """The lightness of a page's colours on the CIE scale, 0 to 255; a gray page's is that of its levels."""
    levels = bgr.astype(np.float64).reshape(*bgr.shape[:2], -1) / 255.0
    linear = np.where(levels <= 0.04045, levels / 12.92, ((levels + 0.055) / 1.055) ** 2.4)
    y = linear[:, :, 0] if linear.shape[2] == 1 else linear @ np.array([0.072169, 0.715160, 0.212671])  # blue, green, red
    light = np.where(y > 0.008856, 116.0 * np.cbrt(y) - 16.0, 903.3 * y)
    return np.clip(np.rint(light * 2.55), 0, 255).astype(np.uint8)


def equalised_light(page: np.ndarray) -> np.ndarray:
    """A page in gray whose lightness is equalised by tiles, its colours else left: each pixel's channels follow its light."""
    before = lightness(page).astype(np.float64)
    after = equalised(before.astype(np.uint8)).astype(np.float64)
    gray = grayscale(page).astype(np.float64)
    return np.clip(np.rint(gray * (after + 1.0) / (before + 1.0)), 0, 255).astype(np.uint8)


def prepared_without_grid(page: np.ndarray) -> tuple[np.ndarray, str, dict[str, float], list[str], float]:
    """prepared() for grid paper: lightness evened out, the grid notched out before binarising, edges and rulings left."""
    gray = denoised(without_grid(equalised_light(resized(page))))
    binary, method, scores = binarised(gray)
    binary, angle = deskewed(binary)
    return reconnected(binary), method, scores, ["resize", "grayscale", "equalise", "grid", "denoise", "binarise", "deskew", "close"], angle


def tightened(binary: np.ndarray, box: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    """The extent of the ink inside a box; the box where there is none."""
    x1, y1, x2, y2 = box
    ys, xs = np.nonzero(binary[y1:y2, x1:x2] == INK)
    return box if not len(xs) else (x1 + int(xs.min()), y1 + int(ys.min()), x1 + int(xs.max()) + 1, y1 + int(ys.max()) + 1)


def mask_boxes(mask: np.ndarray, height: int, width: int) -> list[tuple[int, int, int, int]]:
    """Line boxes of a probability mask, by top edge."""
    on = close(mask > D.mask_threshold, 30, 3)
    if on.shape != (height, width):
        on = on[np.arange(height) * on.shape[0] // height][:, np.arange(width) * on.shape[1] // width]
    return _large(components(on)[1])


def score_boxes(scores: np.ndarray, height: int, width: int) -> list[tuple[int, int, int, int]]:
    """Region boxes of a half-resolution character map, by top edge."""
    full = resize((np.clip(scores, 0, 1) * 255).astype(np.uint8), width, height) / 255.0
    return _large(components(dilate(full > D.region_threshold, 20, 3, 2))[1])


def _large(stats: np.ndarray) -> list[tuple[int, int, int, int]]:
    boxes = [(int(x), int(y), int(x + w), int(y + h)) for x, y, w, h, *_ in stats if h >= D.min_height and w >= D.min_width]
    return sorted(boxes, key=lambda b: b[1])


def inside_polygon(polygon: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points lie inside a polygon, by crossings."""
    out = np.zeros(np.broadcast(x, y).shape, bool)
    for (ax, ay), (bx, by) in zip(polygon, np.roll(polygon, -1, 0), strict=True):
        with np.errstate(divide="ignore", invalid="ignore"):
            crosses = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        out ^= crosses
    return out


def polygon_crop(page: np.ndarray, polygon: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    """The box of a page, white outside the polygon."""
    x1, y1, x2, y2 = box
    y, x = np.mgrid[y1:y2, x1:x2]
    crop = page[y1:y2, x1:x2].copy()
    crop[~inside_polygon(np.asarray(polygon, float), x, y)] = PAPER
    return crop


def rotated_crop(page: np.ndarray, polygon: np.ndarray, angle: float, pad: int = D.padding) -> np.ndarray:
    """The upright hull, padded, of a polygon turned about its centre by an angle; the plain box where that is empty."""
    polygon = np.asarray(polygon, float)
    c, t = polygon.mean(0), math.radians(angle)
    turned = (polygon - c) @ np.array([[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]]) + c
    gray = grayscale(page)
    h, w = gray.shape
    y, x = np.mgrid[:h, :w]
    sx = np.rint(math.cos(t) * (x - c[0]) - math.sin(t) * (y - c[1]) + c[0]).astype(int)
    sy = np.rint(math.sin(t) * (x - c[0]) + math.cos(t) * (y - c[1]) + c[1]).astype(int)
    ok = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    image = np.where(ok, gray[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], PAPER).astype(np.uint8)
    for points, source in ((turned, image), (polygon, gray)):
        (x1, y1), (x2, y2) = np.floor(points.min(0)).astype(int) - pad, np.ceil(points.max(0)).astype(int) + pad
        crop = source[max(0, y1) : min(h, y2), max(0, x1) : min(w, x2)]
        if crop.size:
            return crop
    return gray[:0, :0]


def model_input(crop: np.ndarray, height: int = 128, width: int = 1024) -> np.ndarray:
    """A gray crop of fixed size in [0, 1]."""
    return resize(grayscale(crop), width, height).astype(np.float32) / 255.0


def box_mask(height: int, width: int, boxes: list[tuple[int, int, int, int]]) -> np.ndarray:
    mask = np.zeros((height, width), np.uint8)
    for x1, y1, x2, y2 in boxes:
        mask[y1:y2, x1:x2] = 255
    return mask


def augmented(image: np.ndarray, mask: np.ndarray, flip: bool, brightness: float, noise: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Flip, brightness and noise by given draws."""
    if flip:
        image, mask = image[:, ::-1], mask[:, ::-1]
    shade = np.random.default_rng(seed).normal(0, noise, image.shape) if noise else 0
    return np.clip(image * brightness + shade, 0, 255).astype(np.uint8), mask


def copy_seed(index: int) -> int:
    """Seed of a page's augmented copy, by its running number (datasets.augmented); the two numbers are fixed."""
    return index * 137 + 7


def jittered(image: np.ndarray, index: int) -> np.ndarray:
    """A copy of a page with its own brightness, blur and noise, drawn from copy_seed(index): the same at every run."""
    draw = np.random.default_rng(copy_seed(index))
    out = image.astype(np.float64) * draw.uniform(0.8, 1.2) + draw.uniform(-15, 15)
    if draw.random() < 0.5:
        kernel = gaussian_kernel(3, 0.8)
        flat = out.reshape(*out.shape[:2], -1)
        out = np.stack([convolve(flat[:, :, k], kernel, kernel) for k in range(flat.shape[2])], 2).reshape(out.shape)
    return np.clip(out + draw.normal(0, draw.uniform(0, 8), out.shape), 0, 255).astype(np.uint8)


def word_boxes(binary: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes of words: ink joined across small gaps, parts of enough area and size, in reading order of their tops."""
    h, w = binary.shape
    joined = dilate(binary == INK, 9, 3)
    found = [s for s in components(joined)[1] if s[4] >= h * w * D.word_area]
    return _large(np.array(found).reshape(-1, 7))


def oriented_word_boxes(binary: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """Words as turned boxes: (angle in degrees, four corners) of the least rectangle about each, in order of their tops."""
    h, w = binary.shape
    labels, stats = components(dilate(binary == INK, 9, 3))
    out = []
    for k, s in enumerate(stats, 1):
        if s[4] < h * w * D.word_area or s[2] < D.min_width or s[3] < D.min_height:
            continue
        ys, xs = np.nonzero(labels == k)
        out.append((int(s[1]), int(s[0]), *least_rectangle(np.stack([xs, ys], 1))))
    return [(angle, corners) for _, _, angle, corners in sorted(out, key=lambda x: x[:2])]


def least_rectangle(points: np.ndarray) -> tuple[float, np.ndarray]:
    """Angle within 45 degrees and corners of the rectangle of least area about points; one of its sides lies on their hull."""
    hull = _hull(points).astype(np.float64)
    edges = np.roll(hull, -1, 0) - hull
    best = None
    for t in {round(float(math.atan2(dy, dx)) % (math.pi / 2), 12) for dx, dy in edges}:
        t = t - math.pi / 2 if t > math.pi / 4 else t
        axes = np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])
        along = hull @ axes.T
        low, high = along.min(0), along.max(0)
        area = float(np.prod(high - low))
        if best is None or (area, abs(t)) < best[:2]:
            box = np.array([[low[0], low[1]], [high[0], low[1]], [high[0], high[1]], [low[0], high[1]]]) @ axes
            best = area, abs(t), t, box
    return (math.degrees(best[2]), best[3]) if best else (0.0, np.repeat(hull[:1], 4, 0))


def _page(row, binary: bool = False) -> np.ndarray:
    a = np.frombuffer(row.pixels, np.uint8).reshape(row.height, row.width, -1)
    return a[:, :, 0] if binary or a.shape[2] == 1 else a


#: Bytes of pixels that a batch of results holds, and its rows, at most.
OUT_BYTES, OUT_ROWS = 16 << 20, 4096
#: Pages that leave an Arrow batch at once.
IN_ROWS = 64


def _mapped(pages: DataFrame, schema: str, one: Callable[[object], Iterator[tuple]]) -> DataFrame:
    """one() of each page. Pages leave their Arrow batch a few at a time, and results go as their bytes fill a batch, so a worker holds no second copy of a batch."""
    names = [x.strip().split()[0] for x in _fields(schema)]
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=names), schema=kinds, preserve_index=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, IN_ROWS):
                for row in batch.slice(at, IN_ROWS).to_pandas().itertuples():
                    for got in one(row):
                        out.append(got)
                        size += sum(len(x) for x in got if isinstance(x, bytes))
                        if size > OUT_BYTES or len(out) >= OUT_ROWS:
                            yield made(out)
                            out, size = [], 0
        if out:
            yield made(out)
        pa.default_memory_pool().release_unused()

    return pages.mapInArrow(run, schema)


def _fields(schema: str) -> list[str]:
    depth, out = 0, [""]
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def preprocess(pages: DataFrame, strokes: bool = False, grid: bool = False) -> DataFrame:
    """Pages to binary pages with method, scores, stages and angle. grid: by the way for grid paper."""

    def one(row) -> Iterator[tuple]:
        binary, method, scores, stages, angle = prepared_without_grid(_page(row)) if grid else prepared(_page(row), strokes)
        yield row.page_id, row.page_no, *binary.shape, 1, binary.tobytes(), method, scores, stages, angle

    return _mapped(pages, BINARY_PAGES, one)


def ink_profile(pages: DataFrame, columns: bool = False) -> DataFrame:
    """(page_id, y, ink): ink pixels of each row, or of each column, of binary pages."""

    def one(row) -> Iterator[tuple]:
        sums = (_page(row, True) == INK).sum(0 if columns else 1)
        for y, n in enumerate(sums.tolist()):
            yield row.page_id, y, n

    return _mapped(pages.select("page_id", "height", "width", "pixels"), PROFILE, one)


def component_rows(pages: DataFrame) -> DataFrame:
    """Connected components of binary pages."""

    def one(row) -> Iterator[tuple]:
        for k, (x, y, w, h, area, cx, cy) in enumerate(components(_page(row, True) == INK)[1].tolist(), 1):
            yield row.page_id, k, int(x), int(y), int(w), int(h), int(area), cx, cy

    return _mapped(pages.select("page_id", "height", "width", "pixels"), COMPONENTS, one)


def tightened_rows(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes of binary pages shrunk to their ink. Pages and their boxes meet by page."""
    from pyspark.sql import functions as F

    lists = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x1", "y1", "x2", "y2"))).alias("boxes"))

    def one(row) -> Iterator[tuple]:
        page = _page(row, True)
        for b in row.boxes:
            yield row.page_id, b["seq"], *tightened(page, (b["x1"], b["y1"], b["x2"], b["y2"]))

    return _mapped(pages.select("page_id", "height", "width", "pixels").join(lists, "page_id"), BOXES, one)
