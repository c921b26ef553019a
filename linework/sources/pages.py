"""Pages from files. Portable any-map files decode here; other codecs are handed in."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.config import CONFIG
from linework.schemas import PAGES

_HEADER = re.compile(rb"(P[2356])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


class PageError(ValueError):
    """A page that can't be read or is too small."""


def decode_pnm(data: bytes) -> np.ndarray:
    """Rows x columns x channels (1, or 3 as blue, green, red) of a PGM or PPM file."""
    m = _HEADER.match(data)
    if not m:
        raise PageError("no portable any-map")
    kind, w, h, top = m[1], int(m[2]), int(m[3]), int(m[4])
    depth = 3 if kind in (b"P3", b"P6") else 1
    n = w * h * depth
    if kind in (b"P2", b"P3"):
        values = np.array(data[m.end() :].split()[:n], np.int64)
    else:
        values = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, m.end()).astype(np.int64)
    if len(values) < n:
        raise PageError("file is cut off")
    pixels = (values if top == 255 else values * 255 // top).astype(np.uint8).reshape(h, w, depth)
    return pixels[:, :, ::-1] if depth == 3 else pixels


def decode_pages(files: DataFrame, decoder: Callable[[bytes], np.ndarray] = decode_pnm) -> DataFrame:
    """Pages of (path, content). A file that the decoder refuses gives a page with null pixels, so none is lost silently."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, content in zip(rows["path"], rows["content"], strict=True):
                try:
                    a = np.ascontiguousarray(decoder(bytes(content)))
                    out.append((path, 0, *a.shape[:2], a.shape[2] if a.ndim == 3 else 1, a.tobytes()))
                except (ValueError, IndexError):
                    out.append((path, 0, 0, 0, 0, None))
            yield pd.DataFrame(out, columns=["page_id", "page_no", "height", "width", "channels", "pixels"])

    return files.select("path", "content").mapInPandas(run, PAGES)


def valid_pages(pages: DataFrame, strict: bool = False) -> DataFrame:
    """Pages with pixels and sides of the least length; strict raises at the first other one."""
    least = CONFIG.preprocessing.min_side
    ok = F.col("pixels").isNotNull() & (F.col("height") >= least) & (F.col("width") >= least)
    if strict:
        return pages.withColumn("pixels", F.when(ok, F.col("pixels")).otherwise(F.raise_error(F.concat(F.lit("unreadable or small page: "), "page_id")).cast("binary")))
    return pages.where(ok)


def pdf_pages(files: DataFrame, renderer: Callable[[bytes], Iterable[np.ndarray]]) -> DataFrame:
    """Pages of (path, content) PDF files by a renderer, in order, labelled 'path [page n]'. Its errors are not swallowed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                for k, image in enumerate(renderer(bytes(content)), 1):
                    a = np.ascontiguousarray(image)
                    yield pd.DataFrame([(f"{path} [page {k}]", k, *a.shape[:2], a.shape[2] if a.ndim == 3 else 1, a.tobytes())], columns=["page_id", "page_no", "height", "width", "channels", "pixels"])

    return files.select("path", "content").mapInPandas(run, PAGES)
