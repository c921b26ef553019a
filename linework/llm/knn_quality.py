"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are its trigrams of byte classes (lower, upper, digit, blank, line break, beyond ASCII, ten kinds of
signs), which see style rather than language, and words that repeat the one before, under several terms for their weight. Term weights and a truncated singular value decomposition come from a bounded
sample of labelled rows; the sample's vectors go to every worker. Each document's exact cosines with all of them are
computed in blocks, and the nearest neighbours vote with their label, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.llm.common import documents, text_key
from linework.llm.kernels import chunks, tidied, word_hashes

CLASSES = 16
REPEATS = 24
TERMS = CLASSES**3 + REPEATS
#: Labelled rows that the classifier is fitted on, at most: those of the smallest hashes of doc_id.
SAMPLE_ROWS = 4096
DIMENSIONS = 64
NEIGHBOURS = 15
THRESHOLD = 0.3
BLOCK = 256

_CLASS = np.full(256, 6, np.int64)
_CLASS[:] = 6 + np.arange(256) % 10
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9]] = 3
_CLASS[[10, 11, 12, 13]] = 4
_CLASS[128:] = 5


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Term counts of each document of a chunk."""
    docs = len(offsets) - 1
    out = np.zeros((docs, TERMS), np.float32)
    if len(data) < 3:
        return out
    h, doc, _, _ = word_hashes(data, offsets)
    again = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    out[:, CLASSES**3 :] = np.bincount(doc[1:][again], minlength=docs)[:, None]
    c = _CLASS[data]
    term = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
    for d in range(docs):
        a, b = offsets[d], offsets[d + 1] - 2
        if b > a:
            out[d, : CLASSES**3] = np.bincount(term[a:b], minlength=CLASSES**3)
    return out


@dataclass
class Voter:
    idf: np.ndarray
    basis: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # sample x dimensions, of length 1
    labels: np.ndarray
    prior: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        v = x @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 in the neighbours' votes; the labels' mean where nothing is similar."""
        out = np.full(len(counts), self.prior)
        if not len(self.labels):
            return out
        k = min(neighbours, len(self.labels))
        for i in range(0, len(counts), BLOCK):
            cosine = self.project(counts[i : i + BLOCK]) @ self.vectors.T
            # All that are as near as the k-th vote, those at its very distance with what is left of the k votes in equal parts.
            least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
            nearer, level = cosine > least, cosine == least
            part = nearer + level * ((k - nearer.sum(1, keepdims=True)) / level.sum(1, keepdims=True))
            weight = np.maximum(cosine, 0).astype(np.float64) * part
            total = weight.sum(1)
            vote = weight @ self.labels
            seen = total > 1e-9
            out[i : i + BLOCK][seen] = vote[seen] / total[seen]
        return np.clip(out, 0.0, 1.0)


def fit(counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 7) -> Voter:
    """A voter of labelled count rows. Without rows the score is 0.5 for all."""
    n = len(labels)
    if not n:
        return Voter(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    idf = np.log((1 + n) / (1 + (counts > 0).sum(0))).astype(np.float32) + np.float32(0.1)
    x = np.log1p(counts) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    d = min(dimensions, n, TERMS)
    probe = np.random.default_rng(seed).standard_normal((TERMS, min(d + 16, n))).astype(np.float32)
    for _ in range(4):  # randomised range finding
        q, _ = np.linalg.qr(x @ probe)
        probe, _ = np.linalg.qr(x.T @ q)
    _, s, vt = np.linalg.svd(x @ probe, full_matrices=False)
    basis = (probe @ vt[:d].T).astype(np.float32)
    # Half-whitening: the square root of the spectrum, so that the mean style alone does not decide.
    basis /= np.sqrt(np.maximum(s[:d], 1e-6)).astype(np.float32)
    voter = Voter(idf, basis, np.zeros((0, d), np.float32), labels.astype(np.float64), float(labels.mean()))
    voter.vectors = voter.project(counts).astype(np.float32)
    return voter


def _part(data: np.ndarray, offsets: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the BLOCK documents from i on."""
    o = offsets[i : i + BLOCK + 1]
    return data[o[0] : o[-1]], o - o[0]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in chunks(batch.column("text")):
            n = len(offsets) - 1
            at, found, begin = [], [], [0]
            for i in range(0, n, BLOCK):
                for row in term_counts(*_part(data, offsets, i)):
                    hit = np.flatnonzero(row)
                    at.append(hit.astype(np.int32))
                    found.append(row[hit].astype(np.int32))
                    begin.append(begin[-1] + len(hit))
            starts = pa.array(np.array(begin, np.int32))
            lists = [pa.ListArray.from_arrays(starts, pa.array(np.concatenate(x))) for x in (at, found)]
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(first, n), batch.column("order").slice(first, n), *lists], ["label", "order", "terms", "counts"])


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, rows: int = SAMPLE_ROWS) -> Voter:
    """A voter of at most `rows` labelled documents of the training folds. Rows without a label don't count.

    Of rows that share a doc_id the one of the smallest text_key is the labelled one, and equal rows are one.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    marked = marked.where(F.crc32(F.col("doc_id").cast("string")) % folds != 0).groupBy("doc_id").agg(F.min("label").alias("label"))
    sample = marked.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(rows)
    texts = documents(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "order", "text")
    # One row of each doc_id, so what reaches the driver is bounded however often rows repeat.
    texts = texts.groupBy("doc_id", "label", "order").agg(F.min(F.struct(text_key().alias("key"), "text")).alias("t")).select("label", "order", "t.text")
    found = texts.mapInArrow(tidied(_counted), "label int, order long, terms array<int>, counts array<int>").toArrow().sort_by([("order", "ascending")])
    counts = np.zeros((found.num_rows, TERMS), np.float32)
    for i in range(len(counts)):
        counts[i, found["terms"][i].values.to_numpy()] = found["counts"][i].values.to_numpy()
    return fit(counts, found["label"].to_numpy().astype(np.float64))


def _scored(voter: Voter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in chunks(batch.column("text")):
                n = len(offsets) - 1
                scores = [voter.score(term_counts(*_part(data, offsets, i))) for i in range(0, n, BLOCK)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), batch.column("text_key").slice(first, n), pa.array(np.concatenate(scores))], ["doc_id", "text_key", "score"])

    return run


def scores(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, text_key for every document.

    Null text counts as empty, and an empty text scores the labels' mean. Rows that repeat a doc_id, or have none, score
    each by their texts, which text_key (common.text_key) tells apart; equal texts score alike. Neighbours at the k-th one's
    very distance share what is left of the k votes. Texts of any length are read whole; extra columns are ignored;
    without documents there are no rows, and without labels every score is 0.5.
    """
    voter = train(docs, labels, folds)
    found = documents(docs).withColumn("text_key", text_key()).mapInArrow(tidied(_scored(voter)), "doc_id long, text_key long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "text_key")
