"""From step scores to sequences: likeliest tokens, top k, beams around any step function."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.functions.text import BOS, EOS, let
from linework.operators.losses import softmax, top_probability

Step = Callable[[object, list[int]], np.ndarray]
#: What an id of no probability costs.
HIGHEST = -math.log(1e-12)


def likeliest(logits: Column | str) -> Column:
    """Index of the highest score, the first on ties."""
    logits = F.col(logits) if isinstance(logits, str) else logits
    return F.array_position(logits, F.array_max(logits)).cast("int") - 1


def top_k(logits: Column | str, k: int) -> Column:
    """array<struct(id, p)> of the k likeliest entries, the smaller id on ties."""
    logits = F.col(logits) if isinstance(logits, str) else logits
    order = F.array_sort(F.transform(logits, lambda x, i: F.struct((-x).alias("s"), i.alias("id"))))
    return let(softmax(logits), lambda p: F.transform(F.slice(order, 1, k), lambda x: F.struct(x["id"].alias("id"), F.get(p, x["id"]).alias("p"))))


def step_tokens(steps: DataFrame, logits: str, *line: str) -> DataFrame:
    """Greedy tokens of step rows (line, tok_index, logits): id and the step's highest probability, up to the end token."""
    rows = steps.withColumns({"id": likeliest(logits), "p": top_probability(logits)})
    end = rows.where(F.col("id") == EOS).groupBy(*line).agg(F.min("tok_index").alias("_end"))
    return rows.join(end, list(line), "left").where(F.col("_end").isNull() | (F.col("tok_index") < F.col("_end"))).select(*line, "tok_index", "id", "p")


def greedy(state: object, step: Step, most: int, bos: int = BOS, eos: int = EOS) -> list[int]:
    """Ids after bos, each the likeliest of step(state, ids so far), up to eos or `most` of them."""
    ids = [bos]
    for _ in range(most):
        best = int(np.argmax(step(state, ids)))
        if best == eos:
            break
        ids.append(best)
    return ids[1:]


def beam(state: object, step: Step, most: int, width: int, bos: int = BOS, eos: int = EOS) -> list[int]:
    """The ids of least summed negative log probability, ended or not. Ended beams leave the pool; the earlier one wins ties, an ended one first."""
    live: list[tuple[float, list[int]]] = [(0.0, [bos])]
    ended: list[tuple[float, list[int]]] = []
    for _ in range(most):
        grown = []
        for cost, ids in live:
            p = np.asarray(step(state, ids), np.float64)
            for k in np.argsort(-p, kind="stable")[:width]:
                grown.append((cost - math.log(max(float(p[k]), 1e-12)), [*ids, int(k)]))
        grown.sort(key=lambda x: x[0])
        live = []
        for cost, ids in grown[:width]:
            (ended if ids[-1] == eos else live).append((cost, ids))
        if not live:
            break
    best = min(ended + live, key=lambda x: x[0])[1]
    return [x for x in best[1:] if x != eos]


def decode(inputs: DataFrame, column: str, step: Step, most: int = 128, width: int = 1) -> DataFrame:
    """inputs with ids decoded from a column by a step function: greedy for a width of one, else by beams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows["ids"] = [greedy(x, step, most) if width <= 1 else beam(x, step, most, width) for x in rows[column]]
            yield rows

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema)
    return inputs.mapInPandas(run, f"{schema}, ids array<int>")


#: Log probabilities of the next id (rows x beams x ids) after the ids so far (rows x beams x length), for the rows' states.
Steps = Callable[[np.ndarray, np.ndarray], np.ndarray]


def beams(states: np.ndarray, step: Steps, most: int, width: int, penalty: float = 1.0, bos: int = BOS, eos: int = EOS) -> list[list[int]]:
    """beam() of many rows as arrays, with one call of step for all rows and beams that are live.

    An id that its beam has already costs penalty times as much, so repeating is put off without being ruled out. A row is done
    once an ended beam costs no more than any live one, as costs only grow.
    """
    n = len(states)
    best: list[list[int]] = [[] for _ in range(n)]
    least = np.full(n, np.inf)
    rows = np.arange(n)
    ids = np.full((n, 1, 1), bos, np.int64)
    cost = np.zeros((n, 1))
    for _ in range(most):
        if not len(rows):
            break
        price = np.minimum(-np.asarray(step(states[rows], ids), np.float64), HIGHEST)
        if penalty != 1:
            seen = np.zeros(price.shape, bool)
            np.put_along_axis(seen, ids, True, axis=2)
            price = np.where(seen, price * penalty, price)
        k = min(width, price.shape[2])
        top = np.argsort(price, axis=2, kind="stable")[:, :, :k]
        grown = (cost[:, :, None] + np.take_along_axis(price, top, 2)).reshape(len(rows), -1)
        order = np.argsort(grown, axis=1, kind="stable")[:, :width]
        cost = np.take_along_axis(grown, order, 1)
        last = np.take_along_axis(top.reshape(len(rows), -1), order, 1)
        ids = np.concatenate([np.take_along_axis(ids, (order // k)[:, :, None], 1), last[:, :, None]], 2)
        ended = (last == eos) & np.isfinite(cost)
        for i in np.flatnonzero(ended.any(1)).tolist():
            j = int(np.argmax(ended[i]))  # costs rise from left to right
            if cost[i, j] < least[rows[i]]:
                least[rows[i]], best[rows[i]] = cost[i, j], ids[i, j, 1:-1].tolist()
        cost = np.where(ended, np.inf, cost)
        live = least[rows] > cost.min(1)
        rows, ids, cost = rows[live], ids[live], cost[live]
    for i, j in enumerate(np.argmin(cost, 1).tolist() if len(rows) else ()):
        best[rows[i]] = [x for x in ids[i, j, 1:].tolist() if x != eos]
    return best


def decode_batches(inputs: DataFrame, column: str, step: Steps, most: int = 128, width: int = 5, penalty: float = 1.0, rows: int = 1024) -> DataFrame:
    """inputs with ids decoded by beams() from a column of arrays of one length, `rows` rows at a time. A null state gives no ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.iloc[at : at + rows].copy()
                given = part[column].notna()
                found = beams(np.stack(part[column][given].to_list()), step, most, width, penalty) if given.any() else []
                part["ids"] = pd.Series([[]] * len(part), index=part.index, dtype=object)
                part.loc[given, "ids"] = pd.Series(found, index=part.index[given], dtype=object)
                yield part

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema)
    return inputs.mapInPandas(run, f"{schema}, ids array<int>")
