"""Folds over ordered groups that no window can express: rows stream through Python, and a fold holds its own state alone."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that a fold hands on at once, and the types they have then.
ROWS = 10_000
PANDAS = {"int": "Int32", "bigint": "Int64", "long": "Int64", "double": "float64", "boolean": "boolean"}


def folded(rows: DataFrame, fold: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, columns: list[str], order: list[str], groups: int = 1) -> DataFrame:
    """What fold makes of the rows of each partition, as tuples of columns.

    Rows are dealt by the first `groups` columns, so a group is whole in its partition, and sorted by order, which begins with them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)

        found = fold(each())
        while out := list(itertools.islice(found, ROWS)):
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names, dtype=object).astype(kinds), preserve_index=False)

    fields = [x.rsplit(" ", 1) for x in schema.split(", ")]
    names, kinds = [n for n, _ in fields], {n: PANDAS.get(k, "object") for n, k in fields}
    return rows.select(*columns).repartition(*columns[:groups]).sortWithinPartitions(*order).mapInArrow(run, schema)
