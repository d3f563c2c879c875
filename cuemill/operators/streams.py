"""Folds over each track's rows in order, as a stream: a task holds what the fold carries, not the track."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = 65_536
_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def fold(rows: DataFrame, key: str, order: list[str], schema: str, make: Callable[[], Callable[[tuple | None], Iterator[tuple]]]) -> DataFrame:
    """``make`` gives, for each key, a function that takes its rows one by one (None behind the last) and yields result rows.

    The first column of ``rows`` is the key; results are rows of ``schema``.
    """
    arrow = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in schema.split(", ")])

    def packed(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        current, step = None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if step is None or row[0] != current:
                    if step:
                        out += step(None)
                    current, step = row[0], make()
                out += step(row)
                if len(out) >= ROWS:
                    yield packed(out)
                    out = []
        if step:
            out += step(None)
        yield packed(out)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(work, schema)
