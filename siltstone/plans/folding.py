"""Folds over the rows of a key in order, in constant memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def ordered_fold(rows: DataFrame, by: str, order: str, added: dict[str, T.DataType], start: Callable[[], Any], step: Callable[[Any, Any], tuple[Any, tuple | None]]) -> DataFrame:
    """by, order and the added columns: step takes the state and the next value of order of a key, and gives the new state
    and the added values, or None to drop the row. Rows are shuffled by key and sorted, and pass through as a stream, so a
    key's rows never meet in memory, however many there are. Rows with a null key or order drop out."""
    out_schema = T.StructType([*rows.select(by, order).schema, *(T.StructField(n, t) for n, t in added.items())])
    arrow = {T.BooleanType: pa.bool_(), T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.StringType: pa.string()}
    kinds = [arrow[type(t)] for t in added.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keep, values = [], []
            for i, (k, x) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if k != key or state is None:
                    key, state = k, start()
                state, out = step(state, x)
                if out is not None:
                    keep.append(i)
                    values.append(out)
            took = pa.array(keep, pa.int64())
            cols = [batch.column(0).take(took), batch.column(1).take(took)] + [pa.array([v[j] for v in values], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, names=out_schema.names)

    placed = rows.select(by, order).where(rows[by].isNotNull() & rows[order].isNotNull()).repartition(by).sortWithinPartitions(by, order)
    return placed.mapInArrow(run, out_schema)
