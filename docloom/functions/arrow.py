"""Work of Python on executors, a few rows at a time: a batch may hold thousands of long texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of which Python objects are made at once.
ROWS = 128


def each(values: pa.Array, function: Callable[[Any], Any], kind: pa.DataType) -> pa.Array:
    """``function`` of every value."""
    parts = [pa.array([function(x) for x in values.slice(k, ROWS).to_pylist()], kind) for k in range(0, len(values), ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def map_rows(df: DataFrame, function: Callable[[list[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows of ``schema`` that ``function`` makes of rows of ``df``."""
    shape = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                rows = list(function(batch.slice(k, ROWS).to_pylist()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), shape, strict=True)], schema=shape)

    return df.mapInArrow(run, schema)
