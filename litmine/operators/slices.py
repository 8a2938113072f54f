"""Python over rows of texts, a few at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of rows that a worker holds as Python objects at once, about, with what it makes of them.
SLICE_BYTES = 1 << 20


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about SLICE_BYTES, of one row at least."""
    n = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
    for start in range(0, batch.num_rows, n):
        yield batch.slice(start, n)


def map_in_slices(rows: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``rows.mapInPandas(function, schema)``, but in slices: a whole batch, of 10,000 rows by Spark's default, stays
    in Arrow's memory, and what is made of it leaves the worker slice by slice."""
    made = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (part.to_pandas(integer_object_nulls=True) for batch in batches for part in sliced(batch))
        for out in function(parts):
            yield pa.RecordBatch.from_pandas(out, schema=made, preserve_index=False)

    return rows.mapInArrow(run, schema)
