"""Small helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows of text that go to a Python worker at once; it bounds a worker's memory when texts are long.
BATCH_ROWS = 512


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches of at most :data:`BATCH_ROWS` rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(f, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's strings; a null is the empty string."""
    return ["" if x is None else x for x in batch.column(column).to_pylist()]
