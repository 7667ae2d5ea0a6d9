"""What several corpus operators share: table access, staging, batch slicing and checked joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkline import session

#: Bytes of text that one vectorised step works on; a longer single text is worked on whole.
STEP_BYTES = 1 << 20
#: Rows up to which a key list counts as small enough to send to every task.
SMALL_LIST = 100_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``session.staged``; a session on one machine without a shared folder gets a temporary one."""
    session.on_one_machine(df.sparkSession)
    return session.staged(df, name)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column of a batch with nulls as empty texts."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.string()), "")


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, before + limit, side="right"))
        stop = max(stop, start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def only_ids(df: DataFrame, ids: DataFrame, key: str, rows: int) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (``rows`` of them, distinct).

    A list of at most ``SMALL_LIST`` keys is sent to every task, so that ``df``
    isn't shuffled; a longer one is joined by shuffle.
    """
    return df.join(F.broadcast(ids) if rows <= SMALL_LIST else ids, key, "left_semi")
