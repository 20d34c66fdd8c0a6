"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import written

#: Rows and bytes of an Arrow batch handed to Python: a task holds no more texts at once.
ARROW_ROWS, ARROW_BYTES = 1024, 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators (idempotent)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def trim() -> None:
    """Hand freed memory of this worker back to the system."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass       # another C library: it trims by its own rules


def lean(fn):
    """``fn(batches)`` for ``mapInArrow``, in a worker that earlier tasks have
    used: what those left in reference cycles (each task unpickles its own
    modules) and in allocators goes back to the system before and after."""
    def run(batches):
        trim()
        yield from fn(batches)
        trim()
    return run


def lean_each(fn):
    """``fn(table)`` for ``applyInArrow``, likewise: a worker has one group after another."""
    def run(rows):
        trim()
        out = fn(rows)
        trim()
        return out
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read
    back: the lineage ends at files that every executor sees, so a lost
    executor costs no more than a reread."""
    return written(df, f"llm-{name}", compression)


def broadcast_below(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast if a count proves it has at most ``max_rows``
    rows (callers keep its rows narrow); beyond that the join stays a shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, for helper columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def keep(df: DataFrame, *without: str) -> list:
    """All columns of ``df`` but some."""
    gone = {c.lower() for c in without}
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in gone]


def texts_of(col: pa.Array) -> list[str]:
    return ["" if t is None else t for t in col.to_pylist()]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type)
              for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def longs(a: np.ndarray) -> pa.Array:
    """uint64 fingerprints as signed longs, bit for bit."""
    return pa.array(np.ascontiguousarray(a).view(np.int64))
