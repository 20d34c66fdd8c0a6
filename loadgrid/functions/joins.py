"""Small per-key side tables: broadcast behind a proof of their size.

Per-series side tables (sampling interval) are small in practice but their
size grows with the number of meters. Two proofs allow a broadcast:

* the plan's own statistics: a side table holds at most what it is made from,
  so a table made from at most ``LAZY_BYTES`` is broadcast as it is, and no job
  runs before the query;
* beyond that the table is written once as Parquet to the shared folder, and
  an observation of that write counts its rows and bytes. Within the bound the
  written table is broadcast, else the join stays a shuffle join (adaptive
  execution splits a hot key on the large side).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import checkpoint_dir


#: Bytes that a row of a broadcast side table may have on average.
ROW_BYTES = 64
#: A side table made from so few bytes needs no count.
LAZY_BYTES = 8 << 20


def plan_bytes(df: DataFrame) -> int:
    """Spark's estimate of a plan's result, from the sizes of its sources (no job)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def written(df: DataFrame, name: str = "side", compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back: a lost
    executor costs no more than a reread. Spark deletes the files when the
    driver ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/loadgrid/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, source: DataFrame, max_rows: int) -> DataFrame:
    """``df``, a small table made from ``source``, as the side of a join:
    marked for broadcast if its source is small by the plan's statistics, or
    if it has, written and counted, at most ``max_rows`` rows and ``max_rows *
    ROW_BYTES`` bytes."""
    if plan_bytes(source) <= min(LAZY_BYTES, max_rows * ROW_BYTES):
        return F.broadcast(df)
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) if t == "string" else F.lit(16)
                 for c, t in df.dtypes), F.lit(0))
    counted = Observation()
    out = written(df.observe(counted, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("size")))
    got = counted.get
    return F.broadcast(out) if got["n"] <= max_rows and got["size"] <= max_rows * ROW_BYTES else out
