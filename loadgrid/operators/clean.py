"""Cleaning of raw readings: sampling interval, stamp shift, zeros, filtered view.

Raw readings are a long table ``series, DateTime, Energy`` (plus optional
tie-break columns that fix the order of equal stamps).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import small_side
from ..functions.time import seconds_between, shift_seconds

SERIES = "series"


def interval_table(readings: DataFrame, ts: str = "DateTime", max_rows: int = 500_000) -> DataFrame:
    """Sampling interval of every series from its first two readings (the two
    earliest stamps; equal stamps give a zero interval).

    Returns ``series, delta_seconds, interval_hours, interval_minutes,
    shift_seconds``. Like the original, only the hours and minutes of the
    time-of-day part count (whole days are dropped), so a daily or coarser
    series has shift 0. A one-row series has no interval (shift 0).

    Two hash aggregations of two columns and no sort: the earliest stamp per
    series, then -- joined back, see ``functions.joins`` -- the number of rows
    at it and the earliest later stamp. (One aggregation can't do both: the
    second row may share the first one's stamp, and a two-column minimum would
    be a sort.) The result belongs to the readings it was made from; callers
    that load the same meters again keep it and pass it to :func:`with_shift`.
    """
    r = readings.select(SERIES, F.col(ts).alias("__ts")).where(F.col("__ts").isNotNull())
    first = small_side(r.groupBy(SERIES).agg(F.min("__ts").alias("__t1")), r, max_rows)
    g = (r.join(first, SERIES, "inner")
          .groupBy(SERIES, "__t1")
          .agg(F.count_if(F.col("__ts") == F.col("__t1")).alias("__n1"),
               F.min(F.when(F.col("__ts") > F.col("__t1"), F.col("__ts"))).alias("__gt")))
    t2 = F.when(F.col("__n1") >= 2, F.col("__t1")).otherwise(F.col("__gt"))
    delta = seconds_between(F.col("__t1"), t2)
    sod = F.pmod(delta, F.lit(86400))
    hours = F.floor(sod / 3600).cast("int")
    minutes = F.pmod(F.floor(sod / 60), F.lit(60)).cast("int")
    return g.select(
        SERIES,
        delta.alias("delta_seconds"),
        F.coalesce(hours, F.lit(0)).alias("interval_hours"),
        F.coalesce(minutes, F.lit(0)).alias("interval_minutes"),
        F.coalesce(hours * 3600 + minutes * 60, F.lit(0)).cast("long").alias("shift_seconds"))


def with_shift(readings: DataFrame, intervals: DataFrame | None = None, max_rows: int = 500_000,
               ts: str = "DateTime") -> DataFrame:
    """Attach ``shift_seconds`` of each series, from ``intervals`` or inferred
    from the readings. For small readings (by the plan's statistics) this is
    one lazy plan; else the per-series table is written once (a lost executor
    rereads it) and broadcast if its count allows it, else joined by a
    shuffle. A meter without an entry is an error, not a meter without shift."""
    own = intervals is None
    table = (interval_table(readings, ts, max_rows) if own else intervals).select(SERIES, "shift_seconds")
    side = small_side(table, readings.select(SERIES, ts) if own else intervals, max_rows)
    missing = F.raise_error(F.concat(F.lit("no sampling interval is known for meter "), F.col(SERIES))).cast("long")
    return readings.join(side, SERIES, "left").withColumn("shift_seconds", F.coalesce(F.col("shift_seconds"), missing))


def shift_to_start(df: DataFrame, ts: str = "DateTime", out: str = "t") -> DataFrame:
    """End-stamped readings -> interval start: ``ts - shift_seconds``."""
    return df.withColumn(out, shift_seconds(ts, -F.col("shift_seconds")))


def zero_to_null(df: DataFrame, value: str = "Energy") -> DataFrame:
    """A reading of exactly 0 counts as missing."""
    return df.withColumn(value, F.nullif(F.col(value), F.lit(0.0)))


def nan_to_null(df: DataFrame, value: str = "Energy") -> DataFrame:
    """Missing values are NULL in this library, never NaN."""
    v = F.col(value).cast("double")
    return df.withColumn(value, F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v))


def filtered_view(df: DataFrame, drop_zeros: bool = False, value: str = "Energy") -> DataFrame:
    """Rows with a reading (and, optionally, a non-zero one)."""
    out = df.where(F.col(value).isNotNull())
    if drop_zeros:
        out = out.where(F.col(value) != 0)
    return out
