"""Typical-day profiles: per hour of day, statistics over the complete days of
a period.

Only days with 24 hourly rows count. The hourly rows are exchanged once, by
series and group; the count windows by day, the windows by hour that mark the
extremes, and the hash aggregation by hour all find them there. A group has at
most its period's hours, the whole-range profile a meter's hours, whatever the
raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, LoadConfig
from ..functions.time import period_start
from .resample import to_hourly

SERIES = "series"
PROFILE_STATS = ("mean", "min", "idxmin", "max", "idxmax")

# Fixed values that must equal the original tool's keys: period -> grouping keys before ``hour``.
GROUP_KEYS = {
    "Q": ("year", "quarter"),
    "M": ("year", "month"),
    "W": ("year", "month", "week"),
    "no_period": (),
}


class PeriodNotSupported(ValueError):
    """The typical day has no meaning for this period."""


def _key_expr(k: str, ts):
    return {"year": F.year(ts), "quarter": F.quarter(ts), "month": F.month(ts),
            "week": F.weekofyear(ts), "hour": F.hour(ts)}[k].cast("int").alias(k)


def complete_days(hourly: DataFrame, ts: str = "DateTimeStart", hours: int = 24, within: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the days that have ``hours`` rows with a reading and a stamp.
    The day key is a column so both counts share one window (one shuffle);
    ``within`` names columns that are the same for all rows of a day."""
    w = Window.partitionBy(SERIES, *within, "__day")
    return (hourly.withColumn("__day", period_start(F.col(ts), "D"))
                  .withColumn("__ne", F.count("Energy").over(w))
                  .withColumn("__nt", F.count("DateTime").over(w))
                  .where((F.col("__ne") == hours) & (F.col("__nt") == hours))
                  .drop("__day", "__ne", "__nt"))


def typical_day(view: DataFrame, period: str = "M", resolution: str = "H",
                cfg: LoadConfig = DEFAULT) -> DataFrame:
    """Profile of every series: ``series, <period keys>, hour, first_day,
    Energy__mean, Energy__min, Energy__idxmin, Energy__max, Energy__idxmax``.
    ``first_day``, the earliest day of the group, orders the groups in time.

    ``period``: ``Q`` (year, quarter), ``M`` (year, month), ``W`` (calendar
    year, month, ISO week) or ``no_period`` (hour only). ``H``/``D`` have no
    typical day and ``Y`` is not supported, as in the original.
    """
    if period in ("H", "D"):
        raise PeriodNotSupported(f"a typical day of period {period!r} has no meaning")
    if period not in GROUP_KEYS:
        raise PeriodNotSupported(f"typical days are kept by {sorted(GROUP_KEYS)}, not by {period!r}")
    ts, e = F.col("DateTimeStart"), F.col("Energy")
    group = GROUP_KEYS[period]
    hourly = to_hourly(view, resolution, cfg.input_type).select(SERIES, "DateTimeStart", "DateTime", "Energy", *[_key_expr(k, ts) for k in (*group, "hour")])
    days = complete_days(hourly.repartition(SERIES, *group), within=group)
    w = Window.partitionBy(SERIES, *group, "hour")
    marked = days.withColumn("__lo", F.min("Energy").over(w)).withColumn("__hi", F.max("Energy").over(w))
    return marked.groupBy(SERIES, *group, "hour").agg(
        F.min(F.to_date(ts)).alias("first_day"),
        F.avg(e).alias("Energy__mean"),
        F.min(e).alias("Energy__min"),
        F.min(F.when(e == F.col("__lo"), ts)).alias("Energy__idxmin"),
        F.max(e).alias("Energy__max"),
        F.min(F.when(e == F.col("__hi"), ts)).alias("Energy__idxmax"))
