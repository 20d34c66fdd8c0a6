"""Business-calendar predicates (business days with holidays, business hours).

The holiday calendar is an input table with one ``date`` column (at most one
row per calendar day of the covered years). No broadcast is forced: a list
built with :func:`holidays_frame` is an inline relation whose size the planner
knows, so Catalyst broadcasts it under ``spark.sql.autoBroadcastJoinThreshold``
and the load is not shuffled; a stored calendar is judged by its file
statistics, and a large one falls back to a shuffle join.
"""

from __future__ import annotations

from collections.abc import Iterable
import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .time import seconds_of_day, weekday_mon0

HOLIDAY_SCHEMA = T.StructType([T.StructField("date", T.DateType(), False)])


def holidays_frame(spark: SparkSession, dates: Iterable) -> DataFrame:
    """Holiday table from Python dates or ISO strings."""
    rows = []
    for d in dates:
        if isinstance(d, str):
            d = dt.date.fromisoformat(d)
        elif isinstance(d, dt.datetime):
            d = d.date()
        rows.append(d)
    return inline_values(spark, rows, "date", HOLIDAY_SCHEMA["date"].dataType)


def inline_values(spark: SparkSession, values: list, name: str, dtype: T.DataType) -> DataFrame:
    """A one-column table of literals. Unlike a table made from a Python list
    through an RDD, its size is known to the planner, which broadcasts it."""
    if not values:
        return spark.createDataFrame([], T.StructType([T.StructField(name, dtype, False)]))
    kind = dtype.simpleString()
    texts = ", ".join("(CAST('" + str(v).replace("\\", "\\\\").replace("'", "\\'") + f"' AS {kind}))" for v in values)
    return spark.sql(f"SELECT * FROM VALUES {texts} AS t(`{name}`)")


def in_weekmask(c, weekmask: Iterable[int]) -> Column:
    return weekday_mon0(c).isin(list(weekmask))


def business_hours_pred(c, hours: tuple[int, int]) -> Column:
    """Mon-Fri and time of day within ``[start, end - 1h]``, both ends
    inclusive; holidays and the weekday mask are not consulted (SURVEY Q6)."""
    start, end = hours
    sod = seconds_of_day(c)
    return (weekday_mon0(c) < 5) & sod.between(start * 3600, (end - 1) * 3600)


def _with_holiday_flag(df: DataFrame, ts: str, holidays: DataFrame | None) -> DataFrame:
    if holidays is None:
        return df.withColumn("__hol", F.lit(False))
    h = holidays.select(F.col("date").alias("__hday")).distinct().withColumn("__hol", F.lit(True))
    return (df.join(h, F.to_date(F.col(ts)) == F.col("__hday"), "left")
              .drop("__hday")
              .withColumn("__hol", F.coalesce(F.col("__hol"), F.lit(False))))


def filter_business_days(df: DataFrame, mode: int, ts: str = "DateTimeStart",
                         holidays: DataFrame | None = None,
                         weekmask: Iterable[int] = (0, 1, 2, 3, 4)) -> DataFrame:
    """``mode`` 0: all rows, 1: business days only, 2: non-business days only.

    A business day is a weekday in the mask that is not a holiday; the test is
    on the date of ``ts`` (any time of day)."""
    if mode == 0:
        return df
    if mode not in (1, 2):
        raise ValueError(f"business-day mode must be 0, 1 or 2, got {mode!r}")
    mask = in_weekmask(F.col(ts), weekmask)
    if mode == 1:
        out = df.where(mask)
        if holidays is not None:
            h = holidays.select(F.col("date").alias("__hday")).distinct()
            out = out.join(h, F.to_date(F.col(ts)) == F.col("__hday"), "left_anti")
        return out
    flagged = _with_holiday_flag(df, ts, holidays)
    return flagged.where(~(mask & ~F.col("__hol"))).drop("__hol")


def filter_business_hours(df: DataFrame, mode: int, ts: str = "DateTimeStart",
                          hours: tuple[int, int] = (8, 16)) -> DataFrame:
    """``mode`` 0: all rows, 1: business hours only, 2: outside business hours."""
    if mode == 0:
        return df
    if mode == 1:
        return df.where(business_hours_pred(F.col(ts), hours))
    if mode == 2:
        return df.where(~business_hours_pred(F.col(ts), hours))
    raise ValueError(f"business-hour mode must be 0, 1 or 2, got {mode!r}")
