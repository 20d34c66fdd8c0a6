"""Row selection: date range, business calendar, key lists, distinct keys, head."""

from __future__ import annotations

from collections.abc import Iterable
import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, LoadConfig
from ..functions.calendar import filter_business_days, filter_business_hours, inline_values

SERIES = "series"


def _as_date(d) -> dt.date:
    if isinstance(d, dt.datetime):
        return d.date()
    if isinstance(d, str):
        return dt.date.fromisoformat(d)
    return d


def range_bounds(start, end) -> tuple[dt.datetime, dt.datetime]:
    """``[start 01:00, end + 1 day 00:00]``, both inclusive (end-stamped hours)."""
    s, e = _as_date(start), _as_date(end)
    return (dt.datetime(s.year, s.month, s.day, 1, 0, 0),
            dt.datetime(e.year, e.month, e.day) + dt.timedelta(days=1))


def filter_range(df: DataFrame, start, end, ts: str = "DateTime") -> DataFrame:
    """Date-range filter on the END stamp. Written on the raw
    column with literal bounds so a stored load table gets it pushed into the
    Parquet scan."""
    lo, hi = range_bounds(start, end)
    c = F.col(ts)
    return df.where((c >= F.lit(lo).cast("timestamp_ntz")) & (c <= F.lit(hi).cast("timestamp_ntz")))


def select_rows(view: DataFrame, time_interval=None, bdays: int = 0, bhours: int = 0,
                holidays: DataFrame | None = None, cfg: LoadConfig = DEFAULT) -> DataFrame:
    """Range, then business days, then business hours (the original's order)."""
    out = view
    if time_interval is not None:
        out = filter_range(out, time_interval[0], time_interval[1])
    out = filter_business_days(out, bdays, holidays=holidays, weekmask=cfg.business_days)
    out = filter_business_hours(out, bhours, hours=cfg.business_hours)
    return out


def _as_datetime(v) -> dt.datetime:
    if isinstance(v, str):
        return dt.datetime.fromisoformat(v)
    if isinstance(v, dt.datetime):
        return v
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day)
    return v


#: Lists of up to so many keys are a literal predicate; longer ones a semi join.
MAX_LITERALS = 1000


def select_keys(df: DataFrame, key: str, values: Iterable, *, by_day: bool = False) -> DataFrame:
    """Rows whose ``key`` is in ``values``. With ``by_day`` the values are
    dates and every row of those days is kept (for hourly tables). A picked
    list is a predicate on the row, so nothing is shuffled, and a stored
    table's row groups are skipped by it; a list of more than ``MAX_LITERALS``
    keys is an inline relation of known size, and its bounds are the predicate."""
    dtype = T.DateType() if by_day else df.schema[key].dataType
    vals = list(values)
    if isinstance(dtype, T.DateType):
        vals = [_as_date(v) for v in vals]
    elif isinstance(dtype, (T.TimestampNTZType, T.TimestampType)):
        vals = [_as_datetime(v) for v in vals]
    raw = F.col(f"`{key}`")
    c = F.to_date(raw) if by_day else raw
    if not vals:
        return df.where(F.lit(False))
    if by_day and isinstance(df.schema[key].dataType, T.TimestampNTZType):
        # the days' bounds on the column itself reach the scan of a stored table, a day's truncation does not
        first, last = (_as_datetime(d) for d in (min(map(_as_date, vals)), max(map(_as_date, vals))))
        df = df.where((raw >= F.lit(first).cast("timestamp_ntz")) & (raw < F.lit(last + dt.timedelta(days=1)).cast("timestamp_ntz")))
    if len(vals) <= MAX_LITERALS:
        return df.where(c.isin([F.lit(v).cast(dtype) for v in vals]))
    if not by_day:
        df = df.where(raw.between(F.lit(min(vals)).cast(dtype), F.lit(max(vals)).cast(dtype)))
    return df.join(inline_values(df.sparkSession, vals, "__k", dtype), c == F.col("__k"), "left_semi")


def select_pairs(df: DataFrame, key1: str, values1: Iterable, key2: str, values2: Iterable, *,
                 by_day: bool = False) -> DataFrame:
    """Two-key tables (comparisons): rows with ``key1`` in the first list and
    ``key2`` in the second. The product of the lists is never built."""
    return select_keys(select_keys(df, key1, values1, by_day=by_day), key2, values2, by_day=by_day)


def distinct_keys(df: DataFrame, key: str, *, by_day: bool = False) -> DataFrame:
    """Distinct values of a key column (distinct days for hourly tables)."""
    c = F.to_date(F.col(key)) if by_day else F.col(key)
    return df.select(c.alias(key)).distinct()


def head(df: DataFrame, n: int = 5, order: str | list[str] = "DateTimeStart") -> DataFrame:
    """First ``n`` rows of every series in time order (a top-k per group,
    planned as a WindowGroupLimit that cuts rows before the shuffle)."""
    w = Window.partitionBy(SERIES).orderBy(*([order] if isinstance(order, str) else order))
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
