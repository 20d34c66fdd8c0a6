"""Resampling of a long series table onto a regular grid.

One aggregation per ``(series, bin)`` (partial aggregation before the shuffle)
followed by gap filling without a second scan: a window per series over the
*aggregated* bins finds the next existing bin, and ``explode(sequence(..))``
emits the bin itself plus the empty bins up to the next one (in two steps,
days then bins, for hourly and minute grids). A series has at
most (time span / bin width) aggregated rows whatever its raw row count, so
the per-series window cannot be skewed by a hot meter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import add_step, ntz, parse_resolution, period_label, period_start, shift_seconds, step_sql

SERIES = "series"


def _bin_energy(how: str, null_sum: str, first: Column, n_rows: Column, n_val: Column,
                s: Column, m: Column) -> Column:
    """Energy of a bin. Empty bins: 0 for a sum, missing for a mean. A bin
    whose readings are all missing: 0 under ``skip`` (pandas semantics), missing
    under ``propagate``; any missing reading makes a propagated sum missing."""
    zero = F.lit(0.0)
    if how == "mean":
        return F.when(first, m)
    if null_sum == "propagate":
        return F.when(~first, zero).when(n_val == n_rows, F.coalesce(s, zero))
    return F.when(first, F.coalesce(s, zero)).otherwise(zero)


def resample_bins(df: DataFrame, period: str, *, ts: str = "t", value: str = "Energy",
                  how: str = "sum", null_sum: str = "skip", carry: list[str] | None = None,
                  extra_aggs: dict[str, Column] | None = None, gap_fill: bool = True) -> DataFrame:
    """Aggregate ``value`` per ``(series, *carry, bin)`` and fill empty bins.

    Returns ``series, *carry, bin, Energy, n_rows`` plus ``extra_aggs`` (NULL on
    filled bins). ``carry`` columns must be constant per series (e.g. the
    series' shift), they ride along as grouping keys.
    """
    carry = list(carry or [])
    extra_aggs = dict(extra_aggs or {})
    keys = [SERIES, *carry]
    b = period_start(F.col(ts), period).alias("bin")
    v = F.col(value)
    agg = df.groupBy(*keys, b).agg(
        F.count(F.lit(1)).alias("__nr"), F.count(v).alias("__nv"),
        F.sum(v).alias("__s"), F.avg(v).alias("__m"),
        *[e.alias(k) for k, e in extra_aggs.items()])
    if gap_fill:
        w = Window.partitionBy(*keys).orderBy("bin")
        last_b = F.coalesce(add_step(F.lead("bin").over(w), period, -1), F.col("bin"))
        agg = agg.withColumn("__lb", last_b)
        rest = ["__nr", "__nv", "__s", "__m", *extra_aggs.keys()]
        if parse_resolution(period)[0] in ("H", "min"):   # days first, then the bins of a day: no array is longer than a day's bins or the days of a gap
            begin = ntz(F.date_trunc("day", F.col("bin")))
            days = agg.select(*keys, "bin", "__lb", *rest, F.explode(
                F.sequence(begin, F.col("__lb"), F.expr("INTERVAL 1 DAY"))).alias("__day"))
            end = F.least("__lb", add_step(F.timestamp_add("DAY", F.lit(1), F.col("__day")), period, -1))
            exploded = days.select(*keys, "bin", *rest, F.explode(F.sequence(
                F.greatest("bin", "__day"), end, F.expr(step_sql(period)))).alias("__bin"))
        else:
            exploded = agg.select(*keys, "bin", *rest, F.explode(F.sequence(
                F.col("bin"), F.col("__lb"), F.expr(step_sql(period)))).alias("__bin"))
        first = F.col("__bin") == F.col("bin")
        out = exploded.select(
            *keys, F.col("__bin").alias("bin"),
            _bin_energy(how, null_sum, first, F.col("__nr"), F.col("__nv"), F.col("__s"), F.col("__m")).alias(value),
            F.when(first, F.col("__nr")).otherwise(F.lit(0)).alias("n_rows"),
            *[F.when(first, F.col(k)).alias(k) for k in extra_aggs])
        return out
    first = F.lit(True)
    return agg.select(*keys, "bin",
                      _bin_energy(how, null_sum, first, F.col("__nr"), F.col("__nv"), F.col("__s"),
                                  F.col("__m")).alias(value),
                      F.col("__nr").alias("n_rows"), *extra_aggs.keys())


def stamp_columns(binned: DataFrame, period: str, *, end_stamped: bool = True,
                  shift_col: str | None = "shift_seconds", value: str = "Energy") -> DataFrame:
    """``DateTimeStart`` = bin label; ``DateTime`` = label + 1h for ``H``,
    + 0 for D/W/M/Q/Y and + the series' sampling interval for a minute grid
    (only for end-stamped input; otherwise ``DateTime`` = ``DateTimeStart``)."""
    kind, _ = parse_resolution(period)
    label = period_label(F.col("bin"), period)
    if not end_stamped:
        end = label
    elif kind == "H":
        end = shift_seconds(label, 3600)
    elif kind == "min":
        end = shift_seconds(label, F.col(shift_col)) if shift_col else label
    else:
        end = label
    return binned.select(SERIES, label.alias("DateTimeStart"), end.alias("DateTime"), value)


def to_hourly(view: DataFrame, resolution: str, input_type: str = "energy", value: str = "Energy") -> DataFrame:
    """Sub-hourly rows -> hourly rows (sum for energy, mean for power; last
    ``DateTime`` of the hour). Only hours that have rows come out: the input is
    a filtered view, and an hour the filter removed is not an hour of zero.
    Hourly and coarser tables pass unchanged, so the common case costs no
    shuffle. The original guards this with a test that is never true; we
    build the stated intent (SURVEY Q4)."""
    kind, n = parse_resolution(resolution)
    if kind != "min":
        return view
    how = "mean" if input_type == "power" else "sum"
    binned = resample_bins(view, "H", ts="DateTimeStart", value=value, how=how, null_sum="skip",
                           extra_aggs={"DateTime": F.max("DateTime")}, gap_fill=False)
    return binned.select(SERIES, F.col("bin").alias("DateTimeStart"), "DateTime", value)


def resample_loaded(load: DataFrame, period: str, *, resolution: str | None = None, input_type: str = "energy",
                    max_rows: int = 500_000) -> DataFrame:
    """Re-sample an already loaded series table (the original's ``resample``).

    The stamps are shifted back by the load's interval and the bins are summed
    null-propagating (mean for power); ``DateTime`` = label + 1h / + 0 /
    + interval. A loaded table's grid is known: with its ``resolution`` the
    interval is an hour, N minutes, or 0 for days and coarser (SURVEY Q3), and
    the load runs once. Only without it is the interval inferred again from
    the first two stamps of each series.
    """
    from .clean import with_shift

    value_col = "Energy"
    if resolution is None:
        d = with_shift(load.select(SERIES, "DateTime", value_col), None, max_rows)
    else:
        kind, n = parse_resolution(resolution)
        seconds = {"H": 3600, "min": 60 * n}.get(kind, 0)
        d = load.select(SERIES, "DateTime", value_col, F.lit(seconds).cast("long").alias("shift_seconds"))
    d = d.withColumn("t", shift_seconds("DateTime", -F.col("shift_seconds")))
    how = "mean" if input_type == "power" else "sum"
    binned = resample_bins(d, period, ts="t", value=value_col, how=how, null_sum="propagate",
                           carry=["shift_seconds"])
    return stamp_columns(binned, period, end_stamped=True)


def series_extent(load: DataFrame) -> DataFrame:
    """First and last day of every series (``min(DateTimeStart) + 1h`` as the
    first day, as the original does for end-stamped hourly data)."""
    return load.groupBy(SERIES).agg(
        F.to_date(shift_seconds(F.min("DateTimeStart"), 3600)).alias("min_day"),
        F.to_date(F.max("DateTimeStart")).alias("max_day"))


def extent_of(load: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Common extent of several series: earliest first day, latest last day."""
    e = series_extent(load if names is None else load.where(F.col(SERIES).isin(names)))
    return e.agg(F.min("min_day").alias("min_day"), F.max("max_day").alias("max_day"))
