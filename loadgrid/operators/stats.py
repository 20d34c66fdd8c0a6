"""Period statistics of load series.

Per period: the rows block (sum, mean, min, idxmin, max, idxmax, std, count of
the rows), from W on the daily block (day energy = day mean x the fullest day's
row count of the series, then seven statistics of it), for Q and Y the monthly
block (month sums, the same seven).

The rows are aggregated once, to days (for H to hours): count, sum, second
moment about the cell's mean, extremes and the earliest stamps of the
extremes, which a window over one cell's few rows marks so that typed min/max
stay hash aggregations. Everything else is derived from that small table:
moments merge exactly, and all blocks are one aggregation by period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, LoadConfig
from ..functions.naming import period_word, rows_group, stat_col
from ..functions.time import period_start
from .resample import to_hourly

SERIES = "series"
# Fixed values that must equal the original tool's column names.
ROW_STATS = ("sum", "mean", "min", "idxmin", "max", "idxmax", "std", "count")
BLOCK_STATS = ("mean", "min", "idxmin", "max", "idxmax", "std", "count")
DAILY = "Daily_Energy"
MONTHLY = "Monthly_Energy"


def _stat_exprs(value: Column, stamp: Column, group: str, stats: tuple[str, ...]) -> list[Column]:
    nn = value.isNotNull()
    out = []
    for s in stats:
        if s == "sum":
            e = F.coalesce(F.sum(value), F.lit(0.0))
        elif s == "mean":
            e = F.avg(value)
        elif s == "min":
            e = F.min(value)
        elif s == "max":
            e = F.max(value)
        elif s == "idxmin":
            e = F.min(F.when(nn, F.struct(value.alias("v"), stamp.alias("t"))))["t"]
        elif s == "idxmax":
            e = F.min(F.when(nn, F.struct((-value).alias("v"), stamp.alias("t"))))["t"]
        elif s == "std":
            e = F.stddev_samp(value)
        elif s == "count":
            e = F.count(value)
        else:
            raise ValueError(s)
        out.append(e.alias(stat_col(group, s)))
    return out


def cells(view: DataFrame, grain: str, ts: str = "DateTimeStart") -> DataFrame:
    """One row per series and day (or hour): ``n, s, m, m2, lo, t_lo, hi,
    t_hi`` of its rows. A cell holds a day's rows at most."""
    e, stamp = F.col("Energy"), F.col(ts)
    w = Window.partitionBy(SERIES, "cell")
    d = (view.select(SERIES, period_start(stamp, grain).alias("cell"), stamp.alias("__t"), "Energy")
             .withColumn("__lo", F.min("Energy").over(w)).withColumn("__hi", F.max("Energy").over(w)))
    return d.groupBy(SERIES, "cell").agg(
        F.count(e).alias("n"), F.sum(e).alias("s"), F.avg(e).alias("m"), (F.var_pop(e) * F.count(e)).alias("m2"),
        F.min(e).alias("lo"), F.min(F.when(e == F.col("__lo"), F.col("__t"))).alias("t_lo"),
        F.max(e).alias("hi"), F.min(F.when(e == F.col("__hi"), F.col("__t"))).alias("t_hi"))


def _rows_exprs(group: str) -> list[Column]:
    """The rows block from cells that carry their period's mean ``pm``."""
    n = F.sum("n")
    m2 = F.sum(F.when(F.col("n") > 0, F.col("m2") + F.col("n") * (F.col("m") - F.col("pm")) * (F.col("m") - F.col("pm"))))
    low = F.min(F.when(F.col("n") > 0, F.struct(F.col("lo").alias("v"), F.col("t_lo").alias("t"))))["t"]
    high = F.min(F.when(F.col("n") > 0, F.struct((-F.col("hi")).alias("v"), F.col("t_hi").alias("t"))))["t"]
    parts = {"sum": F.coalesce(F.sum("s"), F.lit(0.0)), "mean": F.sum("s") / n, "min": F.min("lo"), "idxmin": low,
             "max": F.max("hi"), "idxmax": high, "std": F.when(n > 1, F.sqrt(m2 / (n - 1))), "count": n}
    return [parts[k].alias(stat_col(group, k)) for k in ROW_STATS]


def energy_stats(view: DataFrame, period: str = "M", resolution: str = "H",
                 cfg: LoadConfig = DEFAULT) -> DataFrame:
    """Statistics of a (filtered, selected) view per ``(series, period)``.

    H, D -> rows block; W, M -> + daily block; Q, Y -> + daily + monthly.
    For H the rows block reads the view as is; everything else reads it
    converted to hourly rows.
    """
    period_word(period)
    grain = "H" if period == "H" else "D"
    # H reads the view as is, everything else the view as hourly rows
    d = cells(view if period == "H" else to_hourly(view, resolution, cfg.input_type), grain)
    d = d.withColumn("period_start", period_start(F.col("cell"), period))
    w = Window.partitionBy(SERIES, "period_start")
    d = d.withColumn("pm", F.sum("s").over(w) / F.sum("n").over(w))
    aggs = _rows_exprs(rows_group(period))
    if period in ("W", "M", "Q", "Y"):
        # day mean x the series' fullest day
        d = d.withColumn("day_energy", F.col("m") * F.max("n").over(Window.partitionBy(SERIES)))
        aggs += _stat_exprs(F.col("day_energy"), F.col("cell"), DAILY, BLOCK_STATS)
    if period in ("Q", "Y"):
        # a month's sum stands on its first day
        wm = Window.partitionBy(SERIES, "period_start", "month")
        d = d.withColumn("month", period_start(F.col("cell"), "M"))
        d = d.withColumn("month_energy", F.when(F.col("cell") == F.min("cell").over(wm),
                                                F.coalesce(F.sum("s").over(wm), F.lit(0.0))))
        aggs += _stat_exprs(F.col("month_energy"), F.col("month"), MONTHLY, BLOCK_STATS)
    return d.groupBy(SERIES, "period_start").agg(*aggs)


def stats_columns(period: str) -> list[str]:
    cols = [stat_col(rows_group(period), s) for s in ROW_STATS]
    if period in ("W", "M", "Q", "Y"):
        cols += [stat_col(DAILY, s) for s in BLOCK_STATS]
    if period in ("Q", "Y"):
        cols += [stat_col(MONTHLY, s) for s in BLOCK_STATS]
    return cols
