"""Gap filling of a series by row position: linear interpolation, forward and
back fill.

A per-series window over the whole history would put one meter in one task;
a meter holding a third of all rows would then be a third of the job in one
task. The fill is therefore done in two levels:

1. windows partitioned by ``(series, block)`` (block = day by default) find,
   for every row, its position in the block and the nearest non-missing value
   before / after it inside the block;
2. a small per-block summary (row count, first and last non-missing value with
   its position) is windowed per series to get each block's row offset and the
   nearest non-missing values in earlier / later blocks;
3. the summary is joined back on ``(series, block)``. Both steps read the same
   exchange by ``(series, block)``, whose shuffle files adaptive execution
   writes once and reads twice; nothing is cached or written besides, and the
   join finds its large side partitioned already.

Interpolation follows the original: linear in the row position (not in time),
leading gaps stay missing, trailing gaps take the last value.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import col_, ntz

SERIES = "series"
_BLOCK = ["__key", "__blk"]
_UNB = Window.unboundedPreceding
_UNF = Window.unboundedFollowing


def _desc(order: list[str]) -> list:
    return [F.col(c).desc_nulls_last() for c in order]


def _neighbours(df: DataFrame, ts: str, value: str, order: list[str], block: str) -> DataFrame:
    """Per row: position in its block and the nearest non-missing value (with
    its position) before and after it inside the block. Both directions use
    running frames (UNBOUNDED PRECEDING .. CURRENT ROW), the "after" one over
    the reversed order: Spark evaluates a running frame incrementally, whereas
    a CURRENT ROW .. UNBOUNDED FOLLOWING frame is re-aggregated per row."""
    v = F.col(value)
    # never null, else the join's null test would go into one of the two plans only and part their exchanges
    key = F.coalesce(F.concat(F.lit("="), F.col(SERIES)), F.lit(""))
    blk = F.coalesce(ntz(F.date_trunc(block, col_(ts))), F.lit(dt.datetime(1, 1, 1)).cast("timestamp_ntz"))
    fwd = Window.partitionBy(*_BLOCK).orderBy(*order)
    rev = Window.partitionBy(*_BLOCK).orderBy(*_desc(order))
    d = df.withColumn("__key", key).withColumn("__blk", blk).repartition(*_BLOCK).withColumn("__pos", F.row_number().over(fwd))
    run_f = fwd.rowsBetween(_UNB, Window.currentRow)
    run_r = rev.rowsBetween(_UNB, Window.currentRow)
    nn_pos = F.when(v.isNotNull(), F.col("__pos"))
    return (d.withColumn("__pv", F.last(v, True).over(run_f))
             .withColumn("__pp", F.last(nn_pos, True).over(run_f))
             .withColumn("__nv", F.last(v, True).over(run_r))
             .withColumn("__np", F.last(nn_pos, True).over(run_r))
             .withColumn("__rpos", F.row_number().over(rev)))


def _block_summary(d: DataFrame, rest: list[str]) -> DataFrame:
    """Per block: rows, and the first and last non-missing value with their
    positions, which the running windows hold at the block's ends. ``rest``: the columns that only the
    other plan needs; their hash is never null and keeps them here. Typed max over at most two rows of a block: a hash aggregation."""
    at_start, at_end = F.col("__pos") == 1, F.col("__rpos") == 1
    same = F.max(F.hash(*[F.col(f"`{c}`") for c in rest])).alias("__rest")
    s = d.where(at_start | at_end).groupBy(*_BLOCK).agg(
        same, F.max("__pos").alias("__n"), F.max(F.when(at_end, F.col("__pp"))).alias("__lp"),
        F.max(F.when(at_end, F.col("__pv"))).alias("__lv"), F.max(F.when(at_start, F.col("__np"))).alias("__fp"),
        F.max(F.when(at_start, F.col("__nv"))).alias("__fv"))
    s = (s.withColumn("__last", F.when(F.col("__lp").isNotNull(), F.struct(F.col("__lp").alias("p"), F.col("__lv").alias("v"))))
          .withColumn("__first", F.when(F.col("__fp").isNotNull(), F.struct(F.col("__fp").alias("p"), F.col("__fv").alias("v")))))
    ws = Window.partitionBy("__key").orderBy("__blk")
    wr = Window.partitionBy("__key").orderBy(F.col("__blk").desc())
    s = s.withColumn("__off", F.coalesce(F.sum("__n").over(ws.rowsBetween(_UNB, -1)), F.lit(0)).cast("long"))
    glob_last = F.when(F.col("__last").isNotNull(),
                       F.struct((F.col("__off") + F.col("__last.p")).alias("p"), F.col("__last.v").alias("v")))
    glob_first = F.when(F.col("__first").isNotNull(),
                        F.struct((F.col("__off") + F.col("__first.p")).alias("p"), F.col("__first.v").alias("v")))
    s = (s.withColumn("__gl", glob_last).withColumn("__gf", glob_first)
          .withColumn("__cp", F.last("__gl", True).over(ws.rowsBetween(_UNB, -1)))
          .withColumn("__cn", F.last("__gf", True).over(wr.rowsBetween(_UNB, -1))))
    return s.where(F.col("__rest").isNotNull()).select(*_BLOCK, "__off", "__cp", "__cn")


def fill_gaps(df: DataFrame, ts: str = "t", value: str = "Energy", *, interpolate: bool = False,
              ffill: bool = False, bfill: bool = False, order: list[str] | None = None,
              block: str = "day") -> DataFrame:
    """Fill missing ``value`` per series in the order of ``order`` (default
    ``[ts]``). Steps apply in the original's order: interpolate, then forward
    fill, then back fill."""
    order = [ts] + [c for c in (order or []) if c != ts]
    cols = df.columns
    rest = [c for c in cols if c not in (value, *order)]
    d = _neighbours(df, ts, value, order, block)
    # the other columns stay in the summary's plan, so that both plans have the same exchange
    s = _block_summary(d, rest)
    j = d.join(s, _BLOCK, "left")
    v = F.col(value)
    gpos = F.col("__off") + F.col("__pos")
    in_prev = F.col("__pv").isNotNull()
    in_next = F.col("__nv").isNotNull()
    prev_v = F.when(in_prev, F.col("__pv")).otherwise(F.col("__cp.v"))
    prev_p = F.when(in_prev, F.col("__off") + F.col("__pp")).otherwise(F.col("__cp.p"))
    next_v = F.when(in_next, F.col("__nv")).otherwise(F.col("__cn.v"))
    next_p = F.when(in_next, F.col("__off") + F.col("__np")).otherwise(F.col("__cn.p"))
    out = v
    if interpolate:
        # try_divide: the branch is only taken for a missing value between two
        # readings (denominator >= 2), but Spark may evaluate it for every row
        lin = prev_v + F.try_divide((next_v - prev_v) * (gpos - prev_p).cast("double"),
                                    (next_p - prev_p).cast("double"))
        out = (F.when(v.isNotNull(), v)
                .when(prev_v.isNull(), F.lit(None).cast("double"))
                .when(next_v.isNull(), prev_v)
                .otherwise(lin))
    if ffill:
        out = F.coalesce(out, prev_v)
    if bfill:
        out = F.coalesce(out, next_v)
    return j.withColumn(value, out).select(*cols)


def interpolate_linear(df: DataFrame, ts: str = "t", value: str = "Energy", **kw) -> DataFrame:
    return fill_gaps(df, ts, value, interpolate=True, **kw)


def forward_fill(df: DataFrame, ts: str = "t", value: str = "Energy", **kw) -> DataFrame:
    return fill_gaps(df, ts, value, ffill=True, **kw)


def back_fill(df: DataFrame, ts: str = "t", value: str = "Energy", **kw) -> DataFrame:
    return fill_gaps(df, ts, value, bfill=True, **kw)
