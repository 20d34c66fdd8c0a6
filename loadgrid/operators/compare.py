"""Pairwise comparison of statistics, distributions and typical days.

Every pairing here is one-to-one: a row meets at most one partner, found by an
integer period key: in the rows of one table by a window whose RANGE frame is
that key alone (a missing period gives no partner), in two tables by an
equi-join. Nothing is written on the way. Pairing every
period with every other period (the original's "outer" and self comparisons)
would emit all pairs, which this library does not do; instead a comparison
names its partner: the same period (``inner``), the period ``offset`` steps
earlier (``shifted``), or the same calendar slot ``offset`` cycles earlier
(``aligned``). Running several offsets reaches any pair exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as MX
from ..functions.naming import rows_group, stat_col
from ..functions.time import period_ordinal
from .typical_day import GROUP_KEYS, PeriodNotSupported

SERIES = "series"


def _suffixed(df: DataFrame, sfx: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(f"{c}{sfx}") for c in df.columns])


def _day_ord(c: Column) -> Column:
    return F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")


def _pair_keys(period: str, how: str, offset: int, ps: Column, left: bool) -> list[Column]:
    """Integer join keys; the left side's keys are moved back by ``offset``."""
    k = offset if left else 0
    if how == "inner":
        return [period_ordinal(ps, period)]
    if how == "shifted":
        return [period_ordinal(ps, period) - F.lit(k)]
    if how != "aligned":
        raise ValueError(f"unknown comparison {how!r}")
    if period == "H":      # same hour of day, `offset` days earlier
        return [_day_ord(ps) - F.lit(k), F.hour(ps).cast("long")]
    if period == "D":      # same day of month, `offset` months earlier
        return [(F.year(ps) * 12 + F.month(ps)).cast("long") - F.lit(k), F.dayofmonth(ps).cast("long")]
    if period == "W":      # same ISO week number, `offset` ISO years earlier
        return [F.extract(F.lit("YEAROFWEEK"), ps).cast("long") - F.lit(k), F.weekofyear(ps).cast("long")]
    if period == "M":      # same month, `offset` years earlier
        return [F.year(ps).cast("long") - F.lit(k), F.month(ps).cast("long")]
    if period == "Q":      # same quarter, `offset` years earlier
        return [F.year(ps).cast("long") - F.lit(k), F.quarter(ps).cast("long")]
    # Y: "same year, other period" never holds
    return [F.year(ps).cast("long")]


# Fixed values that must equal the original tool's output: the names of the difference and percent columns.
def _stats_metrics(period: str, mode: str) -> list[Column]:
    R = rows_group(period)

    def c(group, stat, side):
        return F.col(f"`{stat_col(group, stat)}_{side}`")

    def pair(group, stat):
        return c(group, stat, 1), c(group, stat, 2)

    D, Mo = "Daily_Energy", "Monthly_Energy"
    cons = mode == "consistent"
    pct = MX.pct_consistent
    if period in ("H", "D"):
        (sa, sb), (ma, mb) = pair(R, "sum"), pair(R, "mean")
        p = pct if cons else MX.pct_of_b
        return [MX.diff(sa, sb).alias("first_data_sum_minus_second_data_sum"),
                p(sa, sb).alias("percent_difference_sum_energy_consumption"),
                MX.diff(ma, mb).alias("first_data_mean_minus_second_data_mean"),
                p(ma, mb).alias("percent_difference_mean_power")]
    if period in ("W", "M"):
        (sa, sb), (ma, mb), (da, db) = pair(R, "sum"), pair(R, "mean"), pair(D, "mean")
        p = pct if cons else MX.pct_of_b
        return [MX.diff(sa, sb).alias("first_data_monthly_sum_minus_second_data_monthly_sum"),
                p(sa, sb).alias("percent_difference_monthly_sum_energy_consumption"),
                MX.diff(ma, mb).alias("first_data_hourly_mean_minus_second_data_hourly_mean"),
                p(ma, mb).alias("percent_difference_hourly_mean_power"),
                MX.diff(da, db).alias("first_data_daily_mean_consumption_minus_second_data_mean_daily_consumption"),
                p(da, db).alias("percent_difference_mean_daily")]
    # Q, Y. Reference mode, as the original computes it: sums and hourly means
    # divide by the first value; the columns named "daily" read the monthly
    # block and divide by the first value, the columns named "monthly" read the
    # daily block and divide by the second value.
    (sa, sb), (ma, mb) = pair(R, "sum"), pair(R, "mean")
    (da, db), (moa, mob) = pair(D, "mean"), pair(Mo, "mean")
    if cons:
        daily = (da, db, pct)
        monthly = (moa, mob, pct)
        p_sum = p_mean = pct
    else:
        daily = (moa, mob, MX.pct_of_a_first)
        monthly = (da, db, MX.pct_of_b_first)
        p_sum = p_mean = MX.pct_of_a_first
    return [MX.diff(sa, sb).alias("first_data_sum_minus_second_data_sum"),
            p_sum(sa, sb).alias("percent_difference_sum_energy_consumption"),
            MX.diff(ma, mb).alias("first_data_hourly_mean_minus_second_data_hourly_mean"),
            p_mean(ma, mb).alias("percent_difference_hourly_mean_power"),
            MX.diff(daily[0], daily[1]).alias(
                "first_data_daily_mean_consumption_minus_second_data_mean_daily_consumption"),
            daily[2](daily[0], daily[1]).alias("percent_difference_mean_daily"),
            MX.diff(monthly[0], monthly[1]).alias(
                "first_data_monthly_mean_consumption_minus_second_data_mean_monthly_consumption"),
            monthly[2](monthly[0], monthly[1]).alias("percent_difference_mean_monthly")]


def _partners(table: DataFrame, keys: list[Column], offset: int) -> DataFrame:
    """Every row of a table (one row per series and period) beside the row of
    its series ``offset`` steps of the first key earlier, with the other keys
    equal: columns ``<c>_1`` and ``<c>_2``. A window holds one meter's rows."""
    names = [f"__k{i}" for i in range(len(keys))]
    d = table.select("*", *[k.alias(n) for k, n in zip(keys, names)])
    w = Window.partitionBy(SERIES, *names[1:]).orderBy(names[0]).rangeBetween(-offset, -offset)
    y = F.first(F.struct(*[F.col(f"`{c}`") for c in table.columns])).over(w)
    return d.withColumn("__y", y).where(F.col("__y").isNotNull()).select(
        *[F.col(f"`{c}`").alias(f"{c}_1") for c in table.columns], *[F.col("__y").getField(c).alias(f"{c}_2") for c in table.columns])


def compare_stats(left: DataFrame, right: DataFrame, period: str, how: str = "inner", offset: int = 1,
                  percent_mode: str = "reference") -> DataFrame:
    """Join two statistics tables of the same period, meter by meter, and add
    the difference and percent columns. A row meets one partner at most; two
    different meters are compared by :func:`compare_series`."""
    return _compare(left, right, period, how, offset, percent_mode, True)


def _compare(left, right, period, how, offset, percent_mode, match_series: bool) -> DataFrame:
    need = stat_col(rows_group(period), "sum")
    for side in (left, right):
        if need not in side.columns:
            raise ValueError(f"both tables must hold {period!r} statistics ({need})")
    if how == "inner":
        offset = 0
    if left is right and match_series:
        j = _partners(left, _pair_keys(period, how, 0, F.col("period_start"), False), offset)
        if how == "aligned":      # a year's slot is the year itself: it has no other period
            j = j.where(F.col("period_start_1") != F.col("period_start_2") if period != "Y" else F.lit(False))
    else:
        L, R = _suffixed(left, "_1"), _suffixed(right, "_2")
        lk = _pair_keys(period, how, offset, F.col("period_start_1"), True)
        rk = _pair_keys(period, how, offset, F.col("period_start_2"), False)
        L = L.select("*", *[k.alias(f"__k{i}") for i, k in enumerate(lk)])
        R = R.select("*", *[k.alias(f"__r{i}") for i, k in enumerate(rk)])
        cond = [F.col(f"__k{i}") == F.col(f"__r{i}") for i in range(len(lk))]
        if match_series:
            cond.append(F.col("series_1") == F.col("series_2"))
        if how == "aligned":
            cond.append(F.col("period_start_1") != F.col("period_start_2"))
        j = L.join(R, cond, "inner").drop(*[f"__k{i}" for i in range(len(lk))], *[f"__r{i}" for i in range(len(rk))])
    side_cols = [c for c in j.columns]
    out = j.select(*_stats_metrics(period, percent_mode), *[F.col(f"`{c}`") for c in side_cols])
    if how == "inner":
        out = out.withColumn("_merge", F.lit("both"))
    return out


def compare_series(stats: DataFrame, left_series: str, right_series: str, period: str, how: str = "inner",
                   offset: int = 1, percent_mode: str = "reference") -> DataFrame:
    """Two meters of one statistics table against each other: each side's
    filter reaches the load's scan, so a side computes its own meter only."""
    return _compare(stats.where(F.col(SERIES) == left_series), stats.where(F.col(SERIES) == right_series),
                    period, how, offset, percent_mode, False)


def _dist_loads(dist: DataFrame) -> list[str]:
    return [c[: -len("__sum")] for c in dist.columns if c.endswith("__sum")]


def compare_distribution(dist: DataFrame, period: str, offset: int = 1,
                         percent_mode: str = "reference") -> DataFrame:
    """Every period of a distribution table against the period ``offset``
    steps earlier. Each row goes to two keys, its own period's index and its
    partner's; one hash aggregation by key brings the two together, so the
    table is computed once and not joined with itself."""
    loads = _dist_loads(dist)
    own, later = F.struct(F.lit(1).alias("side"), F.lit(0).alias("move")), F.struct(F.lit(2).alias("side"), F.lit(offset).alias("move"))
    d = dist.withColumn("__at", F.explode(F.array(own, later)))
    key = (period_ordinal(F.col("period_start"), period) + F.col("__at.move")).alias("__k")

    def name(c, side):
        if c == "period_start":
            return f"period_start_{side}"
        ld, st = c.rsplit("__", 1)
        return f"{ld}_{side}__{st}"
    side = F.col("__at.side")
    j = d.groupBy(key).agg(*[F.max(F.when(side == n, F.col(f"`{c}`"))).alias(name(c, n)) for n in (1, 2) for c in dist.columns]) \
        .where(F.col("period_start_1").isNotNull() & F.col("period_start_2").isNotNull()).drop("__k")
    p = MX.pct_consistent if percent_mode == "consistent" else MX.pct_div100_times
    mets = []
    for ld in loads:
        a, b = f"{ld}_1", f"{ld}_2"
        sa, sb = F.col(f"`{a}__sum`"), F.col(f"`{b}__sum`")
        ma, mb = F.col(f"`{a}__mean`"), F.col(f"`{b}__mean`")
        mets += [MX.diff(sa, sb).alias(f"first_data_sum_minus_second_data_sum_{a}_and_{b}"),
                 p(sa, sb).alias(f"percent_difference_sum_energy_{a}_and_{b}"),
                 MX.diff(ma, mb).alias(f"first_data_mean_minus_second_data_mean_{a}_and_{b}"),
                 p(ma, mb).alias(f"percent_difference_mean_power_{a}_and_{b}")]
    return j.select(*mets, *[F.col(f"`{c}`") for c in j.columns])


def compare_typical_day(td: DataFrame, period: str, offset: int = 1,
                        percent_mode: str = "reference") -> DataFrame:
    """Every group of a typical-day table against the group of the same hour
    ``offset`` periods earlier. The period is that of the group's
    ``first_day``: a missing week has no partner, and the year's end is a
    week like any other. A week cut by a month's end has two groups; as a
    partner it stands for the later one (the earlier one for a negative
    offset). ``x`` is the group, ``y`` its partner."""
    if period == "no_period":
        raise PeriodNotSupported("a whole-range typical day has nothing to compare with")
    if period not in GROUP_KEYS:
        raise PeriodNotSupported(f"typical days are compared by {sorted(k for k in GROUP_KEYS if len(k) == 1)}, not by {period!r}")
    keys = list(GROUP_KEYS[period])
    stats = [c for c in td.columns if c.startswith("Energy__")]
    at = period_ordinal(F.col("first_day").cast("timestamp_ntz"), period)
    pick = F.max_by if offset >= 0 else F.min_by
    w = Window.partitionBy(SERIES, "hour").orderBy("__k").rangeBetween(-offset, -offset)
    p = td.withColumn("__k", at).withColumn("__y", pick(F.struct(*keys, *stats), F.col("first_day")).over(w)).where(F.col("__y").isNotNull())
    p = p.select(SERIES, "hour", *[F.col(k).alias(f"{k}_1") for k in keys], *[F.col(f"__y.{k}").alias(f"{k}_2") for k in keys],
                 *[F.col(c).alias(f"{c}_1") for c in stats], *[F.col(f"__y.{c}").alias(f"{c}_2") for c in stats])
    a, b = F.col("Energy__mean_1"), F.col("Energy__mean_2")
    pc = MX.pct_consistent if percent_mode == "consistent" else MX.pct_over_100a
    hour = F.col("hour")
    if period in ("Q", "M"):
        k2 = keys[1]
        ix = F.make_timestamp_ntz(F.col(f"year_1"), F.col(f"{k2}_1"), F.lit(1), hour, F.lit(0), F.lit(0))
        iy = F.make_timestamp_ntz(F.col(f"year_2"), F.col(f"{k2}_2"), F.lit(1), hour, F.lit(0), F.lit(0))
    else:
        def txt(*names):
            return F.concat_ws("--", *[F.col(n).cast("string") for n in names])
        ix = txt("year_1", "month_1", "week_1", "hour")
        third = "week_2" if percent_mode == "consistent" else "month_2"   # SURVEY Q8
        iy = txt("year_2", "month_2", third, "hour")
    return p.select(MX.diff(a, b).alias("mean_energy_difference(x-y)"), pc(a, b).alias("percentage(x-y)/x"),
                    ix.alias("index x"), iy.alias("index y"), "*")


def display_order(period: str) -> list[str]:
    """The original's order of a typical-day comparison: both sides' group
    keys (year, quarter | month [, week]), then the hour."""
    keys = list(GROUP_KEYS[period])
    return [f"{k}_1" for k in keys] + [f"{k}_2" for k in keys] + ["hour"]


def sort_typical_day_comparison(cmp: DataFrame, period: str) -> DataFrame:
    """The rows in display order, meter by meter, with their ``position`` in
    the meter's list. A window per meter numbers them; the total sort is a
    range-partitioned shuffle, for output only."""
    order = display_order(period)
    position = F.row_number().over(Window.partitionBy(SERIES).orderBy(*order))
    return cmp.withColumn("position", position).orderBy(SERIES, "position")
