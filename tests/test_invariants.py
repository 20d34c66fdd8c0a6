"""Invariants on the provided sf0.001 tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from loadgrid.operators import compare, distribution, resample, stats, typical_day
from loadgrid.plans import table_queries as TQ
from loadgrid.plans.load import filtered

SF = "/root/testdata/sf0.001"


def _close(a, b, tol=1e-6):
    return math.isclose(a, b, rel_tol=tol, abs_tol=tol)


def test_daily_sums_add_up_to_monthly(spark):
    view = TQ.events_view(spark, SF)
    d = stats.energy_stats(view, "D").withColumn("m", F.date_trunc("month", "period_start").cast("timestamp_ntz"))
    by_month = {(r["series"], r["m"]): r["s"] for r in
                d.groupBy("series", "m").agg(F.sum("Daily_Energy_Hourly_Stats__sum").alias("s")).collect()}
    m = stats.energy_stats(view, "M").collect()
    assert m
    for r in m:
        assert _close(by_month[(r["series"], r["period_start"])], r["Monthly_Energy_Hourly_Stats__sum"])


def test_resample_day_then_month_equals_month(spark):
    hourly = TQ.events_load(spark, SF, "H")
    via_day = resample.resample_loaded(resample.resample_loaded(hourly, "D"), "M")
    direct = TQ.events_load(spark, SF, "M")
    a = {(r["series"], r["DateTimeStart"]): r["Energy"] for r in via_day.collect()}
    b = {(r["series"], r["DateTimeStart"]): r["Energy"] for r in direct.collect()}
    assert a.keys() == b.keys()
    assert all(_close(a[k], b[k]) for k in a)


def test_comparison_antisymmetry(spark):
    st = stats.energy_stats(TQ.events_view(spark, SF), "D")
    fwd = compare.compare_stats(st, st, "D", "shifted", 1)
    back = compare.compare_stats(st, st, "D", "shifted", -1)
    f = {(r["series_1"], r["period_start_1"], r["period_start_2"]): r["first_data_sum_minus_second_data_sum"]
         for r in fwd.collect()}
    b = {(r["series_1"], r["period_start_2"], r["period_start_1"]): r["first_data_sum_minus_second_data_sum"]
         for r in back.collect()}
    assert f and f.keys() == b.keys()
    assert all(_close(f[k], -b[k]) for k in f)


def test_typical_day_bounds(spark):
    td = typical_day.typical_day(TQ.events_view(spark, SF), "W").collect()
    assert td
    for r in td:
        assert r["Energy__min"] <= r["Energy__mean"] + 1e-9 and r["Energy__mean"] <= r["Energy__max"] + 1e-9


def test_residual_is_total_minus_loads(spark):
    loads = ["total", "click", "error", "purchase", "signup", "view"]
    d = distribution.energy_distribution(TQ.events_view(spark, SF), loads, "D", total_first=True).collect()
    assert d
    for r in d:
        rest = r["total__sum"] - sum(r[f"{x}__sum"] for x in loads[1:])
        assert _close(r["other_loads__sum"], rest)
        assert _close(sum(r[f"{x}__percentage"] for x in loads[1:]) + r["other_loads__percentage"], 100.0)


def test_filtered_view_has_no_missing(spark):
    load = TQ.lineitem_load(spark, SF, "D", TQ.DEFAULT.with_(zero_values_are_ok=False, null_sum="propagate"),
                            value="l_discount")
    assert load.where(F.col("Energy").isNull()).count() > 0
    assert filtered(load).where(F.col("Energy").isNull()).count() == 0
