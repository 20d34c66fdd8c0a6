"""Calendar edges, selection, statistics and typical days on micro fixtures."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from loadgrid.functions.calendar import filter_business_days, filter_business_hours, holidays_frame
from loadgrid.operators import select, stats, typical_day
from loadgrid.operators.typical_day import PeriodNotSupported

T = dt.datetime


def _start_table(mk, stamps, values=None):
    values = values or [1.0] * len(stamps)
    rows = [("s", s, s, v) for s, v in zip(stamps, values)]
    return mk(rows, "series string, DateTimeStart timestamp_ntz, DateTime timestamp_ntz, Energy double")


def test_business_hours_edges(mk):
    # Fri 2024-01-05 07:59, 08:00, 15:00, 15:15; Sat 09:00; holiday Mon 2024-01-01 09:00
    stamps = [T(2024, 1, 5, 7, 59), T(2024, 1, 5, 8), T(2024, 1, 5, 15), T(2024, 1, 5, 15, 15),
              T(2024, 1, 6, 9), T(2024, 1, 1, 9)]
    df = _start_table(mk, stamps)
    kept = {r["DateTimeStart"] for r in filter_business_hours(df, 1, hours=(8, 16)).collect()}
    assert [s in kept for s in stamps] == [False, True, True, False, False, True]
    other = {r["DateTimeStart"] for r in filter_business_hours(df, 2, hours=(8, 16)).collect()}
    assert kept.isdisjoint(other) and len(kept) + len(other) == len(stamps)


def test_business_days_with_holidays(spark, mk):
    stamps = [T(2024, 1, 1, 9), T(2024, 1, 2, 9), T(2024, 1, 6, 9), T(2024, 1, 8, 23)]
    df = _start_table(mk, stamps)
    hol = holidays_frame(spark, ["2024-01-01"])
    bd = {r["DateTimeStart"] for r in filter_business_days(df, 1, holidays=hol).collect()}
    assert bd == {T(2024, 1, 2, 9), T(2024, 1, 8, 23)}
    nbd = {r["DateTimeStart"] for r in filter_business_days(df, 2, holidays=hol).collect()}
    assert nbd == {T(2024, 1, 1, 9), T(2024, 1, 6, 9)}
    with pytest.raises(ValueError):
        filter_business_days(df, 3)


def test_daily_range_end_stamp(mk):
    days = [T(2024, 3, d) for d in range(1, 6)]
    df = _start_table(mk, days)
    kept = sorted(r["DateTime"].day for r in select.filter_range(df, "2024-03-02", "2024-03-04").collect())
    assert kept == [3, 4, 5]


def test_select_keys_days_and_pairs(mk):
    stamps = [T(2024, 1, 1) + dt.timedelta(hours=h) for h in range(72)]
    df = _start_table(mk, stamps)
    assert select.select_keys(df, "DateTimeStart", ["2024-01-02"], by_day=True).count() == 24
    assert select.distinct_keys(df, "DateTimeStart", by_day=True).count() == 3
    assert select.head(df, 5).count() == 5
    pairs = df.select(F.col("DateTimeStart").alias("a"), F.col("DateTime").alias("b"))
    got = select.select_pairs(pairs, "a", ["2024-01-01 00:00:00", "2024-01-01 01:00:00"],
                              "b", ["2024-01-01 01:00:00"]).collect()
    assert len(got) == 1


def test_stats_month_blocks(mk):
    # two full days in Jan (hourly 1.0 and 2.0) and one day in Feb with 12 hours of 3.0
    stamps, vals = [], []
    for h in range(24):
        stamps.append(T(2024, 1, 10, h)); vals.append(1.0)
        stamps.append(T(2024, 1, 11, h)); vals.append(2.0)
    for h in range(12):
        stamps.append(T(2024, 2, 1, h)); vals.append(3.0)
    view = _start_table(mk, stamps, vals)
    out = {r["period_start"].month: r for r in stats.energy_stats(view, "M").collect()}
    jan, feb = out[1], out[2]
    assert jan["Monthly_Energy_Hourly_Stats__sum"] == 72.0
    assert jan["Monthly_Energy_Hourly_Stats__count"] == 48
    assert jan["Monthly_Energy_Hourly_Stats__idxmin"] == T(2024, 1, 10, 0)
    assert jan["Monthly_Energy_Hourly_Stats__idxmax"] == T(2024, 1, 11, 0)
    # daily energy = day mean x fullest day's row count (24, for every day)
    assert jan["Daily_Energy__mean"] == 36.0 and jan["Daily_Energy__min"] == 24.0
    assert feb["Daily_Energy__mean"] == 72.0 and feb["Daily_Energy__count"] == 1
    assert feb["Daily_Energy__std"] is None
    q = stats.energy_stats(view, "Q").collect()[0]
    assert q["Monthly_Energy__mean"] == (72.0 + 36.0) / 2
    assert math.isclose(q["Monthly_Energy__std"], math.sqrt(((72 - 54) ** 2 + (36 - 54) ** 2) / 1))
    assert stats.energy_stats(view, "D").columns == ["series", "period_start"] + stats.stats_columns("D")


def test_typical_day_complete_days(mk):
    stamps, vals = [], []
    for d in (1, 2, 3):
        for h in range(24):
            if d == 2 and h == 5:
                continue
            stamps.append(T(2024, 1, d, h)); vals.append(float(d))
    view = _start_table(mk, stamps, vals)
    td = typical_day.typical_day(view, "no_period").orderBy("hour").collect()
    assert len(td) == 24
    assert all(r["Energy__mean"] == 2.0 for r in td)   # days 1 and 3 only
    assert td[0]["Energy__idxmin"] == T(2024, 1, 1, 0) and td[0]["Energy__idxmax"] == T(2024, 1, 3, 0)
    m = typical_day.typical_day(view, "M").collect()
    assert {(r["year"], r["month"]) for r in m} == {(2024, 1)}
    for p in ("H", "D", "Y"):
        with pytest.raises(PeriodNotSupported):
            typical_day.typical_day(view, p)
