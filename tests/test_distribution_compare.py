"""Distribution, grouping and comparison formulas on micro fixtures."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loadgrid.functions.metrics import EPS
from loadgrid.operators import combine, compare, distribution, stats, typical_day

T = dt.datetime


def _loads(mk):
    # total at hours 0..3, a at 0..2 (hour 1 missing value), b at 1..3
    rows = []
    for h in range(4):
        rows.append(("total", T(2024, 1, 1, h), 10.0))
    for h, v in ((0, 4.0), (1, None), (2, 2.0)):
        rows.append(("a", T(2024, 1, 1, h), v))
    for h in (1, 2, 3):
        rows.append(("b", T(2024, 1, 1, h), 3.0))
    return mk(rows, "series string, DateTimeStart timestamp_ntz, Energy double") \
        .withColumn("DateTime", F.col("DateTimeStart"))


def test_group_loads_common_stamps(mk):
    g = combine.group_loads(_loads(mk), ["total", "a", "b"], "g").orderBy("DateTimeStart").collect()
    # common stamps: hours 1 and 2; the missing reading counts as 0
    assert [r["DateTimeStart"].hour for r in g] == [1, 2]
    assert [r["Energy"] for r in g] == [13.0, 15.0]
    assert g[0]["DateTime"] == T(2024, 1, 1, 2)


def test_group_loads_duplicate_stamp_fails(mk):
    df = _loads(mk)
    dup = df.unionByName(df.where(F.col("series") == "a"))
    with pytest.raises(Exception):
        combine.group_loads(dup, ["a", "b"]).collect()


def test_distribution_same_support_and_share(mk):
    view = _loads(mk).where(F.col("Energy").isNotNull())
    d = distribution.energy_distribution(view, ["total", "a", "b"], "D", total_first=True).collect()[0]
    # common stamps of the three filtered loads: hour 2 only
    assert (d["total__sum"], d["a__sum"], d["b__sum"]) == (10.0, 2.0, 3.0)
    assert d["a__percentage"] == 20.0 and d["total__percentage"] == 100.0
    assert d["other_loads__sum"] == 5.0 and d["other_loads__percentage"] == 50.0
    ind = distribution.energy_distribution(view, ["total", "a", "b"], "D", same_count=False).collect()[0]
    assert (ind["total__count"], ind["a__count"], ind["b__count"]) == (4, 2, 3)
    assert distribution.energy_distribution(view, ["a", "zzz"], "D").count() == 0


def test_compare_stats_daily_formulas(spark):
    cols = stats.stats_columns("D")
    schema = "series string, period_start timestamp_ntz, " + ", ".join(
        f"{c} {'timestamp_ntz' if 'idx' in c else ('bigint' if c.endswith('count') else 'double')}" for c in cols)

    def row(series, day, s, m):
        vals = {c: None for c in cols}
        vals["Daily_Energy_Hourly_Stats__sum"], vals["Daily_Energy_Hourly_Stats__mean"] = s, m
        return (series, T(2024, 1, day), *[vals[c] for c in cols])

    st = spark.createDataFrame([row("x", 1, 200.0, 10.0), row("x", 2, 100.0, 5.0),
                                row("y", 1, 100.0, 4.0), row("y", 2, 50.0, 5.0)], schema)
    a, b = st.where("series = 'x'"), st.where("series = 'y'")
    assert compare.compare_stats(a, b, "D").count() == 0            # different meters never meet here
    r = {x["period_start_1"].day: x for x in compare.compare_series(a.union(b), "x", "y", "D").collect()}
    assert r[1]["first_data_sum_minus_second_data_sum"] == 100.0
    assert r[1]["percent_difference_sum_energy_consumption"] == 100.0 / (EPS + 100.0) * 100.0
    assert r[1]["percent_difference_mean_power"] == 6.0 / (EPS + 4.0) * 100.0
    assert r[1]["_merge"] == "both"
    # shifted: day 2 of x against day 1 of y
    s = compare.compare_series(st, "x", "y", "D", "shifted", 1).collect()
    assert len(s) == 1 and s[0]["period_start_1"].day == 2 and s[0]["period_start_2"].day == 1
    # self comparison by series: antisymmetric pairs do not exist, each day meets its predecessor
    own = compare.compare_stats(st, st, "D", "shifted", 1).collect()
    assert {(x["series_1"], x["series_2"]) for x in own} == {("x", "x"), ("y", "y")}
    assert compare.compare_stats(st, st, "D", "aligned", 1).count() == 0
    with pytest.raises(ValueError):
        compare.compare_stats(st, st, "Y", "aligned", 1)


def test_compare_typical_day_lag(mk):
    stamps, vals = [], []
    for d in range(1, 15):
        for h in range(24):
            stamps.append(("s", T(2024, 1, d, h), T(2024, 1, d, h), float(d)))
    view = mk(stamps, "series string, DateTimeStart timestamp_ntz, DateTime timestamp_ntz, Energy double")
    td = typical_day.typical_day(view, "W")
    c = compare.compare_typical_day(td, "W", 1).where("hour = 0").orderBy("week_1").collect()
    assert len(c) == 1 and (c[0]["week_1"], c[0]["week_2"]) == (2, 1)
    a, b = c[0]["Energy__mean_1"], c[0]["Energy__mean_2"]
    assert c[0]["mean_energy_difference(x-y)"] == a - b
    assert c[0]["percentage(x-y)/x"] == (a - b) / (100 * (EPS + a))
    assert c[0]["index x"] == "2024--1--2--0" and c[0]["index y"] == "2024--1--1--0"
    with pytest.raises(ValueError):
        compare.compare_typical_day(typical_day.typical_day(view, "no_period"), "no_period")


def test_compare_distribution_previous_period(mk):
    rows = []
    for d in (1, 2, 3):
        for h in range(2):
            rows.append(("total", T(2024, 1, d, h), 10.0 * d))
            rows.append(("a", T(2024, 1, d, h), 1.0 * d))
    view = mk(rows, "series string, DateTimeStart timestamp_ntz, Energy double").withColumn("DateTime", F.col("DateTimeStart"))
    dist = distribution.energy_distribution(view, ["total", "a"], "D", total_first=True)
    c = compare.compare_distribution(dist, "D", 1).orderBy("period_start_1").collect()
    assert [(r["period_start_1"].day, r["period_start_2"].day) for r in c] == [(2, 1), (3, 2)]
    a, b = 2 * 2.0, 2 * 1.0
    assert c[0]["first_data_sum_minus_second_data_sum_a_1_and_a_2"] == a - b
    assert c[0]["percent_difference_sum_energy_a_1_and_a_2"] == (a - b) / 100 * (EPS + a)


def _stats_table(spark, period, values):
    cols = stats.stats_columns(period)
    schema = "series string, period_start timestamp_ntz, " + ", ".join(
        f"{c} {'timestamp_ntz' if 'idx' in c else ('bigint' if c.endswith('count') else 'double')}" for c in cols)
    rows = []
    for series, v in values.items():
        d = {c: None for c in cols}
        d.update(v)
        rows.append((series, T(2024, 1, 1), *[d[c] for c in cols]))
    return spark.createDataFrame(rows, schema)


def test_compare_stats_month_and_year_formulas(spark):
    m = _stats_table(spark, "M", {
        "x": {"Monthly_Energy_Hourly_Stats__sum": 300.0, "Monthly_Energy_Hourly_Stats__mean": 3.0,
              "Daily_Energy__mean": 30.0},
        "y": {"Monthly_Energy_Hourly_Stats__sum": 200.0, "Monthly_Energy_Hourly_Stats__mean": 2.0,
              "Daily_Energy__mean": 20.0}})
    r = compare.compare_series(m, "x", "y", "M").collect()[0]
    assert r["first_data_monthly_sum_minus_second_data_monthly_sum"] == 100.0
    assert r["percent_difference_monthly_sum_energy_consumption"] == 100.0 / (EPS + 200.0) * 100.0
    assert r["percent_difference_hourly_mean_power"] == 1.0 / (EPS + 2.0) * 100.0
    assert r["first_data_daily_mean_consumption_minus_second_data_mean_daily_consumption"] == 10.0
    assert r["percent_difference_mean_daily"] == 10.0 / (EPS + 20.0) * 100.0

    y = _stats_table(spark, "Y", {
        "x": {"Yearly_Energy_Hourly_Stats__sum": 400.0, "Yearly_Energy_Hourly_Stats__mean": 4.0,
              "Daily_Energy__mean": 40.0, "Monthly_Energy__mean": 1000.0},
        "y": {"Yearly_Energy_Hourly_Stats__sum": 100.0, "Yearly_Energy_Hourly_Stats__mean": 2.0,
              "Daily_Energy__mean": 10.0, "Monthly_Energy__mean": 500.0}})
    q = compare.compare_series(y, "x", "y", "Y").collect()[0]
    # sums and hourly means divide by the first value
    assert q["percent_difference_sum_energy_consumption"] == 100.0 * 300.0 / (EPS + 400.0)
    assert q["percent_difference_hourly_mean_power"] == 100.0 * 2.0 / (EPS + 4.0)
    # columns named "daily" read the monthly block, divided by the first value (Q1)
    assert q["first_data_daily_mean_consumption_minus_second_data_mean_daily_consumption"] == 500.0
    assert q["percent_difference_mean_daily"] == 100.0 * 500.0 / (EPS + 1000.0)
    # columns named "monthly" read the daily block, divided by the second value (Q1)
    assert q["first_data_monthly_mean_consumption_minus_second_data_mean_monthly_consumption"] == 30.0
    assert q["percent_difference_mean_monthly"] == 100.0 * 30.0 / (EPS + 10.0)
    c = compare.compare_series(y, "x", "y", "Y", percent_mode="consistent").collect()[0]
    assert c["first_data_daily_mean_consumption_minus_second_data_mean_daily_consumption"] == 30.0
    assert c["percent_difference_mean_monthly"] == 500.0 / (EPS + 1000.0) * 100.0


def test_many_meters_one_partner_each(mk):
    """W5: 30 meters over two months compare row by row, not all with all."""
    from loadgrid.operators import stats
    rows = [(f"m{m}", T(2024, mo, d), T(2024, mo, d), float(m + d)) for m in range(30) for mo in (1, 2) for d in range(1, 4)]
    st = stats.energy_stats(mk(rows, "series string, DateTimeStart timestamp_ntz, DateTime timestamp_ntz, Energy double"), "M", "D")
    assert compare.compare_stats(st, st, "M").count() == 60
    assert compare.compare_stats(st, st, "M", "shifted", 1).count() == 30


def test_typical_day_partner_at_year_end_and_gap(mk):
    """W6: 2024-W49 meets W48, 2024-12-30 is week 1 of 2025 and meets W52; a missing week has no partner."""
    days = [T(2024, 11, 25), T(2024, 12, 2), T(2024, 12, 16), T(2024, 12, 23), T(2024, 12, 30), T(2025, 1, 2), T(2025, 1, 6)]
    rows = [("s", d + dt.timedelta(hours=h), d + dt.timedelta(hours=h), float(d.day)) for d in days for h in range(24)]
    td = typical_day.typical_day(mk(rows, "series string, DateTimeStart timestamp_ntz, DateTime timestamp_ntz, Energy double"), "W")
    c = {(r["year_1"], r["month_1"], r["week_1"]): (r["year_2"], r["month_2"], r["week_2"])
         for r in compare.compare_typical_day(td, "W", 1).where("hour = 3").collect()}
    assert c == {(2024, 12, 49): (2024, 11, 48), (2024, 12, 52): (2024, 12, 51), (2024, 12, 1): (2024, 12, 52),
                 (2025, 1, 1): (2024, 12, 52), (2025, 1, 2): (2025, 1, 1)}


def test_duplicate_stamps_raise(mk):
    """W4: a stamp twice in one load and absent in another is no common stamp."""
    from loadgrid.operators import combine
    rows = [("a", T(2024, 1, 1), T(2024, 1, 1), 5.0), ("a", T(2024, 1, 1), T(2024, 1, 1), 5.0), ("b", T(2024, 1, 2), T(2024, 1, 2), 1.0)]
    v = mk(rows, "series string, DateTimeStart timestamp_ntz, DateTime timestamp_ntz, Energy double")
    with pytest.raises(Exception, match="holds a stamp twice"):
        combine.group_loads(v, ["a", "b"]).collect()
    with pytest.raises(Exception, match="holds a stamp twice"):
        distribution.energy_distribution(v, ["a", "b"], "D").collect()


def test_distribution_over_dotted_names(mk):
    rows = [(s, T(2024, 1, 1, h), T(2024, 1, 1, h), x) for s, x in (("hall.v2", 4.0), ("a b", 1.0)) for h in range(3)]
    v = mk(rows, "series string, DateTimeStart timestamp_ntz, DateTime timestamp_ntz, Energy double")
    r = distribution.energy_distribution(v, ["hall.v2", "a b"], "D", total_first=True)
    assert r.collect()[0]["a b__percentage"] == 25.0 and r.collect()[0]["other_loads__sum"] == 9.0
    both = r.unionByName(r.withColumn("period_start", F.expr("period_start + interval 1 day")))
    assert compare.compare_distribution(both, "D").count() == 1
