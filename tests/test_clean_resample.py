"""Micro fixtures for cleaning and resampling (hand-computed answers)."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loadgrid.config import DEFAULT
from loadgrid.operators import clean, fill, resample
from loadgrid.plans.load import filtered, load_series

T = dt.datetime


def _vals(df, col="Energy", order="DateTimeStart"):
    return [r[0] for r in df.orderBy(order).select(col).collect()]


def test_interval_hours_minutes_only(mk):
    rows = [("a", "2024-01-01 00:15:00", 1.0), ("a", "2024-01-01 00:30:00", 2.0),
            ("d", "2024-01-01 00:00:00", 1.0), ("d", "2024-01-02 00:00:00", 1.0),
            ("x", "2024-01-01 00:00:00", 1.0), ("x", "2024-01-02 01:30:00", 1.0),
            ("one", "2024-01-01 00:00:00", 1.0)]
    iv = {r["series"]: r for r in clean.interval_table(mk(rows)).collect()}
    assert (iv["a"]["interval_hours"], iv["a"]["interval_minutes"], iv["a"]["shift_seconds"]) == (0, 15, 900)
    # whole days are dropped: a daily series is never shifted
    assert iv["d"]["shift_seconds"] == 0 and iv["d"]["delta_seconds"] == 86400
    assert (iv["x"]["interval_hours"], iv["x"]["interval_minutes"]) == (1, 30)
    assert iv["one"]["shift_seconds"] == 0


def test_interval_equal_first_stamps_is_zero(mk):
    rows = [("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:00:00", 2.0),
            ("a", "2024-01-01 01:00:00", 2.0)]
    assert clean.interval_table(mk(rows)).collect()[0]["shift_seconds"] == 0


def test_empty_vs_all_null_bins(mk):
    rows = [("s", "2024-01-01 00:00:00", 1.0), ("s", "2024-01-01 00:30:00", None),
            ("s", "2024-01-01 03:00:00", None), ("s", "2024-01-01 03:30:00", None)]
    df = mk(rows).withColumn("t", F.col("DateTime"))

    def run(**kw):
        return [r["Energy"] for r in resample.resample_bins(df, "H", **kw).orderBy("bin").collect()]

    assert run(how="sum", null_sum="propagate") == [None, 0.0, 0.0, None]
    assert run(how="sum", null_sum="skip") == [1.0, 0.0, 0.0, 0.0]
    assert run(how="mean") == [1.0, None, None, None]


def test_interpolation_by_position(mk):
    vals = [None, 1.0, None, None, 4.0, None]
    rows = [("s", T(2024, 1, 1, h), v) for h, v in enumerate(vals)]
    df = mk(rows)
    out = fill.interpolate_linear(df, ts="DateTime")
    assert _vals(out, order="DateTime") == [None, 1.0, 2.0, 3.0, 4.0, 4.0]
    assert _vals(fill.forward_fill(df, ts="DateTime"), order="DateTime") == [None, 1.0, 1.0, 1.0, 4.0, 4.0]
    assert _vals(fill.back_fill(df, ts="DateTime"), order="DateTime") == [1.0, 1.0, 4.0, 4.0, 4.0, None]


def test_interpolation_across_blocks_matches_single_block(mk):
    # one value every 5 hours over several days, gaps crossing day blocks
    vals = [1.0, None, None, None, None, None, 7.0, None, None, 10.0, None, None, None, None, None, 16.0, None]
    rows = [("s", T(2024, 1, 1) + dt.timedelta(hours=5 * i), v) for i, v in enumerate(vals)]
    df = mk(rows)
    by_day = _vals(fill.fill_gaps(df, "DateTime", interpolate=True, block="day"), order="DateTime")
    by_year = _vals(fill.fill_gaps(df, "DateTime", interpolate=True, block="year"), order="DateTime")
    assert by_day == by_year
    assert by_day == [float(i + 1) for i in range(16)] + [16.0]


def _quarter_fixture(mk):
    """Two days of end-stamped 15-minute readings: a leading null, an inner
    gap of two readings, a zero, and a trailing null."""
    rows = []
    start = T(2024, 1, 1, 0, 15)
    for i in range(2 * 96):
        stamp = start + dt.timedelta(minutes=15 * i)
        v = 1.0
        if i == 0 or i == 2 * 96 - 1:
            v = None
        if i == 10:
            v = 0.0
        if i in (20, 21):
            continue
        rows.append(("m", stamp, v))
    return mk(rows)


def test_quarter_hour_load_hourly(mk):
    load = load_series(_quarter_fixture(mk), DEFAULT, "H")
    rows = load.orderBy("DateTimeStart").collect()
    # interval 15 min: stamps shifted back 15 min; 48 hours, first at 00:00
    assert len(rows) == 48
    assert rows[0]["DateTimeStart"] == T(2024, 1, 1, 0) and rows[0]["DateTime"] == T(2024, 1, 1, 1)
    # hour 0: leading null skipped -> 3; hour 2 holds the zero -> 3; hour 5 misses 2 readings -> 2
    e = [r["Energy"] for r in rows]
    assert e[0] == 3.0 and e[2] == 3.0 and e[5] == 2.0 and e[-1] == 3.0
    assert sum(e) == 2 * 96 - 2 - 2 - 1


def test_quarter_hour_load_zero_as_missing_and_filled(mk):
    cfg = DEFAULT.with_(zero_values_are_ok=False, fill_zero_energy_to_previous=True, back_fill=True,
                        null_sum="propagate")
    load = load_series(_quarter_fixture(mk), cfg, "H")
    e = _vals(load)
    # every missing reading filled (leading by back fill), so every hour that
    # has 4 readings sums to 4; the hour with the removed pair still has 2 rows
    assert e[0] == 4.0 and e[2] == 4.0 and e[5] == 2.0 and e[-1] == 4.0


def test_to_hourly_only_for_sub_hourly(mk):
    load = load_series(_quarter_fixture(mk), DEFAULT, "15min")
    view = filtered(load)
    h = resample.to_hourly(view, "15min")
    assert h.count() == 48
    assert resample.to_hourly(view, "H") is view


def test_period_labels(mk):
    stamps = []
    t = T(2024, 1, 30)
    while t <= T(2024, 3, 2):
        stamps.append(("s", t, 1.0))
        t += dt.timedelta(hours=12)
    df = mk(stamps)
    cfg = DEFAULT.with_(measurement_is_before_index=False)
    m = load_series(df, cfg, "M").orderBy("DateTimeStart").collect()
    assert [r["DateTimeStart"].date() for r in m] == [dt.date(2024, 1, 31), dt.date(2024, 2, 29), dt.date(2024, 3, 31)]
    assert [r["Energy"] for r in m] == [4.0, 58.0, 3.0]
    w = load_series(df, cfg, "W").orderBy("DateTimeStart").collect()
    assert w[0]["DateTimeStart"].date() == dt.date(2024, 2, 4) and w[0]["Energy"] == 12.0
    q = load_series(df, cfg, "Q").collect()
    assert [r["DateTimeStart"].date() for r in q] == [dt.date(2024, 3, 31)]
    y = load_series(df, cfg, "Y").collect()
    assert [r["DateTimeStart"].date() for r in y] == [dt.date(2024, 12, 31)]


def test_resample_loaded_and_extent(mk):
    rows = [("s", T(2024, 1, 1) + dt.timedelta(hours=h + 1), float(h)) for h in range(48)]
    load = load_series(mk(rows), DEFAULT, "H")
    d = resample.resample_loaded(load, "D").orderBy("DateTimeStart").collect()
    assert [r["Energy"] for r in d] == [sum(range(24)), sum(range(24, 48))]
    ext = resample.series_extent(load).collect()[0]
    assert (ext["min_day"], ext["max_day"]) == (dt.date(2024, 1, 1), dt.date(2024, 1, 2))


def test_drop_zero_view(mk):
    rows = [("s", T(2024, 1, 1, 1), 0.0), ("s", T(2024, 1, 1, 2), None), ("s", T(2024, 1, 1, 3), 2.0)]
    df = mk(rows).withColumn("DateTimeStart", F.col("DateTime"))
    assert clean.filtered_view(df).count() == 2
    assert clean.filtered_view(df, drop_zeros=True).count() == 1


def test_appended_meter_gets_its_own_interval(spark, tmp_path):
    """W2: no memo of intervals outlives the readings it was made from."""
    path = str(tmp_path / "readings")

    def add(series, minutes):
        rows = [(series, T(2024, 1, 1) + dt.timedelta(minutes=minutes * k), 1.0) for k in range(1, 9)]
        spark.createDataFrame(rows, "series string, DateTime timestamp_ntz, Energy double").write.mode("append").parquet(path)

    add("m1", 60)
    assert load_series(spark.read.parquet(path), DEFAULT, "H").count() == 8
    kept = clean.interval_table(spark.read.parquet(path))
    add("m2", 120)
    m2 = load_series(spark.read.parquet(path), DEFAULT, "H").where("series = 'm2'").orderBy("DateTimeStart").first()
    assert m2["DateTimeStart"] == T(2024, 1, 1, 0)
    with pytest.raises(Exception, match="no sampling interval is known for meter m2"):
        load_series(spark.read.parquet(path), DEFAULT, "H", intervals=kept).collect()
    assert load_series(spark.read.parquet(path).where("series = 'm1'"), DEFAULT, "H", intervals=kept).count() == 8


def test_missing_stamp_raises(mk):
    with pytest.raises(Exception, match="a reading has no stamp"):
        load_series(mk([("a", "2024-01-01 00:15:00", 1.0), ("a", "2024-01-01 00:30:00", 1.0), ("a", None, 2.0)]), DEFAULT).collect()


def test_other_session_zone_raises(spark, mk):
    df = mk([("a", "2024-03-10 02:00:00", 4.0), ("a", "2024-03-10 03:00:00", 5.0)])
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(RuntimeError, match="time zone"):
            load_series(df, DEFAULT)
        with pytest.raises(RuntimeError, match="time zone"):
            resample.resample_bins(df.withColumn("t", F.col("DateTime")), "D")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_long_gap_on_a_minute_grid(mk):
    """P5: a stray stamp far away makes many rows, but no array longer than a day."""
    df = mk([("s", "1999-01-01 00:00:00", 1.0), ("s", "1999-01-01 00:01:00", 1.0), ("s", "2003-01-01 00:00:00", 1.0)])
    out = resample.resample_bins(df.withColumn("t", F.col("DateTime")), "1min")
    days = (dt.date(2003, 1, 1) - dt.date(1999, 1, 1)).days
    assert out.count() == days * 1440 + 1
    assert out.where("Energy > 0").count() == 3 and out.select("bin").distinct().count() == days * 1440 + 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 2


def test_quarter_hours_in_business_hours_invent_nothing(mk):
    """W3: a constant 15-minute load under business hours keeps its constant hours."""
    from loadgrid.operators import select, stats
    rows = [("s", T(2024, 1, 1) + dt.timedelta(minutes=15 * (k + 1)), 1.0) for k in range(96 * 3)]
    view = select.select_rows(filtered(load_series(mk(rows), DEFAULT, "15min")), None, 0, 1)
    h = resample.to_hourly(view, "15min").collect()
    # 08:00 .. 15:00 of three days; the last quarter-hour kept is 15:00 itself
    assert len(h) == 24 and {r["Energy"] for r in h} == {4.0, 1.0}
    d = stats.energy_stats(view, "D", "15min").orderBy("period_start").collect()
    assert [r["Daily_Energy_Hourly_Stats__count"] for r in d] == [8, 8, 8]
    assert min(r["Daily_Energy_Hourly_Stats__min"] for r in d) == 1.0


def test_stats_moments_merge(mk):
    """One pass over the rows: moments of days merge to those of the period."""
    import statistics
    from loadgrid.operators import stats
    vals = [((k * 7919) % 1000) / 7.0 + 1e6 for k in range(24 * 40)]
    rows = [("s", T(2024, 1, 1) + dt.timedelta(hours=k), T(2024, 1, 1) + dt.timedelta(hours=k), v) for k, v in enumerate(vals)]
    view = mk(rows, "series string, DateTimeStart timestamp_ntz, DateTime timestamp_ntz, Energy double")
    r = stats.energy_stats(view, "Y").collect()[0]
    g = "Yearly_Energy_Hourly_Stats__"
    assert abs(r[g + "std"] - statistics.stdev(vals)) < 1e-6 and abs(r[g + "sum"] - sum(vals)) < 1e-3
    assert r[g + "idxmin"] == rows[vals.index(min(vals))][1] and r[g + "idxmax"] == rows[vals.index(max(vals))][1]
    assert r["Monthly_Energy__count"] == 2 and r["Daily_Energy__count"] == 40
    assert abs(r["Monthly_Energy__max"] - sum(vals[:24 * 31])) < 1e-3 and r["Monthly_Energy__idxmax"] == T(2024, 1, 1)
