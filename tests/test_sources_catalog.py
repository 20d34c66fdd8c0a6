"""Readers, sinks, snapshots and the table catalog (files in a temp folder)."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from loadgrid.config import DEFAULT
from loadgrid.functions.naming import series_name_from_file, table_key
from loadgrid.plans.catalog import KindMismatch, NoCommonStamp, TableCatalog, TableNotFound
from loadgrid.plans.load import load_series
from loadgrid.sources.files import check_format, read_readings, read_wide_csv, unpivot_quarters

T = dt.datetime


def test_series_names():
    assert table_key("  Main   meter \t A ") == "Main_meter_A"
    assert series_name_from_file(" Main meter.csv") == "Main_meter"
    assert series_name_from_file("hall.v2.csv", period="D") == "hall.v2_period_D"
    assert series_name_from_file("hall.csv", period="H") == "hall"


def test_read_two_column_files_by_position(spark):
    d = tempfile.mkdtemp(prefix="lg-src-")
    with open(os.path.join(d, "Main meter.csv"), "w") as f:
        f.write("Timestamp,kWh\n2024-01-01 01:00:00,1.5\n2024-01-01 02:00:00,2.5\n2024-01-01 03:00:00.6,NA\n")
    with open(os.path.join(d, "hall.csv"), "w") as f:
        f.write("when,value\n01/01/2024 01:00,4\n01/01/2024 02:00,5\n")
    r = read_readings(spark, [os.path.join(d, "Main meter.csv"), os.path.join(d, "hall.csv")], "csv")
    rows = sorted((x["series"], x["DateTime"], x["Energy"]) for x in r.collect())
    assert rows[0] == ("Main_meter", T(2024, 1, 1, 1), 1.5)
    # not available -> missing; sub-second stamp rounded to the second
    assert rows[2] == ("Main_meter", T(2024, 1, 1, 3, 0, 1), None)
    assert ("hall", T(2024, 1, 1, 2), 5.0) in rows
    load = load_series(r, DEFAULT, "H", order=["__blk", "__row"]).where("series = 'hall'").collect()
    assert [x["Energy"] for x in sorted(load, key=lambda x: x["DateTimeStart"])] == [4.0, 5.0]
    with pytest.raises(NotImplementedError):
        check_format("xlsx")


def test_wide_quarter_layout(spark):
    d = tempfile.mkdtemp(prefix="lg-wide-")
    header = ["Date_"] + [str(q) for q in range(1, 97)]
    with open(os.path.join(d, "site a.csv"), "w") as f:
        f.write(",".join(header) + "\n")
        f.write(",".join(["20240101"] + ["1"] * 96) + "\n")
        f.write(",".join(["20240102"] + ["2"] * 95 + [""]) + "\n")
    r = read_wide_csv(spark, os.path.join(d, "site a.csv"))
    from loadgrid.sources.files import read_meter_files
    assert read_meter_files(spark, os.path.join(d, "site a.csv"), DEFAULT.with_(custom_data_load=True)).count() == 192
    rows = r.orderBy("DateTime").collect()
    assert len(rows) == 192 and rows[0]["series"] == "site_a"
    assert rows[0]["DateTime"] == T(2024, 1, 1, 0, 0) and rows[1]["DateTime"] == T(2024, 1, 1, 0, 15)
    assert rows[-1]["DateTime"] == T(2024, 1, 2, 23, 45) and rows[-1]["Energy"] is None
    load = load_series(r, DEFAULT, "H").orderBy("DateTimeStart").collect()
    # 15-minute interval: stamps move back 15 minutes, the first reading lands in the previous day
    assert load[0]["DateTimeStart"] == T(2023, 12, 31, 23) and load[0]["Energy"] == 1.0
    wide = spark.createDataFrame([(20240101, 1.0, 2.0)], "Date_ int, `1` double, `2` double")
    u = unpivot_quarters(wide).orderBy("DateTime").collect()
    assert [x["Energy"] for x in u] == [1.0, 2.0]


def test_catalog_keep_save_snapshot(spark):
    root = tempfile.mkdtemp(prefix="lg-cat-")
    cat = TableCatalog(spark)
    a = spark.createDataFrame([("a", T(2024, 1, 1, 0), T(2024, 1, 1, 1), 1.0)],
                              "series string, DateTimeStart timestamp_ntz, DateTime timestamp_ntz, Energy double")
    b = a.withColumn("series", F.lit("b"))
    assert cat.keep("load a", a, "energy_data", "H") == "load_a"
    cat.keep("b", b, "energy_data", "H")
    cat.keep("st", a.groupBy("series").count(), "energy_stats_data", "D")
    assert cat.names("energy_data") == ["load_a", "b"]
    assert spark.table("load_a").count() == 1
    with pytest.raises(TableNotFound):
        cat.get("missing")
    with pytest.raises(TableNotFound):
        cat.require("load_a", "missing")
    with pytest.raises(KindMismatch):
        cat.concatenate("load_a", "st")
    n = cat.concatenate("load_a", "b")
    assert cat.get(n).count() == 2
    ab = cat.keep("ab", cat.get(n), "energy_data", "H")
    g = cat.group(ab, ["a", "b"], "grouped")
    assert cat.get(g).collect()[0]["Energy"] == 2.0
    with pytest.raises(NoCommonStamp):
        cat.group(ab, ["a", "zzz"], "none")
    path = cat.save("load_a", root, "csv")
    assert spark.read.option("header", True).csv(path).count() == 1
    assert "Output_" in cat.output_dir(root, overwrite=False)
    snap = cat.store_state(root)
    other = TableCatalog(spark)
    assert other.load_state(root) == snap
    assert sorted(other.names()) == sorted(cat.names())
    assert other.entry("st").kind == "energy_stats_data" and other.entry("st").period == "D"
    other.remove("st")
    assert "st" not in other.names()


def test_catalog_commands(spark):
    from loadgrid.functions.calendar import holidays_frame

    rows = []
    for series, base in (("total", 10.0), ("a", 4.0), ("b", 3.0)):
        for h in range(1, 24 * 20 + 1):
            rows.append((series, T(2024, 1, 1) + dt.timedelta(hours=h), base + (h % 24) / 24.0))
    readings = spark.createDataFrame(rows, "series string, DateTime timestamp_ntz, Energy double")
    cat = TableCatalog(spark)
    load = cat.load("site", readings, "H")
    st = cat.energy_stats(load, "D", ("2024-01-02", "2024-01-15"), bdays=1,
                          holidays=holidays_frame(spark, ["2024-01-08"]))
    assert cat.entry(st).kind == "energy_stats_data"
    assert cat.get(st).select("period_start").distinct().count() == 9
    w = cat.energy_stats(load, "W")
    cmp_ = cat.compare_stats(w, w, "shifted", 1)
    assert cat.get(cmp_).count() > 0
    with pytest.raises(ValueError):
        cat.compare_stats(st, w)
    td = cat.typical_day(load, "W")
    assert cat.get(cat.compare_typical_day(td)).count() > 0
    dist = cat.energy_dist([load], ["total", "a", "b"], "D", total_first=True)
    assert cat.get(cat.compare_distribution(dist)).count() > 0
    daily = cat.resample(load, "D")
    with pytest.raises(ValueError):
        cat.energy_dist([load, daily], ["total"], "M")
    sel = cat.select_rows(load, "DateTimeStart", ["2024-01-03"])
    assert cat.get(sel).count() == 3 * 24
    assert cat.head(load, 2).count() == 6
    assert cat.extent(load).collect()[0]["min_day"] == dt.date(2024, 1, 1)


def _file(text: str) -> str:
    d = tempfile.mkdtemp(prefix="lg-src-")
    with open(os.path.join(d, "m.csv"), "w") as f:
        f.write(text)
    return os.path.join(d, "m.csv")


def test_slash_dates_are_month_first_unless_told(spark):
    p = _file("t,v\n01/02/2024 01:00,1\n1/13/2024 2:05:06,2\n")
    assert sorted(r["DateTime"] for r in read_readings(spark, p).collect()) == [T(2024, 1, 2, 1), T(2024, 1, 13, 2, 5, 6)]
    with pytest.raises(Exception, match=r"no stamp layout fits \(1/13/2024"):
        read_readings(spark, p, day_first=True).collect()
    assert [r["stamp"] for r in read_readings(spark, p, day_first=True, rejects=True).collect()] == ["1/13/2024 2:05:06"]
    p = _file("t,v\n01/02/2024 01:00,1\n")
    assert read_readings(spark, p, day_first=True).first()["DateTime"] == T(2024, 2, 1, 1)


@pytest.mark.parametrize("text, want", [
    ("2024-01-05", T(2024, 1, 5)), ("2024-01-05T06:07:08", T(2024, 1, 5, 6, 7, 8)), ("2024/1/5 6:07", T(2024, 1, 5, 6, 7)),
    ("20240105 06:07:08", T(2024, 1, 5, 6, 7, 8)), ("5 Jan 2024 6:07", T(2024, 1, 5, 6, 7)), ("January 5 2024", None),
    ("Jan 5 2024 06:07", T(2024, 1, 5, 6, 7)), ("1/5/2024 6:07:08 PM", T(2024, 1, 5, 18, 7, 8)), ("1-5-2024", T(2024, 1, 5)),
    ("2024-01-05 06:00:00+02:00", T(2024, 1, 5, 6)), ("soon", None)])
def test_stamp_layouts(spark, text, want):
    from loadgrid.sources.files import parse_datetime
    got = spark.range(1).select(parse_datetime(F.lit(text)).alias("t")).first()["t"]
    assert got == want or want is None and (got is None or got == T(2024, 1, 5))


def test_bad_lines_raise(spark):
    with pytest.raises(Exception):
        read_readings(spark, _file("t,v\n2024-01-01 01:00:00,1,7\n")).collect()
    with pytest.raises(Exception):
        read_readings(spark, _file("t,v\n2024-01-01 01:00:00\n")).collect()
    with pytest.raises(Exception, match="an empty stamp"):
        read_readings(spark, _file("t,v\n,5\n")).collect()


def test_save_last_one_folder_a_session(spark):
    cat = TableCatalog(spark)
    with pytest.raises(LookupError):
        cat.save_last(tempfile.mkdtemp())
    root = tempfile.mkdtemp(prefix="lg-out-")
    cat.keep("first", spark.range(3))
    a = cat.save_last(root, "csv", overwrite=False)
    cat.keep("second table", spark.range(4))
    b = cat.save_last(root, "parquet", overwrite=False)
    assert os.path.dirname(a) == os.path.dirname(b) and b.endswith("/second_table")
    assert spark.read.parquet(b).count() == 4 and spark.read.option("header", True).csv(a).count() == 3
    assert cat.store_state(root) != cat.store_state(root)          # snapshots of one second stay apart


def test_picked_days_of_hourly_statistics_and_comparisons(spark):
    rows = [("m", T(2024, 1, 1) + dt.timedelta(hours=h + 1), float(h)) for h in range(24 * 5)]
    cat = TableCatalog(spark)
    load = cat.load("m", spark.createDataFrame(rows, "series string, DateTime timestamp_ntz, Energy double"), "H")
    st = cat.energy_stats(load, "H")
    assert cat.get(cat.select_rows(st, "period_start", ["2024-01-02"])).count() == 24
    cmp_ = cat.compare_stats(st, st, "aligned", 1)
    sel = cat.select_rows(cmp_, "period_start_1", ["2024-01-03"], column2="period_start_2", values2=["2024-01-02", "2024-01-01"])
    assert cat.get(sel).count() == 24
    assert cat.keys(cmp_).count() == 4 and cat.keys(st).count() == 5
    dist = cat.energy_dist([load], ["m"], "D")
    assert [r["period_start"].day for r in cat.head(dist, 3).collect()] == [1, 2, 3]


def test_checkpoint_folder_is_required_off_local_mode(monkeypatch):
    from loadgrid import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda k, d=None: d)

    with pytest.raises(RuntimeError, match="share"):
        session.checkpoint_dir(Session())


def test_a_large_meter_is_written_by_several_tasks(spark, tmp_path):
    import glob

    from loadgrid.sources.files import read_meter_files, write_meter_folders
    rows = [("total", f"1/{1 + k % 28}/2020 {k % 24}:00:00", float(k)) for k in range(4000)] + [("b c", "1/2/2020 3:00:00", 1.5)]
    out = str(tmp_path / "meters")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")     # so small a table is one task otherwise
    try:
        write_meter_folders(spark.createDataFrame(rows, "series string, stamp string, Energy double").coalesce(1), out, rows_per_file=500)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = glob.glob(f"{out}/series=total/part-*")
    assert len(files) > 1 and max(sum(1 for _ in open(f)) for f in files) < 3000
    back = read_meter_files(spark, out, name_from="dir").select("series", "Energy").collect()
    assert sorted(map(tuple, back)) == sorted((s, e) for s, _, e in rows)


def test_small_meters_are_one_file_each(spark, tmp_path):
    import glob

    from loadgrid.sources.files import write_meter_folders
    out = str(tmp_path / "many")
    spark.range(3000).selectExpr("concat('m', id % 150) series", "'1/2/2020 3:00:00' stamp", "id Energy").write.parquet(str(tmp_path / "rows"))
    write_meter_folders(spark.read.parquet(str(tmp_path / "rows")), out)
    assert len(glob.glob(f"{out}/series=*/part-*")) == 150


def test_unreadable_readings_raise_or_are_returned(spark):
    text = 't,v\n2024-01-01 01:00:00,abc\n2024-01-01 02:00:00,"1,234.5"\n2024-01-01 03:00:00,NA\n2024-01-01 04:00:00,\n2024-01-01 05:00:00,7\nsoon,1\n1,2,3\n4\n'
    p = _file(text)
    from loadgrid.sources.files import read_counts
    with pytest.raises(Exception, match="no number"):
        read_readings(spark, _file("t,v\n2024-01-01 01:00:00,abc\n")).select("DateTime").collect()
    got = [(r["stamp"], r["reading"], r["reason"]) for r in read_readings(spark, p, rejects=True).collect()]
    assert [g[2] for g in got] == ["the reading is no number"] * 2 + ["no stamp layout fits"] + ["missing or surplus fields"] * 2
    assert [g[1] for g in got[:2]] == ["abc", "1,234.5"]
    c = read_counts(spark, p).first()
    assert (c["lines"], c["readings"], c["missing"], c["rejects"]) == (8, 1, 2, 5)
    ok = read_readings(spark, _file('t,v\n2024-01-01 01:00:00,"1,5"\n'), decimal_comma=True).first()
    assert ok["Energy"] == 1.5


def test_unreadable_wide_cells_raise_or_are_returned(spark):
    header = ",".join(["Date_"] + [str(q) for q in range(1, 97)])
    good, cell = ["20240101"] + ["1"] * 96, ["20240102"] + ["1"] * 95 + ["x"]
    lines = [header, ",".join(good), ",".join(cell), ",".join(good + ["9"]), ",".join(["tomorrow"] + ["1"] * 96), ",".join(["20240105"] + ["NA"] * 96)]
    p = _file("\n".join(lines) + "\n")
    got = sorted((r["reason"], r["day_quarter"], r["cell"]) for r in read_wide_csv(spark, p, rejects=True).collect())
    assert got == [("missing or surplus fields", None, None), ("the cell is no number", 96, "x"), ("the date is none", None, None)]
    for bad, match in ((lines[2], "quarter 96: the cell is no number"), (lines[3], "missing or surplus fields"), (lines[4], "the date is none")):
        with pytest.raises(Exception, match=match):
            read_wide_csv(spark, _file(header + "\n" + bad + "\n")).select("Energy").collect()
    assert read_wide_csv(spark, _file(header + "\n" + lines[5] + "\n")).where("Energy IS NULL").count() == 96


def test_files_of_one_name_are_refused(spark, tmp_path):
    for folder, name in (("north", "a b.csv"), ("south", "a_b.csv")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / name).write_text("t,v\n2024-01-01 01:00:00,1\n")
    with pytest.raises(ValueError, match="named like meter 'a_b'"):
        read_readings(spark, [str(tmp_path / "north"), str(tmp_path / "south")])


def test_kept_names_are_found_as_given(spark):
    cat = TableCatalog(spark)
    df = spark.range(3).toDF("x")
    cat.keep(" events  hourly", df)
    assert cat.get("events hourly").count() == 3 and cat.entry("events_hourly").kind == "data"
    cat.remove("events   hourly")
    with pytest.raises(TableNotFound):
        cat.get("events_hourly")


def test_snapshots_are_whole_and_refer_to_unchanged_tables(spark, tmp_path):
    root = str(tmp_path)
    cat = TableCatalog(spark)
    a, b = spark.range(4).toDF("x"), spark.range(2).toDF("x")
    cat.keep("a", a)
    cat.keep("b", b)
    cat.keep("also a", a)
    one = cat.store_state(root)
    assert sorted(os.listdir(tmp_path / one)) == ["_catalog", "a", "b"]       # one plan, one folder
    cat.keep("b", spark.range(5).toDF("x"))
    two = cat.store_state(root)
    assert sorted(os.listdir(tmp_path / two)) == ["_catalog", "b"]
    os.makedirs(tmp_path / "state_9999" / "a")                               # broken off: no manifest
    os.makedirs(tmp_path / "state_9999" / "_writing")
    assert cat.snapshots(root) == [one, two]
    back = TableCatalog(spark)
    assert back.load_state(root) == two and back.get("b").count() == 5 and back.get("a").count() == 4
    three = back.store_state(root)
    assert os.listdir(tmp_path / three) == ["_catalog"]                      # unchanged: nothing but the manifest
    assert TableCatalog(spark).load_state(root, one) == one


def test_aligned_years_and_business_hour_profiles_are_empty_by_definition(spark, mk):
    """Their registered queries give 0 rows on any table; here with the reason in view."""
    from loadgrid.operators import compare, select, stats, typical_day
    rows = [("m", T(2022, 1, 1) + dt.timedelta(days=30 * k), 1.0 + k) for k in range(30)]
    view = mk(rows).select("series", F.col("DateTime").alias("DateTimeStart"), "DateTime", "Energy")
    st = stats.energy_stats(view, "Y")
    assert st.count() == 3 and compare.compare_stats(st, st, "Y", "aligned", 1).count() == 0
    assert compare.compare_stats(st, st, "Y", "shifted", 1).count() == 2
    hours = mk([("m", T(2024, 1, 2) + dt.timedelta(hours=k), 1.0) for k in range(48)]).select(
        "series", F.col("DateTime").alias("DateTimeStart"), "DateTime", "Energy")
    assert typical_day.typical_day(hours, "M").count() == 24
    assert typical_day.typical_day(select.select_rows(hours, None, 0, 1), "M").count() == 0


def test_two_thousand_loads_in_one_plan(spark):
    from loadgrid.operators import combine, distribution
    rows = spark.range(2000 * 24).selectExpr("concat('m', id % 2000) series", "timestamp_ntz'2024-01-01' + make_dt_interval(0, int(id div 2000)) DateTimeStart",
                                             "timestamp_ntz'2024-01-01' DateTime", "1.0D Energy")
    names = [f"m{k}" for k in range(2000)]
    g = combine.group_loads(rows, names)
    plan = g._jdf.queryExecution().executedPlan().toString()
    assert plan.count("count_if") == 0 and plan.count("Exchange hashpartitioning") == 1
    assert [r["Energy"] for r in g.collect()] == [2000.0] * 24
    assert distribution.common_stamps(rows, 2000).count() == 48000
    assert combine.group_loads(rows.where("NOT (series = 'm7' AND hour(DateTimeStart) = 3)"), names).count() == 23
    with pytest.raises(Exception, match="holds a stamp twice"):
        combine.group_loads(rows.union(rows.where("series = 'm3'")), names).collect()


def test_stamps_are_only_read_by_layouts_of_their_shape(spark):
    import re

    from loadgrid.functions.time import ntz
    from loadgrid.plans import load
    from loadgrid.sources import files

    layouts = list(dict.fromkeys(files.MONTH_FIRST + files.DAY_FIRST))
    stamps = ["2024/1/5 6:07", "20240105 06:07:08", "5 Jan 2024 6:07", "5 march 2024", "Jan 5 2024", "january 5, 2024 6:07:08", "1/5/2024 6:07:08 pm",
              "13.1.2024", "1-5-2024 6:07", "-1/5/2024", "1/5/2024 6:7", "1/5/24", "soon", "", None]
    df = spark.createDataFrame([(s,) for s in stamps], "s string")
    for row in df.select("s", *[ntz(F.try_to_timestamp("s", F.lit(x))).alias(x) for x in layouts]).collect():
        for x in layouts:
            assert row[x] is None or re.search(files.layout_shape(x), row["s"]), (row["s"], x)
    assert sum(bool(re.search(files.layout_shape(x), "1/5/2024 6:07:08")) for x in files.MONTH_FIRST) == 1
    assert files.layout_shape("d.M.yyyy'T'H") is None
    # what a large set of files holds is parsed once: the load reads the kept table
    path = _file("t,v\n" + "1/5/2024 6:07:08,1\n" * 3)
    assert load.parsed_once(read_readings(spark, path)).inputFiles()[0].endswith("m.csv")
    bytes_, load.LAZY_BYTES = load.LAZY_BYTES, 0
    try:
        kept = load.parsed_once(read_readings(spark, path))
    finally:
        load.LAZY_BYTES = bytes_
    assert all(f.endswith(".parquet") for f in kept.inputFiles()) and kept.count() == 3
