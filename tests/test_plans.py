"""Plan checks: no Python UDFs, no cartesian products, partitioned windows,
pushed-down range filters, partial aggregation before the shuffle."""

from __future__ import annotations

import pytest

import registry

SF = "/root/testdata/sf0.001"

CHECKED = ["resample_hour_sum", "stats_month", "stats_orders_y", "typical_day_week",
           "distribution_share_residual", "compare_stats_aligned_month", "compare_distribution",
           "compare_typical_day", "interpolate_linear", "group_loads", "select_days"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_plan_shape(spark, name):
    p = _plan(registry.QUERIES[name](spark, SF))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin",
                "SinglePartition"):
        assert bad not in p, f"{name}: {bad} in plan"


def test_range_filter_pushed_to_scan(spark):
    from loadgrid.operators.select import filter_range
    import tempfile
    root = tempfile.mkdtemp(prefix="lg-push-")
    from loadgrid.plans.load import store_load
    load = registry.TQ.events_load(spark, SF, "H")
    stored = store_load(load, root)
    assert stored.count() == load.count()
    plan = _plan(filter_range(stored, "2024-01-05", "2024-01-10"))
    assert "PushedFilters: [IsNotNull(DateTime), GreaterThanOrEqual(DateTime" in plan


def test_interval_side_is_sort_free(spark):
    from loadgrid.operators import clean
    r = registry.TQ.events_readings(spark, SF)
    p = _plan(clean.interval_table(r))
    assert "Window" not in p and "Sort " not in p


def test_shift_side_table_broadcast_and_fallback(spark, monkeypatch):
    from pyspark.sql import functions as F
    from loadgrid.config import DEFAULT
    from loadgrid.functions import joins
    from loadgrid.operators import clean
    r = registry.TQ.events_readings(spark, SF)
    small = registry.TQ.events_load(spark, SF, "H")
    assert "BroadcastHashJoin" in _plan(small)                # proven by the plan's statistics
    monkeypatch.setattr(joins, "LAZY_BYTES", 0)
    counted = registry.TQ.events_load(spark, SF, "H")         # proven by the written table's counts
    assert "BroadcastHashJoin" in _plan(counted) and "/loadgrid/side-" in _plan(counted).replace("...", "/loadgrid/side-")
    # above the bound the side table is not hinted for broadcast; same result
    big = registry.TQ.events_load(spark, SF, "H", DEFAULT.with_(broadcast_max_rows=2))
    rows = [x.orderBy("series", "DateTimeStart").collect() for x in (small, counted, big)]
    assert rows[0] == rows[1] == rows[2]
    joined = clean.with_shift(r, None, max_rows=2)
    assert joined.where(F.col("shift_seconds").isNull()).count() == 0


def _value_scans(plan: str) -> int:
    """Scans of more than series and stamp, the two columns that the sampling interval needs."""
    import re
    return sum(x.count(",") > 1 for x in re.findall(r"FileScan parquet \[([^\]]*)\]", plan))


def _exchanges(plan: str) -> list[str]:
    return [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]


@pytest.mark.parametrize("name", ["business_days", "non_business_days", "select_days", "stats_day_business"])
def test_calendar_and_key_lists_do_not_shuffle_the_load(spark, name):
    """P1: no exchange by date; at most the load's own by series (and bin) and the statistics' by period."""
    p = _plan(registry.QUERIES[name](spark, SF))
    assert "SortMergeJoin" not in p
    assert not any("DateTimeStart" in x for x in _exchanges(p))   # the holiday list may be made distinct


@pytest.mark.parametrize("name", ["stats_month", "stats_orders_y", "stats_orders_q", "stats_lineitem_month"])
def test_statistics_read_the_rows_once(spark, name):
    """P3: one scan, one aggregation of the hourly rows, no sort aggregate on them."""
    p = _plan(registry.QUERIES[name](spark, SF))
    assert _value_scans(p) == 1
    cells = [x for x in p.splitlines() if "Aggregate" in x and "var_pop" in x]
    assert cells and not any("SortAggregate" in x for x in cells)


def _final(df) -> str:
    df.collect()
    return _plan(df).split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", ["interpolate_linear", "forward_fill", "back_fill", "load_with_fill"])
def test_fills_exchange_the_readings_once(spark, name):
    """P2: both steps read one exchange by (series, block); nothing is cached or written."""
    p = _final(registry.QUERIES[name](spark, SF))
    assert p.count("REPARTITION_BY_COL") - p.count("ReusedExchange") <= 1 and "ReusedExchange" in p
    assert "InMemory" not in p.replace("InMemoryFileIndex", "") and "ExistingRDD" not in p


@pytest.mark.parametrize("name", ["stats_day", "resample_hour_sum", "compare_distribution", "compare_typical_day", "interpolate_linear"])
def test_building_a_plan_starts_no_job(spark, name):
    """P1, P3: small readings need no side table written and counted first (opening the table reads its footer)."""
    spark.sparkContext.setJobGroup(f"build-{name}", name)
    spark.read.parquet(f"{SF}/events.parquet")
    tracker, group = spark.sparkContext.statusTracker(), f"build-{name}"
    before = len(tracker.getJobIdsForGroup(group))
    registry.QUERIES[name](spark, SF)
    assert len(tracker.getJobIdsForGroup(group)) - before <= 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name", ["typical_day_week", "typical_day_all", "typical_day_orders_quarter"])
def test_typical_days_are_hash_aggregations(spark, name):
    """P4: one exchange of the hourly rows by series and group; no sort aggregate."""
    p = _plan(registry.QUERIES[name](spark, SF))
    assert "SortAggregate" not in p and p.count("REPARTITION_BY_COL") == 1


@pytest.mark.parametrize("name", ["compare_distribution", "compare_stats_shifted_month", "compare_typical_day_week"])
def test_self_comparisons_scan_once(spark, name):
    """P3: a window or one aggregation by period; no join of the table with itself."""
    p = _plan(registry.QUERIES[name](spark, SF))
    assert p.count("FileScan parquet") <= 3 and "SortMergeJoin" not in p and "ExistingRDD" not in p


def test_resampling_a_known_grid_runs_the_load_once(spark):
    p = _plan(registry.QUERIES["resample_loaded_day"](spark, SF))
    assert _value_scans(p) == 1


def test_stored_loads_skip_by_meter_and_day(spark, tmp_path):
    """Key lists and the bounds of picked days reach the scan; files cover some meters for some time."""
    import glob

    import pyarrow.parquet as pq

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        p = _plan(registry.QUERIES["stored_load_meters"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(x for x in p.splitlines() if "FileScan parquet" in x and "PushedFilters" in x)
    assert "In(series, [click,view])" in scan and "GreaterThanOrEqual(DateTimeStart" in scan and "LessThan(DateTimeStart" in scan
    from loadgrid.operators.select import select_keys
    from loadgrid.plans.load import store_load
    rows = spark.range(40 * 24 * 60).selectExpr("concat('m', id % 40) series", "timestamp_ntz'2024-01-01' + make_dt_interval(0, int(id div 40)) DateTimeStart",
                                                "timestamp_ntz'2024-01-01' DateTime", "1.0D Energy")
    stored = store_load(rows, str(tmp_path / "z"), files=16, layout="mixed", meter_bits=6)
    assert stored.count() == rows.count()
    spans = []
    for f in glob.glob(f"{tmp_path}/z/*.parquet"):
        t = pq.read_table(f, columns=["series", "DateTimeStart"])
        spans.append((len(set(t["series"].to_pylist())), len({d.date() for d in t["DateTimeStart"].to_pylist()})))
    assert max(m for m, _ in spans) < 40 and max(d for _, d in spans) < 60       # neither all meters nor all days
    many = select_keys(stored, "series", [f"m{k}" for k in range(5, 1200)])
    assert "(series#" in _plan(many) and many.select("series").distinct().count() == 35
    assert select_keys(stored, "series", []).count() == 0
