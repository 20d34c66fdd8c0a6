"""The load pipeline: raw readings -> regular load series.

read -> round stamps -> sampling interval -> shift to interval start ->
zero handling -> gap filling -> resample with empty bins -> bin labels.

All meters are one long table keyed by ``series``; the whole pipeline is one
lazy plan with two shuffles (the ``(series, bin)`` aggregation and the
per-series window over aggregated bins) plus a small interval side table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, LoadConfig
from ..functions.joins import LAZY_BYTES, plan_bytes, written
from ..functions.time import meter_time_order, parse_resolution
from ..session import require_utc
from ..operators import clean, fill
from ..operators.resample import resample_bins, stamp_columns

SERIES = "series"
#: Rows of one file of a stored load; the number of files follows the size
#: (adaptive execution merges small ranges, this splits large ones).
MAX_ROWS_PER_FILE = 20_000_000


def load_series(readings: DataFrame, cfg: LoadConfig = DEFAULT, period: str | None = None,
                order: list[str] | None = None, intervals: DataFrame | None = None) -> DataFrame:
    """Readings ``series, DateTime, Energy`` (+ optional tie-break columns named
    in ``order``) -> load table ``series, DateTimeStart, DateTime, Energy``.

    ``period`` overrides ``cfg.time_resolution``. ``DateTime`` of the readings
    should already be rounded to seconds (the sources do it). ``intervals``
    (``series, shift_seconds``) saves inferring the sampling intervals. A
    reading without a stamp is an error: it would belong to no bin.
    """
    require_utc(readings.sparkSession)
    res = period or cfg.time_resolution
    kind, _ = parse_resolution(res)
    order = [c for c in (order or []) if c not in ("DateTime",)]
    stamped = F.coalesce(F.col("DateTime"), F.raise_error(F.lit("a reading has no stamp")).cast("timestamp_ntz"))
    r = readings.select(SERIES, stamped.alias("DateTime"), "Energy", *order)
    need_interval = cfg.measurement_is_before_index
    if need_interval:
        if intervals is None:
            intervals = clean.interval_table(readings, "DateTime", cfg.broadcast_max_rows)
        r = clean.with_shift(r, intervals, cfg.broadcast_max_rows)
        r = clean.shift_to_start(r, ts="DateTime", out="t")
    else:
        # the original adds the interval and takes it off again: a no-op
        r = r.withColumn("shift_seconds", F.lit(0).cast("long")).withColumn("t", F.col("DateTime"))
    if not cfg.zero_values_are_ok:
        r = clean.zero_to_null(r)
    if cfg.fill_zero_energy_to_previous:
        r = fill.fill_gaps(r, ts="t", value="Energy", interpolate=True, ffill=True,
                           bfill=cfg.back_fill, order=order, block=cfg.fill_block)
    how = "mean" if cfg.input_type == "power" else "sum"
    binned = resample_bins(r, res, ts="t", value="Energy", how=how, null_sum=cfg.null_sum,
                           carry=["shift_seconds"])
    return stamp_columns(binned, res, end_stamped=cfg.measurement_is_before_index)


def parsed_once(readings: DataFrame) -> DataFrame:
    """Readings of files for :func:`load_series`, which scans them three times:
    from more than ``LAZY_BYTES`` of files they are parsed once and kept as Parquet."""
    return readings if plan_bytes(readings) <= LAZY_BYTES else written(readings, "readings")


def filtered(load: DataFrame, cfg: LoadConfig = DEFAULT) -> DataFrame:
    """The filtered view every statistic reads: rows with a reading."""
    return clean.filtered_view(load, drop_zeros=cfg.drop_zero_energy)


def store_load(load: DataFrame, path: str, files: int | None = None, layout: str = "time", meter_bits: int = 11) -> DataFrame:
    """Write a load table for repeated analysis and return it read back.

    ``layout``: ``"time"`` -- rows are range-partitioned by ``DateTimeStart``,
    each file covers one stretch of time, for queries by date; ``"mixed"`` --
    by a Z-order of meters and days (see ``meter_time_order``), for queries by
    meter, by date or by both.
    In either case a hot meter lies in many files. Inside a file the rows are
    sorted by ``series, DateTimeStart``, and a Parquet Bloom filter on
    ``series`` stands beside the min/max statistics: range and key predicates
    (``operators.select``) are pushed into the scan and skip row groups.
    """
    if layout not in ("time", "mixed"):
        raise ValueError(f"unknown layout {layout!r}")
    by = F.col("DateTimeStart") if layout == "time" else meter_time_order(SERIES, "DateTimeStart", meter_bits)
    ordered = load.repartitionByRange(files, by) if files else load.repartitionByRange(by)
    (ordered.sortWithinPartitions(SERIES, "DateTimeStart").write.option("maxRecordsPerFile", MAX_ROWS_PER_FILE)
            .option(f"parquet.bloom.filter.enabled#{SERIES}", "true").mode("overwrite").parquet(path))
    return load.sparkSession.read.parquet(path)
