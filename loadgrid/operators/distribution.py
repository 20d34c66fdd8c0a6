"""Distribution of consumption over several loads, per period.

Long form throughout: the loads are rows of one table, so N loads cost one
aggregation, not N aggregations and an N-way join. The wide output
(``<load>__sum`` ...) is made from the aggregated rows, one per period and
load, over the known load names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, LoadConfig
from ..functions.metrics import share
from ..functions.time import period_start
from .combine import once
from .resample import to_hourly

SERIES = "series"
OTHER = "other_loads"


def common_stamps(view: DataFrame, n_loads: int, ts: str = "DateTimeStart") -> DataFrame:
    """``series, <ts>, Energy`` at the stamps present in all ``n_loads``
    loads. A stamp that a load holds twice is an error, not a double count
    (SURVEY Q17). The rows are exchanged once, by stamp: a hash aggregation by
    stamp and load finds repeats, one window of at most ``n_loads`` rows a
    stamp counts the loads."""
    each = view.select(SERIES, ts, "Energy").repartition(ts).groupBy(ts, SERIES).agg(F.count(F.lit(1)).alias("__own"), F.max("Energy").alias("Energy"))
    loads = F.count(F.lit(1)).over(Window.partitionBy(ts))
    return each.withColumn("__c", loads).where(once("aligned", "__own") & (F.col("__c") == n_loads)).select(SERIES, ts, "Energy")


def _c(load: str, stat: str):
    return F.col(f"`{load}__{stat}`")


def energy_distribution(view: DataFrame, loads: list[str], period: str = "M", resolution: str = "H",
                        cfg: LoadConfig = DEFAULT, total_first: bool = False,
                        same_count: bool | None = None) -> DataFrame:
    """``period_start`` + per load ``<load>__sum, __mean, __count`` (and, with a
    total as the first load, ``__percentage`` and the ``other_loads`` residual).

    ``same_count`` (default from the config): only stamps common to all loads;
    otherwise every load is aggregated on its own rows and only periods
    present in all loads are kept.
    """
    if not loads:
        raise ValueError("no loads given")
    if len(set(loads)) != len(loads):
        raise ValueError("a load is listed twice")
    same_count = cfg.same_count if same_count is None else same_count
    v = to_hourly(view.where(F.col(SERIES).isin(loads)), resolution, cfg.input_type) \
        .select(SERIES, "DateTimeStart", "Energy")
    if same_count:
        v = common_stamps(v, len(loads))
    e = F.col("Energy")
    long = v.groupBy(period_start(F.col("DateTimeStart"), period).alias("period_start"), SERIES).agg(
        F.coalesce(F.sum(e), F.lit(0.0)).alias("sum"), F.avg(e).alias("mean"), F.count(e).alias("count"))
    aggs = [F.max(F.when(F.col(SERIES) == F.lit(ld), F.col(k))).alias(f"{ld}__{k}")
            for ld in loads for k in ("sum", "mean", "count")]
    out = long.groupBy("period_start").agg(F.count(F.lit(1)).alias("__loads"), *aggs) \
        .where(F.col("__loads") == len(loads)).drop("__loads")
    if not total_first:
        return out
    first = _c(loads[0], "sum")
    cols = [F.col("period_start")]
    for ld in loads:
        cols += [_c(ld, "sum"), _c(ld, "mean"), _c(ld, "count"), share(_c(ld, "sum"), first).alias(f"{ld}__percentage")]
    rest = F.lit(2.0) * first - sum((_c(ld, "sum") for ld in loads), F.lit(0.0))
    mean = F.lit(2.0) * _c(loads[0], "mean") - sum((_c(ld, "mean") for ld in loads), F.lit(0.0))
    return out.select(*cols, rest.alias(f"{OTHER}__sum"), mean.alias(f"{OTHER}__mean"),
                      share(rest, first).alias(f"{OTHER}__percentage"))


def distribution_loads(loads: list[str], total_first: bool) -> list[str]:
    """Load names of a distribution table, residual included."""
    return list(loads) + ([OTHER] if total_first else [])
