"""Combining tables: grouping loads into one, concatenation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import shift_seconds

SERIES = "series"


def per_stamp(rows: DataFrame, *aggs: Column, ts: str = "DateTimeStart") -> DataFrame:
    """One row per stamp: ``loads`` (loads that have it), ``held`` (the most
    rows that one load has there) and ``aggs`` over the loads' sums ``e``.
    The rows are exchanged once, by stamp; two hash aggregations follow, by
    stamp and load and by stamp, whose size does not depend on the number of
    loads."""
    each = rows.select(SERIES, ts, "Energy").repartition(ts).groupBy(ts, SERIES).agg(F.count(F.lit(1)).alias("c"), F.sum("Energy").alias("e"))
    return each.groupBy(ts).agg(F.count(F.lit(1)).alias("loads"), F.max("c").alias("held"), *aggs)


def once(what: str, held: str = "held") -> Column:
    """True; raises where a load holds a stamp twice."""
    twice = F.raise_error(F.lit(f"a load holds a stamp twice: loads can't be {what}")).cast("boolean")
    return F.when(F.col(held) > 1, twice).otherwise(F.lit(True))


def group_loads(load: DataFrame, names: list[str], name: str = "Grouped") -> DataFrame:
    """Sum several loads into one series at the stamps present in all of them
    (a missing reading counts as 0). ``DateTime`` = stamp + 1h whatever the
    resolution, as in the original (SURVEY Q15). A stamp repeated inside a load
    raises instead of double counting. See :func:`per_stamp` for the plan."""
    n = len(names)
    if n == 0:
        raise ValueError("no loads given")
    if len(set(names)) != n:
        raise ValueError("a load is listed twice")
    g = per_stamp(load.where(F.col(SERIES).isin(list(names))), F.sum(F.coalesce(F.col("e"), F.lit(0.0))).alias("Energy"))
    keep = once("grouped") & (F.col("loads") == n)
    return g.where(keep).select(F.lit(name).alias(SERIES), "DateTimeStart",
                                shift_seconds("DateTimeStart", 3600).alias("DateTime"),
                                F.coalesce(F.col("Energy"), F.lit(0.0)).alias("Energy"))


def concatenate(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both tables (duplicates kept); columns aligned by name, a
    column missing on one side is NULL there."""
    return a.unionByName(b, allowMissingColumns=True)
