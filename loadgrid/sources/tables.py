"""Readings from any Spark table: pick the series key, the stamp and the value.

This is how stored tables (Parquet, Delta, a catalog table) become the long
readings table the load pipeline consumes; the scan keeps column pruning and
predicate pushdown because only three columns are projected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import round_to_second

SERIES = "series"


def readings_from_table(df: DataFrame, ts: str, value: str, series: str | Column | None = None,
                        name: str | None = None, order: list[str] | None = None,
                        total: str | None = None) -> DataFrame:
    """``series, DateTime, Energy`` (+ ``order`` columns) from a table.

    ``series`` is a column name/expression giving the meter key, or ``name``
    a constant key for a single-meter table. ``total`` adds a further series of
    that name holding every reading (the all-loads total), produced by one scan
    (``explode`` of the two keys) rather than a second read.
    """
    if series is None and name is None:
        raise ValueError("give a series column or a constant name")
    key = F.lit(name) if series is None else (F.col(series) if isinstance(series, str) else series)
    if total is not None:
        key = F.explode(F.array(key, F.lit(total)))
    v = F.col(value).cast("double")
    v = F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)
    cols = [key.alias(SERIES), round_to_second(F.col(ts).cast("timestamp_ntz")).alias("DateTime"), v.alias("Energy")]
    cols += [F.col(c) for c in (order or [])]
    return df.select(*cols)
