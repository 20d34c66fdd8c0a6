"""Queries over the provided tables, one per operator (the check harness).

Inputs are mapped onto the load-series model:

* ``events(ts, event_type, value)`` -> one load per event type plus ``total``
  (every event), raw stamps; resampled to hours.
* ``orders(o_orderdate, o_totalprice, o_orderpriority)`` -> one daily load per
  order priority.
* ``lineitem(l_shipdate, l_discount | l_quantity, l_returnflag)`` -> daily loads
  per return flag; ``l_discount`` has exact zeros, which the cleaning
  operators turn into missing readings.

Every query reads whole tables. Registration rounds double columns
(``quantized``, same arithmetic as the SQL twins) so the value hash of the
check is stable against summation order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, LoadConfig
from ..sources.tables import readings_from_table
from .load import filtered, load_series

EVENT_TOTAL = "total"
# (l_orderkey, l_linenumber) repeats within a ship date in the provided data;
# with part and supplier keys the order of equal stamps is total, which the
# position-based fills need to be deterministic.
LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


# Grid of the check harness: 7 significant digits, and 1e-8 for small values
# (so noise around 0 is 0). Its boundaries sit at a non-decimal offset, so exact
# decimal values never fall on one, where summation-order noise would flip them.
QUANT_OFFSET = 0.3183098861837907


def quantize(c: Column) -> Column:
    """Scales are integer powers of ten, which both engines compute alike."""
    off = F.lit(QUANT_OFFSET)
    e = F.greatest(F.floor(F.log10(F.greatest(F.abs(c), F.lit(1e-300)))) - F.lit(6), F.lit(-8))
    up, down = F.pow(F.lit(10.0), -e), F.pow(F.lit(10.0), e)
    return F.when(e < 0, F.floor(c * up + off) / up).otherwise(F.floor(c / down + off) * down)


def quantized(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(quantize(F.col(f"`{f.name}`")).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- readings -------------------------------------------------------------

def events_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_from_table(table(spark, sf_dir, "events"), ts="ts", value="value",
                               series="event_type", total=EVENT_TOTAL, order=["event_id"])


def orders_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_from_table(table(spark, sf_dir, "orders"), ts="o_orderdate", value="o_totalprice",
                               series="o_orderpriority", order=["o_orderkey"])


def orders_hourly_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders spread over the hours of their day by their key: seven years of hours."""
    o = table(spark, sf_dir, "orders")
    at = F.timestamp_add("HOUR", F.pmod(F.col("o_orderkey"), F.lit(24)).cast("int"), F.col("o_orderdate").cast("timestamp_ntz"))
    return readings_from_table(o.withColumn("at", at), ts="at", value="o_totalprice",
                               series="o_orderpriority", order=["o_orderkey"])


def lineitem_readings(spark: SparkSession, sf_dir: str, value: str = "l_quantity") -> DataFrame:
    return readings_from_table(table(spark, sf_dir, "lineitem"), ts="l_shipdate", value=value,
                               series="l_returnflag", order=LINEITEM_ORDER)


# -- loads ----------------------------------------------------------------

def events_load(spark: SparkSession, sf_dir: str, period: str = "H", cfg: LoadConfig = DEFAULT) -> DataFrame:
    return load_series(events_readings(spark, sf_dir), cfg, period=period, order=["event_id"])


def orders_load(spark: SparkSession, sf_dir: str, period: str = "D", cfg: LoadConfig = DEFAULT) -> DataFrame:
    return load_series(orders_readings(spark, sf_dir), cfg, period=period, order=["o_orderkey"])


def lineitem_load(spark: SparkSession, sf_dir: str, period: str = "D", cfg: LoadConfig = DEFAULT,
                  value: str = "l_quantity") -> DataFrame:
    return load_series(lineitem_readings(spark, sf_dir, value), cfg, period=period,
                       order=LINEITEM_ORDER)


def events_view(spark: SparkSession, sf_dir: str, cfg: LoadConfig = DEFAULT) -> DataFrame:
    return filtered(events_load(spark, sf_dir, "H", cfg), cfg)


def orders_hourly_view(spark: SparkSession, sf_dir: str, cfg: LoadConfig = DEFAULT) -> DataFrame:
    return filtered(load_series(orders_hourly_readings(spark, sf_dir), cfg, "H", order=["o_orderkey"]), cfg)
