"""Column expressions on TIMESTAMP_NTZ stamps: rounding, period keys, labels.

Everything here builds a Catalyst expression (no Python per row). Some
built-ins return a zoned TIMESTAMP or a DATE for an NTZ input; those results
are cast back to TIMESTAMP_NTZ (exact under the UTC session zone the library
pins, see ``loadgrid.session``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import PERIODS
from ..session import require_utc

_TRUNC_UNIT = {"H": "hour", "D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}
_STEP_SQL = {"H": "INTERVAL 1 HOUR", "D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAYS",
             "M": "INTERVAL 1 MONTH", "Q": "INTERVAL 3 MONTHS", "Y": "INTERVAL 12 MONTHS"}
_MIN_RE = re.compile(r"^\s*(\d+)\s*(min|t|minutes?)\s*$", re.I)


def ntz(c: Column) -> Column:
    """Cast back to wall time; only right where the session zone is UTC."""
    require_utc()
    return c.cast("timestamp_ntz")


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_resolution(res: str) -> tuple[str, int]:
    """``'H'`` -> ('H', 60); ``'15min'`` -> ('min', 15). Sub-hourly grids must
    divide a day, so bins align to midnight as they do in the original."""
    if res in PERIODS:
        return res, {"H": 60, "D": 1440}.get(res, 0)
    m = _MIN_RE.match(res)
    if not m:
        raise ValueError(f"unsupported resolution {res!r}; use one of {PERIODS} or '<N>min'")
    n = int(m.group(1))
    if n <= 0 or 1440 % n:
        raise ValueError(f"a minute grid must divide a day, got {n} minutes")
    if n == 60:
        return "H", 60
    if n == 1440:
        return "D", 1440
    return "min", n


def round_to_second(c) -> Column:
    """Round to the nearest second (half up; see SURVEY Q19). Integer
    arithmetic on epoch microseconds (about twice as fast as ``date_trunc``,
    which converts through the session zone per row)."""
    us = F.unix_micros(col_(c).cast("timestamp")) + F.lit(500000)
    return ntz(F.timestamp_micros(F.floor(us / F.lit(1000000)) * F.lit(1000000)))


def period_start(c, period: str) -> Column:
    """Start of the period that contains the stamp (weeks start on Monday)."""
    kind, n = parse_resolution(period)
    c = col_(c)
    if kind == "min":
        day = ntz(F.date_trunc("day", c))
        mins = F.hour(c) * 60 + F.minute(c)
        return F.timestamp_add("MINUTE", F.floor(mins / F.lit(n)).cast("int") * F.lit(n), day)
    return ntz(F.date_trunc(_TRUNC_UNIT[kind], c))


def period_label(start, period: str) -> Column:
    """Bin label of a resampled series: the bin start for H / D / minute grids,
    the period's last day at 00:00 for W / M / Q / Y."""
    kind, _ = parse_resolution(period)
    s = col_(start)
    if kind in ("H", "D", "min"):
        return s
    if kind == "W":
        return F.timestamp_add("DAY", F.lit(6), s)
    if kind == "M":
        return ntz(F.last_day(s))
    if kind == "Q":
        return ntz(F.last_day(F.add_months(s, 2)))
    return ntz(F.make_date(F.year(s), F.lit(12), F.lit(31)))


def step_sql(period: str) -> str:
    kind, n = parse_resolution(period)
    return f"INTERVAL {n} MINUTES" if kind == "min" else _STEP_SQL[kind]


def add_step(c, period: str, k: int = 1) -> Column:
    """Move a period start by ``k`` periods."""
    kind, n = parse_resolution(period)
    c = col_(c)
    if kind == "min":
        return F.timestamp_add("MINUTE", F.lit(k * n), c)
    if kind == "H":
        return F.timestamp_add("HOUR", F.lit(k), c)
    if kind == "D":
        return F.timestamp_add("DAY", F.lit(k), c)
    if kind == "W":
        return F.timestamp_add("DAY", F.lit(7 * k), c)
    months = {"M": 1, "Q": 3, "Y": 12}[kind] * k
    return F.timestamp_add("MONTH", F.lit(months), c)


def period_ordinal(c, period: str) -> Column:
    """Integer index of the period containing ``c`` (consecutive periods differ
    by 1): the equi-join key of shifted comparisons."""
    kind, n = parse_resolution(period)
    c = col_(c)
    epoch_days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date"))
    if kind == "min":
        return ((epoch_days.cast("long") * 1440 + F.hour(c) * 60 + F.minute(c)) / n).cast("long")
    if kind == "H":
        return epoch_days.cast("long") * 24 + F.hour(c)
    if kind == "D":
        return epoch_days.cast("long")
    if kind == "W":  # 1970-01-05 is a Monday
        return F.floor(F.datediff(F.to_date(c), F.lit("1970-01-05").cast("date")) / 7).cast("long")
    if kind == "M":
        return (F.year(c) * 12 + F.month(c) - 1).cast("long")
    if kind == "Q":
        return (F.year(c) * 4 + F.quarter(c) - 1).cast("long")
    return F.year(c).cast("long")


def seconds_between(a, b) -> Column:
    """``b - a`` in whole seconds (NTZ safe)."""
    return F.timestamp_diff("SECOND", col_(a), col_(b))


def shift_seconds(c, secs) -> Column:
    """``c + secs`` seconds; ``secs`` may be a column."""
    s = secs if isinstance(secs, Column) else F.lit(int(secs))
    return F.timestamp_add("SECOND", s, col_(c))


def weekday_mon0(c) -> Column:
    """Day of week with Monday = 0 ... Sunday = 6."""
    return F.weekday(col_(c))


def seconds_of_day(c) -> Column:
    c = col_(c)
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def _spread(c: Column) -> Column:
    """The 16 bits of ``c`` at every second place."""
    for by, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        c = c.bitwiseOR(F.shiftleft(c, by)).bitwiseAND(F.lit(mask))
    return c


def meter_time_order(series, ts, meter_bits: int = 11) -> Column:
    """Place on a space-filling (Z-order) curve over meters, by a hash of
    ``meter_bits`` bits, and days: stretches of it hold some meters for some
    time, whichever of the two a query names. The two weigh the same when the
    table spans about 2 ** meter_bits days."""
    meter = F.pmod(F.xxhash64(col_(series)), F.lit(1 << meter_bits))
    day = F.pmod(F.datediff(F.to_date(col_(ts)), F.lit("1970-01-01").cast("date")), F.lit(1 << 16)).cast("long")
    return _spread(meter).bitwiseOR(F.shiftleft(_spread(day), 1))
