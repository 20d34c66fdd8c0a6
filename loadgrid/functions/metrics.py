"""Difference and percent expressions used by the comparison operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the guard added to every percent divisor, ten double epsilons.
EPS = 10 * 2.220446049250313e-16


def diff(a: Column, b: Column) -> Column:
    return a - b


def pct_of_b(a: Column, b: Column) -> Column:
    """``(a - b) / (eps + b) * 100``."""
    return (a - b) / (F.lit(EPS) + b) * F.lit(100.0)


def pct_of_a_first(a: Column, b: Column) -> Column:
    """``100 * (a - b) / (eps + a)``."""
    return F.lit(100.0) * (a - b) / (F.lit(EPS) + a)


def pct_of_b_first(a: Column, b: Column) -> Column:
    """``100 * (a - b) / (eps + b)``."""
    return F.lit(100.0) * (a - b) / (F.lit(EPS) + b)


def pct_div100_times(a: Column, b: Column) -> Column:
    """``(a - b) / 100 * (eps + a)`` -- the distribution comparison as written."""
    return (a - b) / F.lit(100.0) * (F.lit(EPS) + a)


def pct_over_100a(a: Column, b: Column) -> Column:
    """``(a - b) / (100 * (eps + a))`` -- the typical-day comparison as written."""
    return (a - b) / (F.lit(100.0) * (F.lit(EPS) + a))


def pct_consistent(a: Column, b: Column) -> Column:
    """``(a - b) / (eps + a) * 100``, the ``percent_mode='consistent'`` form."""
    return (a - b) / (F.lit(EPS) + a) * F.lit(100.0)


def share(part: Column, whole: Column) -> Column:
    """``part / whole * 100``; NULL when ``whole`` is 0 (no ANSI error, no inf)."""
    return F.try_divide(part, whole) * F.lit(100.0)
