"""Names of series, column groups and filter settings (plan-time only)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the original tool's labels.
# Period code -> word used in column-group names.
PERIOD_WORDS = {"M": "Monthly", "D": "Daily", "Y": "Yearly", "W": "Weekly", "Q": "Quarterly", "H": "Hourly"}
# Business-day filter code -> label.
BDAY_LABELS = {0: "all_days", 1: "business_days_only", 2: "non_business_days_only"}
# Business-hour filter code -> label.
BHOUR_LABELS = {0: "all_hours", 1: "business_hours_only", 2: "non_business_hours_only"}


def period_word(period: str) -> str:
    try:
        return PERIOD_WORDS[period]
    except KeyError:
        raise ValueError(f"unknown period {period!r}; known: {', '.join(PERIOD_WORDS)}") from None


def bday_label(code: int) -> str:
    try:
        return BDAY_LABELS[code]
    except KeyError:
        raise ValueError(f"business-day mode must be 0, 1 or 2, got {code!r}") from None


def bhour_label(code: int) -> str:
    try:
        return BHOUR_LABELS[code]
    except KeyError:
        raise ValueError(f"business-hour mode must be 0, 1 or 2, got {code!r}") from None


def rows_group(period: str) -> str:
    """Column group of the per-row statistics, e.g. ``Monthly_Energy_Hourly_Stats``."""
    return f"{period_word(period)}_Energy_Hourly_Stats"


def table_key(name: str) -> str:
    """Trim and replace inner runs of white space by ``_``."""
    return re.sub(r"\s+", "_", name.strip())


def series_name_from_file(file_name: str, period: str | None = None, default_period: str = "H") -> str:
    """Series key from a file name: drop the extension, trim, white space to
    ``_``, and append ``_period_<p>`` for a non-default period."""
    base = file_name.rsplit(".", 1)[0] if "." in file_name else file_name
    name = table_key(base)
    if period is not None and period != default_period:
        name = f"{name}_period_{period}"
    return name


def series_name_column(file_name: Column, period: str | None = None, default_period: str = "H") -> Column:
    """Column form of :func:`series_name_from_file` for ``_metadata.file_name``
    (which is URL-encoded: decoded first, a literal ``+`` kept as is)."""
    decoded = F.url_decode(F.regexp_replace(file_name, r"\+", "%2B"))
    base = F.regexp_replace(decoded, r"\.[^.]*$", "")
    name = F.regexp_replace(F.trim(base), r"\s+", "_")
    if period is not None and period != default_period:
        name = F.concat(name, F.lit(f"_period_{period}"))
    return name


def stat_col(group: str, stat: str) -> str:
    """Flat name of a two-level column ``(group, stat)``."""
    return f"{group}__{stat}"
