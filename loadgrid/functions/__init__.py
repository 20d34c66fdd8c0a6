"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from . import calendar, joins, metrics, naming, time  # noqa: F401
