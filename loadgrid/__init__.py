"""loadgrid -- metered load-series analytics on Spark DataFrames.

Long table model: every meter is a ``series`` key of one DataFrame
``series, DateTimeStart, DateTime, Energy``; every operator is a lazy
DataFrame -> DataFrame transformation planned by Catalyst.
"""

from .config import DEFAULT, LoadConfig  # noqa: F401

__version__ = "0.1.0"
