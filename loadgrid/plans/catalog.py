"""Named tables: keep, look up, remove, save, snapshot and restore.

The original keeps results in an in-memory dict of pandas frames and pickles
it. Here a named table is a temp view plus a small metadata record (kind,
period); saving writes CSV or Parquet through the DataFrame writer, and a
snapshot is one Parquet folder per table plus a ``_catalog`` table, under a
shared root (on a cluster a distributed file system path).
"""

from __future__ import annotations

from dataclasses import dataclass
import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, LoadConfig
from ..functions.naming import table_key
from ..operators import compare, distribution, resample, select, stats, typical_day
from ..operators.combine import concatenate, group_loads
from .load import filtered, load_series, store_load

# Fixed values that must equal the original tool's kinds of tables.
KINDS = ("energy_data", "energy_stats_data", "energy_distribution", "energy_stats_comparison",
         "energy_distribution_comparison", "typical_day", "typical_day_comparison", "data")

CATALOG_SCHEMA = T.StructType([T.StructField("name", T.StringType(), False),
                               T.StructField("kind", T.StringType(), False),
                               T.StructField("period", T.StringType(), True),
                               T.StructField("path", T.StringType(), False)])


#: Columns that order a table's rows for ``head``, whatever its kind.
KEY_ORDER = ("DateTimeStart", "period_start", "period_start_1", "period_start_2", "year", "quarter", "month", "week",
             "year_1", "quarter_1", "month_1", "week_1", "hour")


class TableNotFound(KeyError):
    """No kept table has that name."""


class KindMismatch(ValueError):
    """Tables of different kinds cannot be combined."""


class NoCommonStamp(ValueError):
    """The grouped loads share no timestamp."""


@dataclass
class Entry:
    df: DataFrame
    kind: str
    period: str | None


def _now() -> str:
    return dt.datetime.now().strftime("%Y-%m-%d_%H-%M-%S-%f")


def _join(root: str, *parts: str) -> str:
    return "/".join([root.rstrip("/"), *parts])


class TableCatalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._t: dict[str, Entry] = {}
        self.last: tuple[str, Entry] | None = None
        self._stored: dict[tuple[str, int], str] = {}      # (root, plan) -> folder in the last snapshot
        self._held: list[DataFrame] = []
        self.session = _now()      # names the output folder of this session

    # -- registry ---------------------------------------------------------
    def keep(self, name: str, df: DataFrame, kind: str = "data", period: str | None = None) -> str:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        name = table_key(name)
        self._t[name] = Entry(df, kind, period)
        df.createOrReplaceTempView(f"`{name}`")
        self.last = (name, self._t[name])
        return name

    def require(self, *names: str) -> None:
        missing = [n for n in names if table_key(n) not in self._t]
        if missing:
            raise TableNotFound(f"no table is kept as {', '.join(missing)}")

    def entry(self, name: str) -> Entry:
        self.require(name)
        return self._t[table_key(name)]

    def get(self, name: str) -> DataFrame:
        return self.entry(name).df

    def remove(self, *names: str) -> None:
        self.require(*names)
        for n in {table_key(n): None for n in names}:
            del self._t[n]
            self.spark.catalog.dropTempView(f"`{n}`")

    def names(self, kind: str | None = None) -> list[str]:
        return [n for n, e in self._t.items() if kind is None or e.kind == kind]

    # -- combining commands with the original's checks ---------------------
    def concatenate(self, a: str, b: str, name: str | None = None) -> str:
        ea, eb = self.entry(a), self.entry(b)
        if ea.kind != eb.kind:
            raise KindMismatch(f"{a!r} is a {ea.kind} table and {b!r} a {eb.kind} table")
        return self.keep(name or f"concat__{a}__{b}", concatenate(ea.df, eb.df), ea.kind, ea.period)

    def group(self, table: str, series: list[str], name: str = "Grouped") -> str:
        e = self.entry(table)
        g = group_loads(e.df, series, name)
        if g.isEmpty():
            raise NoCommonStamp(f"the loads {series} have no stamp in common")
        return self.keep(name, g, e.kind, e.period)

    # -- analysis commands over named tables --------------------------------
    def _view(self, key: str, time_interval, bdays: int, bhours: int, holidays, cfg: LoadConfig) -> DataFrame:
        e = self.entry(key)
        if e.kind != "energy_data":
            raise KindMismatch(f"{key!r} is a {e.kind} table, not a load")
        v = filtered(e.df, cfg)
        if time_interval is not None or bdays or bhours:
            v = select.select_rows(v, time_interval, bdays, bhours, holidays=holidays, cfg=cfg)
        return v

    @staticmethod
    def _label(prefix: str, key: str, period: str, time_interval, bdays: int, bhours: int) -> str:
        parts = [prefix, key, period]
        if time_interval is not None:
            parts += [str(time_interval[0]), str(time_interval[1])]
        parts += [{1: "bdays", 2: "no_bdays"}[bdays]] if bdays else []
        parts += [{1: "bhours", 2: "no_bhours"}[bhours]] if bhours else []
        return "__".join(parts)

    def load(self, name: str, readings: DataFrame, period: str | None = None, cfg: LoadConfig = DEFAULT,
             order: list[str] | None = None, store: str | None = None) -> str:
        """Load readings (one or many series) as a named load table; with
        ``store`` (a shared path) the load is written once and every later
        command reads the stored table."""
        p = period or cfg.time_resolution
        df = load_series(readings, cfg, p, order)
        if store:
            df = store_load(df, store)
        return self.keep(name, df, "energy_data", p)

    def resample(self, key: str, period: str, name: str | None = None, cfg: LoadConfig = DEFAULT) -> str:
        e = self.entry(key)
        out = resample.resample_loaded(e.df, period, resolution=e.period, input_type=cfg.input_type,
                                       max_rows=cfg.broadcast_max_rows)
        return self.keep(name or f"{key}__{period}", out, e.kind, period)

    def energy_stats(self, key: str, period: str, time_interval=None, bdays: int = 0, bhours: int = 0,
                     holidays: DataFrame | None = None, name: str | None = None, cfg: LoadConfig = DEFAULT) -> str:
        e = self.entry(key)
        v = self._view(key, time_interval, bdays, bhours, holidays, cfg)
        out = stats.energy_stats(v, period, e.period or cfg.time_resolution, cfg)
        name = name or self._label("stats", key, period, time_interval, bdays, bhours)
        return self.keep(name, out, "energy_stats_data", period)

    def typical_day(self, key: str, period: str = "M", time_interval=None, bdays: int = 0, bhours: int = 0,
                    holidays: DataFrame | None = None, name: str | None = None, cfg: LoadConfig = DEFAULT) -> str:
        e = self.entry(key)
        v = self._view(key, time_interval, bdays, bhours, holidays, cfg)
        out = typical_day.typical_day(v, period, e.period or cfg.time_resolution, cfg)
        name = name or f"typical_day__{key}__{period}"
        return self.keep(name, out, "typical_day", period)

    def energy_dist(self, keys: list[str], loads: list[str], period: str = "M", time_interval=None,
                    bdays: int = 0, bhours: int = 0, holidays: DataFrame | None = None,
                    total_first: bool = False, name: str | None = None, cfg: LoadConfig = DEFAULT) -> str:
        """Distribution of ``loads`` (series names) found in the load tables
        ``keys``; every table must have the same resolution (DST5)."""
        self.require(*keys)
        periods = {self.entry(k).period for k in keys}
        if len(periods) != 1:
            raise ValueError(f"loads of different resolutions cannot be distributed: {sorted(map(str, periods))}")
        views = [self._view(k, time_interval, bdays, bhours, holidays, cfg) for k in keys]
        v = views[0]
        for other in views[1:]:
            v = v.unionByName(other)
        out = distribution.energy_distribution(v, loads, period, periods.pop() or cfg.time_resolution, cfg,
                                               total_first=total_first)
        name = name or self._label("distribution", "_".join(keys), period, time_interval, bdays, bhours)
        return self.keep(name, out, "energy_distribution", period)

    def compare_stats(self, key: str, key2: str, how: str = "inner", offset: int = 1,
                      series: tuple[str, str] | None = None, name: str | None = None, cfg: LoadConfig = DEFAULT) -> str:
        """Meter by meter; with ``series`` the first meter of ``key`` against
        the second of ``key2``."""
        a, b = self.entry(key), self.entry(key2)
        if a.kind != "energy_stats_data" or b.kind != "energy_stats_data":
            raise KindMismatch("both tables must be statistics tables")
        if a.period != b.period:
            raise ValueError(f"{key!r} holds period {a.period!r} and {key2!r} period {b.period!r}")
        if series is None:
            out = compare.compare_stats(a.df, b.df, a.period, how, offset, cfg.percent_mode)
        else:
            both = a.df if a is b else a.df.where(F.col("series") == series[0]).unionByName(b.df.where(F.col("series") == series[1]))
            out = compare.compare_series(both, series[0], series[1], a.period, how, offset, cfg.percent_mode)
        return self.keep(name or f"stats_vs__{key}__{key2}", out, "energy_stats_comparison", a.period)

    def compare_distribution(self, key: str, offset: int = 1, name: str | None = None,
                             cfg: LoadConfig = DEFAULT) -> str:
        e = self.entry(key)
        if e.kind != "energy_distribution":
            raise KindMismatch(f"{key!r} is not a distribution table")
        out = compare.compare_distribution(e.df, e.period, offset, cfg.percent_mode)
        return self.keep(name or f"distribution_vs__{key}", out, "energy_distribution_comparison", e.period)

    def compare_typical_day(self, key: str, offset: int = 1, name: str | None = None,
                            cfg: LoadConfig = DEFAULT) -> str:
        e = self.entry(key)
        if e.kind != "typical_day":
            raise KindMismatch(f"{key!r} is not a typical-day table")
        out = compare.compare_typical_day(e.df, e.period, offset, cfg.percent_mode)
        return self.keep(name or f"typical_day_vs__{key}", out, "typical_day_comparison", e.period)

    def select_rows(self, key: str, column: str, values, name: str | None = None, *,
                    column2: str | None = None, values2=None) -> str:
        """Rows by key values (days of an hourly load expand to all hours;
        two-key tables select by both lists)."""
        e = self.entry(key)
        by_day = e.period == "H" and e.kind in ("energy_data", "energy_stats_data", "energy_distribution",
                                                "energy_stats_comparison", "energy_distribution_comparison")
        if column2 is not None:
            out = select.select_pairs(e.df, column, values, column2, values2, by_day=by_day)
        else:
            out = select.select_keys(e.df, column, values, by_day=by_day)
        return self.keep(name or f"rows__{key}", out, e.kind, e.period)

    def head(self, key: str, n: int | None = None, cfg: LoadConfig = DEFAULT) -> DataFrame:
        e = self.entry(key)
        n = n or cfg.number_of_rows_to_print_for_head
        keys = [c for c in KEY_ORDER if c in e.df.columns] or e.df.columns[:1]
        return select.head(e.df, n, keys) if "series" in e.df.columns else e.df.orderBy(*keys).limit(n)

    def keys(self, key: str, *columns: str) -> DataFrame:
        """Distinct keys of a table: of one column, or of both levels of a
        comparison (days of hourly tables)."""
        e = self.entry(key)
        cols = columns or [c for c in ("DateTimeStart", "period_start", "period_start_1", "period_start_2") if c in e.df.columns]
        return e.df.select(*[(F.to_date(F.col(c)) if e.period == "H" else F.col(c)).alias(c) for c in cols]).distinct()

    def extent(self, *keys: str) -> DataFrame:
        self.require(*keys)
        v = self.get(keys[0])
        for k in keys[1:]:
            v = v.unionByName(self.get(k))
        return resample.extent_of(v)

    # -- sinks ------------------------------------------------------------
    def output_dir(self, root: str, overwrite: bool = True) -> str:
        """``<root>/Output`` (overwritten), or one folder per session."""
        return _join(root, "Output" if overwrite else f"Output_{self.session}")

    def save(self, name: str, root: str, fmt: str | None = None, overwrite: bool | None = None,
             cfg: LoadConfig = DEFAULT) -> str:
        """Write a kept table under the output folder (sink policy from
        ``cfg``: ``results_overwrite``, ``type_of_tabular_output_file``)."""
        fmt = fmt or cfg.type_of_tabular_output_file
        overwrite = cfg.results_overwrite if overwrite is None else overwrite
        df = self.get(name)
        path = _join(self.output_dir(root, overwrite), table_key(name))
        w = df.write.mode("overwrite")
        if "csv" in fmt:
            w.option("header", True).csv(path)
        elif "parquet" in fmt:
            w.parquet(path)
        else:
            raise NotImplementedError(f"unsupported output type {fmt!r}")
        return path

    def save_last(self, root: str, fmt: str | None = None, overwrite: bool | None = None,
                  cfg: LoadConfig = DEFAULT) -> str:
        if self.last is None:
            raise LookupError("no table has been kept yet")
        return self.save(self.last[0], root, fmt, overwrite, cfg)

    # -- snapshots ----------------------------------------------------------
    def store_state(self, root: str) -> str:
        """Snapshot of all kept tables: one Parquet folder per table and, last,
        a ``_catalog`` manifest with each table's folder. The manifest is
        written beside its place and renamed into it, so a snapshot that broke
        off is never the newest. A table that the last snapshot of this
        catalog holds unchanged is referred to and not written again; a plan
        kept under several names is written once."""
        snap = f"state_{_now()}"
        done: dict[int, str] = {}
        meta = []
        for n, e in self._t.items():
            path = self._stored.get((root, id(e.df))) or done.get(id(e.df))
            if path is None:
                path = _join(snap, n)
                e.df.write.mode("overwrite").parquet(_join(root, path))
            done[id(e.df)] = path
            meta.append((n, e.kind, e.period, path))
        self.spark.createDataFrame(meta, CATALOG_SCHEMA).coalesce(1).write.mode("overwrite").parquet(_join(root, snap, "_writing"))
        fs, path = self._fs(root)
        if not fs.rename(path(_join(root, snap, "_writing")), path(_join(root, snap, "_catalog"))):
            raise OSError(f"the manifest of {snap} could not be put in place")
        self._stored = {(root, id(e.df)): done[id(e.df)] for e in self._t.values()}
        self._held = [e.df for e in self._t.values()]         # keeps the ids above in use
        return snap

    def _fs(self, root: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        return path(root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def snapshots(self, root: str) -> list[str]:
        """Whole snapshots, oldest first: those with a manifest."""
        fs, path = self._fs(root)
        if not fs.exists(path(root)):
            return []
        found = fs.globStatus(path(_join(root, "state_*", "_catalog")))
        return sorted(f.getPath().getParent().getName() for f in found or [])

    def load_state(self, root: str, snapshot: str | None = None) -> str:
        """Replace the catalog by a snapshot (the newest when not named)."""
        if snapshot is None:
            snaps = self.snapshots(root)
            if not snaps:
                raise LookupError(f"no snapshot below {root!r}")
            snapshot = snaps[-1]
        meta = self.spark.read.schema(CATALOG_SCHEMA).parquet(_join(root, snapshot, "_catalog")).collect()
        for n in list(self._t):
            self.spark.catalog.dropTempView(f"`{n}`")
        self._t = {}
        for r in meta:
            self.keep(r["name"], self.spark.read.parquet(_join(root, r["path"])), r["kind"], r["period"])
        self._stored = {(root, id(e.df)): r["path"] for r in meta for n, e in self._t.items() if n == r["name"]}
        self._held = [e.df for e in self._t.values()]
        return snapshot
