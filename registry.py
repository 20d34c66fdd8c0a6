"""Registered queries (Spark) and their DuckDB twins, keyed by name.

Each Spark query reads the provided tables under ``sf_dir`` and runs one
operator of the library over the whole tables; its twin is plain SQL over the
same tables (see ``oracle_sql.py``). Registration rounds the doubles of every
result to the grid that the twins use.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracle_sql as O
from loadgrid.config import DEFAULT
from loadgrid.functions.calendar import holidays_frame
from loadgrid.operators import clean, combine, compare, distribution, fill, resample, select, stats, typical_day
from loadgrid.plans import table_queries as TQ
from loadgrid.plans.load import filtered

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return TQ.quantized(fn(spark, sf_dir))
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# Fixed example inputs of the calendar and selection queries (user parameters
# of the original commands, not data subsets): the two January public
# holidays of the default calendar, a date range, picked days.
HOLIDAYS = ("2024-01-01", "2024-01-06")
EVENT_RANGE = ("2024-01-05", "2024-01-20")
ORDER_RANGE = ("1996-03-01", "1996-03-31")
PICKED_DAYS = ("2024-01-03", "2024-01-17", "2024-01-28")
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

POWER = DEFAULT.with_(input_type="power")
NO_ZERO = DEFAULT.with_(zero_values_are_ok=False)
NO_ZERO_PROP = NO_ZERO.with_(null_sum="propagate")
FILLED = NO_ZERO.with_(fill_zero_energy_to_previous=True)
SHEET = NO_ZERO.with_(fill_zero_energy_to_previous=True, back_fill=True, null_sum="propagate")

LOAD_D, LOAD_O = ["Energy"], ["series", "DateTimeStart", "DateTime"]


def _sel(ctes: str, table: str, doubles, others) -> str:
    return f"WITH {ctes}\nSELECT {O.qcols(doubles, others)} FROM {table}"


def _load_sql(ctes: str, table: str = "load") -> str:
    return _sel(ctes, table, LOAD_D, LOAD_O)


def _view(ctes: str, where: str = "", name: str = "v", src: str = "load") -> str:
    return f"{ctes},\n    {name} AS (SELECT * FROM {src} WHERE Energy IS NOT NULL {where})"


def _range_sql(start: str, end: str, col: str = "DateTime") -> str:
    s = dt.date.fromisoformat(start)
    e = dt.date.fromisoformat(end) + dt.timedelta(days=1)
    return f" AND {col} >= TIMESTAMP '{s} 01:00:00' AND {col} <= TIMESTAMP '{e} 00:00:00'"


def _hol_list() -> str:
    return ", ".join(f"DATE '{h}'" for h in HOLIDAYS)


def _bday_sql(col: str = "DateTimeStart") -> str:
    return f"(isodow({col}) <= 5 AND CAST({col} AS DATE) NOT IN ({_hol_list()}))"


def _bhour_sql(col: str = "DateTimeStart") -> str:
    return (f"(isodow({col}) <= 5 AND hour({col}) * 3600 + minute({col}) * 60 + second({col}) "
            f"BETWEEN 28800 AND 54000)")


def _stats_sql(ctes: str, period: str, where: str = "") -> str:
    d, o = O.stats_cols(period)
    return f"""WITH {_view(ctes, where)},
    {O.stats_ctes('v', period)}
    SELECT {O.qcols(d, o)} FROM st"""


def _holidays(spark):
    return holidays_frame(spark, HOLIDAYS)


# ===========================================================================
# Cleaning (CLN1-7)
# ===========================================================================

@register("interval_infer", f"""WITH r AS ({O.events_readings()}), {O.shift_ctes('r')}
    SELECT series, delta AS delta_seconds,
           CAST(COALESCE(((delta % 86400 + 86400) % 86400) // 3600, 0) AS INTEGER) AS interval_hours,
           CAST(COALESCE((((delta % 86400 + 86400) % 86400) // 60) % 60, 0) AS INTEGER) AS interval_minutes,
           CAST(shift AS BIGINT) AS shift_seconds
    FROM iv_ JOIN sh USING (series)""")
def interval_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLN1: sampling interval per series from its first two readings."""
    return clean.interval_table(TQ.events_readings(spark, sf_dir), ts="DateTime")


@register("shift_to_interval_start", f"""WITH r AS ({O.events_readings()}), {O.shift_ctes('r')}
    SELECT r.series, r.o1 AS event_id, r.dt AS DateTime, r.dt - to_seconds(CAST(sh.shift AS BIGINT)) AS DateTimeStart,
           {O.q('r.energy')} AS Energy
    FROM r JOIN sh USING (series)""")
def shift_to_interval_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLN2: end-stamped readings moved to the start of their interval."""
    r = TQ.events_readings(spark, sf_dir)
    s = clean.shift_to_start(clean.with_shift(r), ts="DateTime", out="DateTimeStart")
    return s.select("series", "event_id", "DateTime", "DateTimeStart", "Energy")


_LI_OTHERS = ["series", "DateTime", "l_orderkey", "l_linenumber"]


def _li_readings_sql(energy: str = "CASE WHEN energy = 0 THEN NULL ELSE energy END") -> str:
    return f"""r0 AS ({O.lineitem_readings('l_discount')}),
    r AS (SELECT series, dt AS t, dt, {energy} AS energy, 0 AS shift, o1, o2, o3, o4 FROM r0)"""


@register("zero_to_null", f"""WITH {_li_readings_sql()}
    SELECT series, dt AS DateTime, o1 AS l_orderkey, o2 AS l_linenumber, {O.q('energy')} AS Energy FROM r""")
def zero_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLN3: zero readings (``l_discount`` = 0) become missing."""
    r = clean.zero_to_null(TQ.lineitem_readings(spark, sf_dir, "l_discount"))
    return r.select("series", "DateTime", "l_orderkey", "l_linenumber", "Energy")


def _fill_sql(mode: str) -> str:
    return f"""WITH {_li_readings_sql()}, {O.fill_ctes('r', mode)}
    SELECT series, t AS DateTime, o1 AS l_orderkey, o2 AS l_linenumber, {O.q('energy')} AS Energy FROM xf"""


def _fill_query(spark, sf_dir, **kw) -> DataFrame:
    r = clean.zero_to_null(TQ.lineitem_readings(spark, sf_dir, "l_discount"))
    f = fill.fill_gaps(r, ts="DateTime", value="Energy", order=TQ.LINEITEM_ORDER, **kw)
    return f.select("series", "DateTime", "l_orderkey", "l_linenumber", "Energy")


@register("interpolate_linear", _fill_sql("interpolate"))
def interpolate_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLN4: linear interpolation by row position (blocked windows)."""
    return _fill_query(spark, sf_dir, interpolate=True)


@register("forward_fill", _fill_sql("ffill"))
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLN5: forward fill."""
    return _fill_query(spark, sf_dir, ffill=True)


@register("back_fill", _fill_sql("bfill"))
def back_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLN6: back fill."""
    return _fill_query(spark, sf_dir, bfill=True)


@register("drop_missing_zero", _sel(_view(O.lineitem_load("D", "l_discount", zero_ok=True), "AND Energy <> 0"),
                                    "v", LOAD_D, LOAD_O))
def drop_missing_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLN7: filtered view without missing and zero rows."""
    load = TQ.lineitem_load(spark, sf_dir, "D", DEFAULT, value="l_discount")
    return filtered(load, DEFAULT.with_(drop_zero_energy=True))


@register("load_with_fill", _load_sql(O.lineitem_load("D", "l_discount", zero_ok=False, fill="interp_ffill")))
def load_with_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CLN3+CLN4+CLN5 inside the load: zeros missing, interpolated, daily sums."""
    return TQ.lineitem_load(spark, sf_dir, "D", FILLED, value="l_discount")


@register("load_sheet_policy", _load_sql(O.lineitem_load("D", "l_discount", zero_ok=False, fill="all",
                                                         null_sum="propagate")))
def load_sheet_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5 + CLN6: the spreadsheet ingest policy (back fill, null-propagating sums)."""
    return TQ.lineitem_load(spark, sf_dir, "D", SHEET, value="l_discount")


# ===========================================================================
# Resampling (RSM1-6)
# ===========================================================================

@register("resample_hour_sum", _load_sql(O.events_load("H")))
def resample_hour_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSM1/RSM3/RSM4 + CLN1/CLN2: events -> hourly energy loads."""
    return TQ.events_load(spark, sf_dir, "H")


@register("resample_hour_mean", _load_sql(O.events_load("H", how="mean")))
def resample_hour_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSM1 for power input: hourly means, empty hours missing."""
    return TQ.events_load(spark, sf_dir, "H", POWER)


@register("resample_15min", _load_sql(O.events_load("15min")))
def resample_15min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSM1 on a minute grid: ``DateTime`` = label + the sampling interval."""
    return TQ.events_load(spark, sf_dir, "15min")


@register("resample_day_gapfill", _load_sql(O.orders_load("D")))
def resample_day_gapfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSM3: daily order sums, days without orders are 0."""
    return TQ.orders_load(spark, sf_dir, "D")


@register("resample_week_label", _load_sql(O.orders_load("W")))
def resample_week_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSM4: weekly bins labelled by their Sunday."""
    return TQ.orders_load(spark, sf_dir, "W")


@register("resample_month_label", _load_sql(O.orders_load("M")))
def resample_month_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSM4: monthly bins labelled by the month's last day."""
    return TQ.orders_load(spark, sf_dir, "M")


@register("resample_quarter_label", _load_sql(O.orders_load("Q")))
def resample_quarter_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSM4: quarterly bins labelled by the quarter's last day."""
    return TQ.orders_load(spark, sf_dir, "Q")


@register("resample_year_label", _load_sql(O.orders_load("Y")))
def resample_year_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSM4: yearly bins labelled Dec 31."""
    return TQ.orders_load(spark, sf_dir, "Y")


@register("resample_null_propagating", _load_sql(O.lineitem_load("D", "l_discount", zero_ok=False,
                                                                 null_sum="propagate")))
def resample_null_propagating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSM1 / Q2: a day with a missing reading sums to missing."""
    return TQ.lineitem_load(spark, sf_dir, "D", NO_ZERO_PROP, value="l_discount")


@register("resample_null_skip", _load_sql(O.lineitem_load("D", "l_discount", zero_ok=False)))
def resample_null_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSM1 / Q2: missing readings are skipped in the day sum."""
    return TQ.lineitem_load(spark, sf_dir, "D", NO_ZERO, value="l_discount")


def _resample_loaded_sql(period: str) -> str:
    lab = O.label_expr(period, "bin")
    return f"""WITH {O.events_load('H')},
    {O.shift_ctes('load', ts='DateTime', order='DateTime', p='z')},
    y AS (SELECT l.series, l.DateTime - to_seconds(CAST(sh.shift AS BIGINT)) AS t, l.Energy AS energy, sh.shift
          FROM load l JOIN zsh sh ON l.series = sh.series),
    {O.binned_ctes('y', period, 'sum', 'propagate', prefix='z')}
    SELECT series, {lab} AS DateTimeStart, {O.end_expr(period, lab)} AS DateTime, {O.q('Energy')} AS Energy FROM zf"""


@register("resample_loaded_day", _resample_loaded_sql("D"))
def resample_loaded_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSM2: hourly loads re-sampled to days (null-propagating sums)."""
    return resample.resample_loaded(TQ.events_load(spark, sf_dir, "H"), "D", resolution="H")


@register("resample_loaded_week", _resample_loaded_sql("W"))
def resample_loaded_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSM2: hourly loads re-sampled to weeks."""
    return resample.resample_loaded(TQ.events_load(spark, sf_dir, "H"), "W", resolution="H")


def _to_hourly_sql(ctes: str, fn: str) -> str:
    return f"""WITH {_view(ctes)}
    SELECT series, date_trunc('hour', DateTimeStart) AS DateTimeStart, max(DateTime) AS DateTime,
           {O.q(f'{fn}(Energy)')} AS Energy FROM v GROUP BY series, date_trunc('hour', DateTimeStart)"""


@register("to_hourly", _to_hourly_sql(O.events_load("15min"), "sum"))
def to_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSM5: 15-minute view -> hourly rows (sum, last stamp)."""
    view = filtered(TQ.events_load(spark, sf_dir, "15min"))
    return resample.to_hourly(view, "15min", "energy")


@register("to_hourly_power", _to_hourly_sql(O.events_load("15min", how="mean"), "avg"))
def to_hourly_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSM5 for power: 15-minute means -> hourly means; hours without readings stay away."""
    view = filtered(TQ.events_load(spark, sf_dir, "15min", POWER))
    return resample.to_hourly(view, "15min", "power")


@register("series_extent", f"""WITH {O.events_load('H')}
    SELECT series, CAST(min(DateTimeStart) + INTERVAL 1 HOUR AS DATE) AS min_day,
           CAST(max(DateTimeStart) AS DATE) AS max_day FROM load GROUP BY series""")
def series_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSM6: first and last day of every series."""
    return resample.series_extent(TQ.events_load(spark, sf_dir, "H"))


@register("extent_of_loads", f"""WITH {O.events_load('H')}
    SELECT min(min_day) AS min_day, max(max_day) AS max_day FROM (
      SELECT series, CAST(min(DateTimeStart) + INTERVAL 1 HOUR AS DATE) AS min_day,
             CAST(max(DateTimeStart) AS DATE) AS max_day FROM load
      WHERE series IN ('click', 'view') GROUP BY series)""")
def extent_of_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSM6: common extent of several series."""
    return resample.extent_of(TQ.events_load(spark, sf_dir, "H"), ["click", "view"])


# ===========================================================================
# Filters and selection (FLT1-10, SRT4)
# ===========================================================================

@register("filter_range_hourly", _sel(_view(O.events_load("H"), _range_sql(*EVENT_RANGE)), "v", LOAD_D, LOAD_O))
def filter_range_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT1 on hourly data: ``DateTime`` in [start 01:00, end+1 00:00]."""
    return select.filter_range(TQ.events_view(spark, sf_dir), *EVENT_RANGE)


@register("filter_range_daily", _sel(_view(O.orders_load("D"), _range_sql(*ORDER_RANGE)), "v", LOAD_D, LOAD_O))
def filter_range_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT1 on daily data (Q5: first day dropped, day after the end kept)."""
    return select.filter_range(filtered(TQ.orders_load(spark, sf_dir, "D")), *ORDER_RANGE)


def _cal_query(spark, sf_dir, bdays=0, bhours=0):
    v = select.select_rows(TQ.events_view(spark, sf_dir), None, bdays, bhours, holidays=_holidays(spark))
    return v


@register("business_days", _sel(_view(O.events_load("H"), f"AND {_bday_sql()}"), "v", LOAD_D, LOAD_O))
def business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT2/FLT6: Mon-Fri minus holidays."""
    return _cal_query(spark, sf_dir, bdays=1)


@register("non_business_days", _sel(_view(O.events_load("H"), f"AND NOT {_bday_sql()}"), "v", LOAD_D, LOAD_O))
def non_business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT3: weekends and holidays."""
    return _cal_query(spark, sf_dir, bdays=2)


@register("business_hours", _sel(_view(O.events_load("H"), f"AND {_bhour_sql()}"), "v", LOAD_D, LOAD_O))
def business_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT4: Mon-Fri 08:00-15:00 inclusive (holidays not consulted, Q6)."""
    return _cal_query(spark, sf_dir, bhours=1)


@register("non_business_hours", _sel(_view(O.events_load("H"), f"AND NOT {_bhour_sql()}"), "v", LOAD_D, LOAD_O))
def non_business_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT5: every other hour."""
    return _cal_query(spark, sf_dir, bhours=2)


_PICKED_SQL = ", ".join(f"DATE '{d}'" for d in PICKED_DAYS)


@register("select_days", _sel(O.events_load("H") + f""",
    s AS (SELECT * FROM load WHERE CAST(DateTimeStart AS DATE) IN ({_PICKED_SQL}))""", "s", LOAD_D, LOAD_O))
def select_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT7/FLT9: picked days of an hourly table -> all their hours."""
    return select.select_keys(TQ.events_load(spark, sf_dir, "H"), "DateTimeStart", PICKED_DAYS,
                                           by_day=True)


@register("distinct_days", f"""WITH {O.events_load('H')}
    SELECT DISTINCT CAST(DateTimeStart AS DATE) AS DateTimeStart FROM load""")
def distinct_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT10: distinct days of an hourly table."""
    return select.distinct_keys(TQ.events_load(spark, sf_dir, "H"), "DateTimeStart", by_day=True)


@register("head_rows", _sel(O.events_load("H") + """,
    h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY DateTimeStart) AS rn FROM load)
          WHERE rn <= 5)""", "h", LOAD_D, LOAD_O))
def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT4: the first five rows of every series (top-k per group)."""
    return select.head(TQ.events_load(spark, sf_dir, "H"), 5)


# ===========================================================================
# Period statistics (AGG1-8, JN9)
# ===========================================================================

def _stats_q(load_fn, load_period, period, cfg=DEFAULT, **sel):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        view = filtered(load_fn(spark, sf_dir, load_period, cfg), cfg)
        if sel:
            view = select.select_rows(view, sel.get("interval"), sel.get("bdays", 0), sel.get("bhours", 0),
                                      holidays=_holidays(spark), cfg=cfg)
        return stats.energy_stats(view, period, load_period, cfg)
    return run


for _p in ("H", "D", "W", "M"):
    _name = {"H": "stats_hour", "D": "stats_day", "W": "stats_week", "M": "stats_month"}[_p]
    _fn = _stats_q(TQ.events_load, "H", _p)
    _fn.__doc__ = f"AGG1-8: period-{_p} statistics of the hourly event loads."
    register(_name, _stats_sql(O.events_load("H"), _p))(_fn)

for _p in ("W", "M", "Q", "Y"):
    _fn = _stats_q(TQ.orders_load, "D", _p)
    _fn.__doc__ = f"AGG1-8: period-{_p} statistics of the daily order loads."
    register(f"stats_orders_{_p.lower()}", _stats_sql(O.orders_load("D"), _p))(_fn)

_fn = _stats_q(TQ.lineitem_load, "D", "M")
_fn.__doc__ = "AGG1-8: monthly statistics of the daily lineitem quantity loads."
register("stats_lineitem_month", _stats_sql(O.lineitem_load("D"), "M"))(_fn)

_fn = _stats_q(TQ.events_load, "H", "D", interval=EVENT_RANGE, bdays=1, bhours=1)
_fn.__doc__ = "FLT1-4 + AGG1: daily statistics in a range, business days and hours only."
register("stats_day_business", _stats_sql(O.events_load("H"), "D",
                                          _range_sql(*EVENT_RANGE) + f" AND {_bday_sql()} AND {_bhour_sql()}"))(_fn)

_fn = _stats_q(TQ.events_load, "H", "M", bdays=2)
_fn.__doc__ = "FLT3 + AGG1-8: monthly statistics of the non-business days."
register("stats_month_non_business_days", _stats_sql(O.events_load("H"), "M", f" AND NOT {_bday_sql()}"))(_fn)

_fn = _stats_q(TQ.events_load, "15min", "H")
_fn.__doc__ = "AGG1 on a 15-minute load: hourly statistics over quarter-hour rows."
register("stats_hour_15min", _stats_sql(O.events_load("15min"), "H"))(_fn)


# ===========================================================================
# Typical day (TYP1-6)
# ===========================================================================

_TD_KEYS = {"no_period": [], "W": ["year", "month", "week"], "M": ["year", "month"], "Q": ["year", "quarter"]}
_TD_SQLK = {"year": "year", "month": "month", "week": "week", "quarter": "quarter", "hour": "hour"}
TD_D = ["Energy__mean", "Energy__min", "Energy__max"]
TD_O = ["first_day", "Energy__idxmin", "Energy__idxmax"]


def _td_ctes(ctes: str, period: str, name: str = "td", src: str = "load") -> str:
    keys = _TD_KEYS[period] + ["hour"]
    ksql = ", ".join(f"CAST({_TD_SQLK[k]}(DateTimeStart) AS INTEGER) AS {k}" for k in keys)
    return f"""{_view(ctes, src=src)},
    c0 AS (SELECT *, count(Energy) OVER (PARTITION BY series, date_trunc('day', DateTimeStart)) AS ne,
                     count(DateTime) OVER (PARTITION BY series, date_trunc('day', DateTimeStart)) AS nt FROM v),
    c1 AS (SELECT * FROM c0 WHERE ne = 24 AND nt = 24),
    {name} AS (SELECT series, {ksql}, min(CAST(DateTimeStart AS DATE)) AS first_day, avg(Energy) AS Energy__mean, min(Energy) AS Energy__min,
                  first(DateTimeStart ORDER BY Energy ASC, DateTimeStart ASC) AS Energy__idxmin,
                  max(Energy) AS Energy__max,
                  first(DateTimeStart ORDER BY Energy DESC, DateTimeStart ASC) AS Energy__idxmax
           FROM c1 GROUP BY ALL)"""


def _td_q(period, view=TQ.events_view, cfg=DEFAULT):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return typical_day.typical_day(view(spark, sf_dir, cfg), period, cfg=cfg)
    run.__doc__ = f"TYP1-5: typical day per {period} over complete days."
    return run


# events: one month of energy (every hour is there) and of power (empty hours
# are missing, so days are incomplete); orders: seven years of hourly energy
for _src, _load, _view_fn, _cfg in (("", O.events_load("H"), TQ.events_view, DEFAULT),
                                    ("power_", O.events_load("H", how="mean"), TQ.events_view, POWER),
                                    ("orders_", O.orders_hourly_load(), TQ.orders_hourly_view, DEFAULT)):
    for _p, _n in (("no_period", "all"), ("W", "week"), ("M", "month"), ("Q", "quarter")):
        register(f"typical_day_{_src}{_n}", f"WITH {_td_ctes(_load, _p)}\nSELECT "
                 f"{O.qcols(TD_D, ['series', *_TD_KEYS[_p], 'hour', *TD_O])} FROM td")(_td_q(_p, _view_fn, _cfg))


@register("typical_day_business_hours",
          f"WITH {_td_ctes(O.events_load('H') + ', lb AS (SELECT * FROM load WHERE ' + _bhour_sql() + ')', 'M').replace('FROM load WHERE Energy IS NOT NULL', 'FROM lb WHERE Energy IS NOT NULL')}"
          f"\nSELECT {O.qcols(TD_D, ['series', 'year', 'month', 'hour', *TD_O])} FROM td")
def typical_day_business_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TYP1 / Q12: business hours leave no day with 24 rows -> empty result."""
    v = select.select_rows(TQ.events_view(spark, sf_dir), None, 0, 1)
    return typical_day.typical_day(v, "M")


# ===========================================================================
# Distribution over loads (DST1-5, JN7-8)
# ===========================================================================

def _dist_ctes(ctes: str, loads: list[str], period: str, same_count: bool, total_first: bool,
               name: str = "dist", view_src: str = "load") -> tuple[str, list[str], list[str]]:
    lst = ", ".join(f"'{x}'" for x in loads)
    src = "dv"
    out = f"""{_view(ctes, src=view_src)},
    dv AS (SELECT series, DateTimeStart, Energy FROM v WHERE series IN ({lst}))"""
    if same_count:
        out += f""",
    dc AS (SELECT *, count(*) OVER (PARTITION BY DateTimeStart) AS n FROM dv),
    ds AS (SELECT * FROM dc WHERE n = {len(loads)})"""
        src = "ds"
    aggs, having = [], []
    for x in loads:
        f = f"FILTER (WHERE series = '{x}')"
        aggs += [f'COALESCE(sum(Energy) {f}, 0.0) AS "{x}__sum"', f'avg(Energy) {f} AS "{x}__mean"',
                 f'count(Energy) {f} AS "{x}__count"']
        having.append(f"count(*) {f} > 0")
    out += f""",
    d0 AS (SELECT date_trunc('{O.TRUNC[period]}', DateTimeStart) AS period_start, {', '.join(aggs)}
           FROM {src} GROUP BY 1 HAVING {' AND '.join(having)})"""
    doubles, others = [], ["period_start"]
    sel = ["period_start"]
    for x in loads:
        sel += [f'"{x}__sum"', f'"{x}__mean"', f'"{x}__count"']
        doubles += [f"{x}__sum", f"{x}__mean"]
        others.append(f"{x}__count")
    if total_first:
        first = f'"{loads[0]}__sum"'
        for x in loads:
            sel.append(f'(CASE WHEN {first} = 0 THEN NULL ELSE "{x}__sum" / {first} END) * 100.0 AS "{x}__percentage"')
            doubles.append(f"{x}__percentage")
        sums = "0.0"
        means = "0.0"
        for x in loads:
            sums = f'({sums} + "{x}__sum")'
            means = f'({means} + "{x}__mean")'
        osum = f"(2.0 * {first} - {sums})"
        sel += [f'{osum} AS "other_loads__sum"', f'(2.0 * "{loads[0]}__mean" - {means}) AS "other_loads__mean"',
                f'(CASE WHEN {first} = 0 THEN NULL ELSE {osum} / {first} END) * 100.0 AS "other_loads__percentage"']
        doubles += ["other_loads__sum", "other_loads__mean", "other_loads__percentage"]
    out += f""",
    {name} AS (SELECT {', '.join(sel)} FROM d0)"""
    return out, doubles, others


def _dist_sql(loads, period, same_count, total_first, how="sum"):
    ctes, d, o = _dist_ctes(O.events_load("H", how=how), loads, period, same_count, total_first)
    return f"WITH {ctes}\nSELECT {O.qcols(d, o)} FROM dist"


def _dist_df(spark, sf_dir, loads, period, same_count, total_first, cfg=DEFAULT):
    return distribution.energy_distribution(TQ.events_view(spark, sf_dir, cfg), loads, period, "H", cfg,
                                            same_count=same_count, total_first=total_first)


def _dist_power(name: str, doc: str, loads, same_count, total_first):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _dist_df(spark, sf_dir, loads, "D", same_count, total_first, POWER)
    run.__doc__ = doc
    register(name, _dist_sql(loads, "D", same_count, total_first, "mean"))(run)


_dist_power("distribution_power_same_support", "DST1 on power loads, whose hours differ.", EVENT_TYPES, True, False)
_dist_power("distribution_power_independent", "DST2 on power loads, whose hours differ.", EVENT_TYPES, False, False)
_dist_power("distribution_power_share_residual", "DST3/DST4 on power loads.", ["total", *EVENT_TYPES], True, True)


@register("distribution_same_support", _dist_sql(EVENT_TYPES, "D", True, False))
def distribution_same_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DST1/JN7: daily sums, means, counts of five loads on their common hours."""
    return _dist_df(spark, sf_dir, EVENT_TYPES, "D", True, False)


@register("distribution_independent", _dist_sql(EVENT_TYPES, "D", False, False))
def distribution_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DST2/JN8: each load on its own hours, days present in all loads."""
    return _dist_df(spark, sf_dir, EVENT_TYPES, "D", False, False)


@register("distribution_share_residual", _dist_sql(["total", *EVENT_TYPES], "D", True, True))
def distribution_share_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DST3/DST4: shares of the total and the residual ``other_loads``."""
    return _dist_df(spark, sf_dir, ["total", *EVENT_TYPES], "D", True, True)


@register("distribution_weekly", _dist_sql(["total", "click", "view"], "W", True, True))
def distribution_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DST1/DST3 per week."""
    return _dist_df(spark, sf_dir, ["total", "click", "view"], "W", True, True)


# ===========================================================================
# Combining (SET1-3)
# ===========================================================================

@register("group_loads", _load_sql(O.events_load("H") + f""",
    gl AS (SELECT 'grouped' AS series, DateTimeStart, DateTimeStart + INTERVAL 1 HOUR AS DateTime,
                 COALESCE(sum(COALESCE(Energy, 0.0)), 0.0) AS Energy
          FROM load WHERE series IN ({', '.join(repr(x) for x in EVENT_TYPES)})
          GROUP BY DateTimeStart HAVING count(*) = {len(EVENT_TYPES)})""", "gl"))
def group_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET2: five loads summed into one at their common stamps."""
    return combine.group_loads(TQ.events_load(spark, sf_dir, "H"), EVENT_TYPES, "grouped")


@register("concat_tables", _load_sql(O.events_load("H") + ", " + O.orders_load("D", name="load2", p="o_") + """,
    u AS (SELECT * FROM load UNION ALL SELECT * FROM load2)""", "u"))
def concat_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET1: union of two tables of the same kind, columns aligned by name."""
    return combine.concatenate(TQ.events_load(spark, sf_dir, "H"), TQ.orders_load(spark, sf_dir, "D"))


# ===========================================================================
# Comparisons (JN1-6, CMP1-7) -- one-to-one pairings, see operators.compare
# ===========================================================================

def _metric_sql(kind: str, a: str, b: str) -> str:
    e = O.EPS
    return {
        "diff": f"({a} - {b})",
        "pct_b": f"({a} - {b}) / ({e} + {b}) * 100.0",
        "pct_a_first": f"100.0 * ({a} - {b}) / ({e} + {a})",
        "pct_b_first": f"100.0 * ({a} - {b}) / ({e} + {b})",
        "div100": f"({a} - {b}) / 100.0 * ({e} + {a})",
        "over100a": f"({a} - {b}) / (100.0 * ({e} + {a}))",
        "consistent": f"({a} - {b}) / ({e} + {a}) * 100.0",
    }[kind]


def _stats_metrics_sql(period: str, mode: str) -> list[tuple[str, str]]:
    R = f"{O.WORD[period]}_Energy_Hourly_Stats"

    def c(g, s, side):
        return f'"{g}__{s}_{side}"'

    def pr(g, s):
        return c(g, s, 1), c(g, s, 2)

    cons = mode == "consistent"
    if period in ("H", "D"):
        p = "consistent" if cons else "pct_b"
        (sa, sb), (ma, mb) = pr(R, "sum"), pr(R, "mean")
        return [("first_data_sum_minus_second_data_sum", _metric_sql("diff", sa, sb)),
                ("percent_difference_sum_energy_consumption", _metric_sql(p, sa, sb)),
                ("first_data_mean_minus_second_data_mean", _metric_sql("diff", ma, mb)),
                ("percent_difference_mean_power", _metric_sql(p, ma, mb))]
    if period in ("W", "M"):
        p = "consistent" if cons else "pct_b"
        (sa, sb), (ma, mb), (da, db) = pr(R, "sum"), pr(R, "mean"), pr("Daily_Energy", "mean")
        return [("first_data_monthly_sum_minus_second_data_monthly_sum", _metric_sql("diff", sa, sb)),
                ("percent_difference_monthly_sum_energy_consumption", _metric_sql(p, sa, sb)),
                ("first_data_hourly_mean_minus_second_data_hourly_mean", _metric_sql("diff", ma, mb)),
                ("percent_difference_hourly_mean_power", _metric_sql(p, ma, mb)),
                ("first_data_daily_mean_consumption_minus_second_data_mean_daily_consumption",
                 _metric_sql("diff", da, db)),
                ("percent_difference_mean_daily", _metric_sql(p, da, db))]
    (sa, sb), (ma, mb) = pr(R, "sum"), pr(R, "mean")
    (da, db), (moa, mob) = pr("Daily_Energy", "mean"), pr("Monthly_Energy", "mean")
    if cons:
        daily, monthly, ps, pm, pdly, pmon = (da, db), (moa, mob), "consistent", "consistent", "consistent", "consistent"
    else:
        daily, monthly, ps, pm, pdly, pmon = (moa, mob), (da, db), "pct_a_first", "pct_a_first", "pct_a_first", "pct_b_first"
    return [("first_data_sum_minus_second_data_sum", _metric_sql("diff", sa, sb)),
            ("percent_difference_sum_energy_consumption", _metric_sql(ps, sa, sb)),
            ("first_data_hourly_mean_minus_second_data_hourly_mean", _metric_sql("diff", ma, mb)),
            ("percent_difference_hourly_mean_power", _metric_sql(pm, ma, mb)),
            ("first_data_daily_mean_consumption_minus_second_data_mean_daily_consumption",
             _metric_sql("diff", *daily)),
            ("percent_difference_mean_daily", _metric_sql(pdly, *daily)),
            ("first_data_monthly_mean_consumption_minus_second_data_mean_monthly_consumption",
             _metric_sql("diff", *monthly)),
            ("percent_difference_mean_monthly", _metric_sql(pmon, *monthly))]


def _pair_keys_sql(period: str, how: str, offset: int, ps: str, left: bool) -> list[str]:
    k = offset if left else 0
    if how == "inner":
        return [f"epoch_ms({ps})"]
    if how == "shifted":
        ordinal = {
            "H": f"(date_diff('day', DATE '1970-01-01', CAST({ps} AS DATE)) * 24 + hour({ps}))",
            "D": f"date_diff('day', DATE '1970-01-01', CAST({ps} AS DATE))",
            "W": f"floor(date_diff('day', DATE '1970-01-05', CAST({ps} AS DATE)) / 7)",
            "M": f"(year({ps}) * 12 + month({ps}) - 1)",
            "Q": f"(year({ps}) * 4 + quarter({ps}) - 1)",
            "Y": f"year({ps})",
        }[period]
        return [f"({ordinal} - {k})"]
    if period == "H":
        return [f"(date_diff('day', DATE '1970-01-01', CAST({ps} AS DATE)) - {k})", f"hour({ps})"]
    if period == "D":
        return [f"(year({ps}) * 12 + month({ps}) - {k})", f"day({ps})"]
    if period == "W":
        return [f"(isoyear({ps}) - {k})", f"week({ps})"]
    if period == "M":
        return [f"(year({ps}) - {k})", f"month({ps})"]
    if period == "Q":
        return [f"(year({ps}) - {k})", f"quarter({ps})"]
    return [f"year({ps})"]


def _cmp_stats_sql(load_ctes: str, period: str, how: str = "inner", offset: int = 1, left: str | None = None,
                   right: str | None = None, match_series: bool = False, mode: str = "reference",
                   where: str = "") -> str:
    if how == "inner":
        offset = 0
    d, o = O.stats_cols(period)
    cols = o + d
    lw = f"WHERE series = '{left}'" if left else ""
    rw = f"WHERE series = '{right}'" if right else ""
    L = ", ".join(f'"{c}" AS "{c}_1"' for c in cols)
    R = ", ".join(f'"{c}" AS "{c}_2"' for c in cols)
    lk = _pair_keys_sql(period, how, offset, "period_start_1", True)
    rk = _pair_keys_sql(period, how, offset, "period_start_2", False)
    cond = [f"{a} = {b}" for a, b in zip(lk, rk)]
    if match_series:
        cond.append("series_1 = series_2")
    if how == "aligned":
        cond.append("period_start_1 <> period_start_2")
    mets = _stats_metrics_sql(period, mode)
    doubles = [m for m, _ in mets] + [f"{c}_{s}" for s in (1, 2) for c in d]
    others = [f"{c}_{s}" for s in (1, 2) for c in o]
    merge = ", 'both' AS _merge" if how == "inner" else ""
    return f"""WITH {_view(load_ctes)},
    {O.stats_ctes('v', period)},
    cl AS (SELECT {L} FROM st {lw}),
    cr AS (SELECT {R} FROM st {rw}),
    cj AS (SELECT {', '.join(f'{e} AS "{m}"' for m, e in mets)}, cl.*, cr.*{merge}
           FROM cl JOIN cr ON {' AND '.join(cond)})
    SELECT {O.qcols(doubles, others + (['_merge'] if merge else []))} FROM cj {where}"""


def _cmp_stats_q(load_fn, load_period, period, how="inner", offset=1, left=None, right=None,
                 mode="reference"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        st = stats.energy_stats(filtered(load_fn(spark, sf_dir, load_period)), period, load_period)
        if left and right:
            return compare.compare_series(st, left, right, period, how, offset, mode)
        return compare.compare_stats(st, st, period, how, offset, mode)
    return run


_CMP_STATS = [
    # name, load, load period, period, how, offset, left, right, match_series, mode
    ("compare_stats_inner_day", "events", "H", "D", "inner", 0, "click", "view", False, "reference"),
    ("compare_stats_inner_hour", "events", "H", "H", "inner", 0, "total", "purchase", False, "reference"),
    ("compare_stats_inner_week", "events", "H", "W", "inner", 0, "click", "view", False, "reference"),
    ("compare_stats_inner_month", "orders", "D", "M", "inner", 0, "1-URGENT", "5-LOW", False, "reference"),
    ("compare_stats_inner_quarter", "orders", "D", "Q", "inner", 0, "3-MEDIUM", "2-HIGH", False, "reference"),
    ("compare_stats_inner_year", "orders", "D", "Y", "inner", 0, "1-URGENT", "2-HIGH", False, "reference"),
    ("compare_stats_inner_year_consistent", "orders", "D", "Y", "inner", 0, "1-URGENT", "2-HIGH", False,
     "consistent"),
    ("compare_stats_shifted_day", "events", "H", "D", "shifted", 1, None, None, True, "reference"),
    ("compare_stats_shifted_month", "orders", "D", "M", "shifted", 1, None, None, True, "reference"),
    ("compare_stats_cross_month", "orders", "D", "M", "shifted", 1, "1-URGENT", "5-LOW", False, "reference"),
    ("compare_stats_aligned_hour", "events", "H", "H", "aligned", 1, None, None, True, "reference"),
    ("compare_stats_aligned_day", "orders", "D", "D", "aligned", 1, None, None, True, "reference"),
    ("compare_stats_aligned_week", "orders", "D", "W", "aligned", 1, None, None, True, "reference"),
    ("compare_stats_aligned_month", "orders", "D", "M", "aligned", 1, None, None, True, "reference"),
    ("compare_stats_aligned_quarter", "orders", "D", "Q", "aligned", 1, None, None, True, "reference"),
    ("compare_stats_aligned_year", "orders", "D", "Y", "aligned", 1, None, None, True, "reference"),
]
_LOADS = {"events": (TQ.events_load, O.events_load), "orders": (TQ.orders_load, O.orders_load)}

for (_n, _src, _lp, _p, _how, _off, _l, _r, _ms, _mode) in _CMP_STATS:
    _fn = _cmp_stats_q(_LOADS[_src][0], _lp, _p, _how, _off, _l, _r, _mode)
    _fn.__doc__ = f"JN/CMP: {_how} comparison of {_p} statistics ({_src})."
    register(_n, _cmp_stats_sql(_LOADS[_src][1](_lp), _p, _how, _off, _l, _r, _ms, _mode))(_fn)


def _cmp_dist_sql(loads, period, total_first, offset=1, mode="reference") -> str:
    ctes, dd, do = _dist_ctes(O.events_load("H"), loads, period, True, total_first)
    cols = ["period_start"] + [c for c in do if c != "period_start"] + dd
    all_loads = list(loads) + (["other_loads"] if total_first else [])

    def ren(c, sfx):
        if c == "period_start":
            return f"period_start{sfx}"
        ld, st = c.rsplit("__", 1)
        return f"{ld}{sfx}__{st}"

    L = ", ".join(f'"{c}" AS "{ren(c, "_1")}"' for c in cols)
    R = ", ".join(f'"{c}" AS "{ren(c, "_2")}"' for c in cols)
    ordinal = {"D": "date_diff('day', DATE '1970-01-01', CAST({x} AS DATE))",
               "W": "floor(date_diff('day', DATE '1970-01-05', CAST({x} AS DATE)) / 7)",
               "M": "(year({x}) * 12 + month({x}) - 1)"}[period]
    p = "consistent" if mode == "consistent" else "div100"
    mets = []
    for ld in all_loads:
        a, b = f"{ld}_1", f"{ld}_2"
        sa, sb, ma, mb = f'"{a}__sum"', f'"{b}__sum"', f'"{a}__mean"', f'"{b}__mean"'
        mets += [(f"first_data_sum_minus_second_data_sum_{a}_and_{b}", _metric_sql("diff", sa, sb)),
                 (f"percent_difference_sum_energy_{a}_and_{b}", _metric_sql(p, sa, sb)),
                 (f"first_data_mean_minus_second_data_mean_{a}_and_{b}", _metric_sql("diff", ma, mb)),
                 (f"percent_difference_mean_power_{a}_and_{b}", _metric_sql(p, ma, mb))]
    doubles = [m for m, _ in mets] + [ren(c, s) for s in ("_1", "_2") for c in dd]
    others = [ren(c, s) for s in ("_1", "_2") for c in do]
    return f"""WITH {ctes},
    dl AS (SELECT {L} FROM dist),
    dr AS (SELECT {R} FROM dist),
    dj AS (SELECT {', '.join(f'{e} AS "{m}"' for m, e in mets)}, dl.*, dr.*
           FROM dl JOIN dr ON {ordinal.format(x='period_start_1')} - {offset} = {ordinal.format(x='period_start_2')})
    SELECT {O.qcols(doubles, others)} FROM dj"""


@register("compare_distribution", _cmp_dist_sql(["total", *EVENT_TYPES], "D", True))
def compare_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN5/CMP4: every day of a distribution against the previous day."""
    d = _dist_df(spark, sf_dir, ["total", *EVENT_TYPES], "D", True, True)
    return compare.compare_distribution(d, "D", 1)


@register("compare_distribution_weekly", _cmp_dist_sql(["total", "click", "view"], "W", True))
def compare_distribution_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN5/CMP4: every week against the previous week."""
    d = _dist_df(spark, sf_dir, ["total", "click", "view"], "W", True, True)
    return compare.compare_distribution(d, "W", 1)


def _cmp_td_sql(load: str, period: str, offset: int = 1, mode: str = "reference") -> str:
    keys = _TD_KEYS[period]
    stats_cols = ["Energy__mean", "Energy__min", "Energy__idxmin", "Energy__max", "Energy__idxmax"]
    step = {"W": "floor(date_diff('day', DATE '1970-01-05', first_day) / 7)", "M": "(year(first_day) * 12 + month(first_day) - 1)",
            "Q": "(year(first_day) * 4 + quarter(first_day) - 1)"}[period]
    sel = [f"x.{k} AS {k}_1" for k in keys] + [f"y.{k} AS {k}_2" for k in keys]
    sel += [f"x.{c} AS {c}_1" for c in stats_cols] + [f"y.{c} AS {c}_2" for c in stats_cols]
    a, b = '"Energy__mean_1"', '"Energy__mean_2"'
    pc = "consistent" if mode == "consistent" else "over100a"
    if period in ("Q", "M"):
        k2 = keys[1]
        ix = f"make_timestamp(year_1, {k2}_1, 1, hour, 0, 0)"
        iy = f"make_timestamp(year_2, {k2}_2, 1, hour, 0, 0)"
    else:
        third = "week_2" if mode == "consistent" else "month_2"
        ix = "concat_ws('--', year_1, month_1, week_1, hour)"
        iy = f"concat_ws('--', year_2, month_2, {third}, hour)"
    doubles = ["mean_energy_difference(x-y)", "percentage(x-y)/x"] + \
        [f"{c}_{i}" for i in (1, 2) for c in ("Energy__mean", "Energy__min", "Energy__max")]
    others = ["index x", "index y", "series", "hour"] + [f"{k}_{i}" for i in (1, 2) for k in keys] + \
        [f"{c}_{i}" for i in (1, 2) for c in ("Energy__idxmin", "Energy__idxmax")]
    return f"""WITH {_td_ctes(load, period)},
    ts AS (SELECT *, {step} AS step FROM td),
    ty AS (SELECT * FROM ts QUALIFY row_number() OVER (PARTITION BY series, hour, step ORDER BY first_day DESC) = 1),
    tl AS (SELECT x.series, x.hour, {', '.join(sel)} FROM ts x JOIN ty y
           ON x.series = y.series AND x.hour = y.hour AND x.step - {offset} = y.step),
    tp AS (SELECT {_metric_sql('diff', a, b)} AS "mean_energy_difference(x-y)",
                  {_metric_sql(pc, a, b)} AS "percentage(x-y)/x", {ix} AS "index x", {iy} AS "index y", * FROM tl)
    SELECT {O.qcols(doubles, others)} FROM tp"""


def _cmp_td(name: str, load: str, view, period: str, mode: str, doc: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compare.compare_typical_day(typical_day.typical_day(view(spark, sf_dir), period), period, 1, mode)
    run.__doc__ = doc
    register(name, _cmp_td_sql(load, period, mode=mode))(run)


_cmp_td("compare_typical_day", O.events_load("H"), TQ.events_view, "W", "reference",
        "JN6/CMP5/CMP6: every week's typical day against the previous week's, hour by hour.")
_cmp_td("compare_typical_day_consistent", O.events_load("H"), TQ.events_view, "W", "consistent",
        "CMP5/CMP6 with ``percent_mode='consistent'`` (week label fixed, Q8).")
_cmp_td("compare_typical_day_week", O.orders_hourly_load(), TQ.orders_hourly_view, "W", "reference",
        "JN6 over seven years: year ends and weeks cut by a month's end.")
_cmp_td("compare_typical_day_month", O.orders_hourly_load(), TQ.orders_hourly_view, "M", "reference",
        "JN6/CMP6: every month's typical day against the previous month's, stamp labels.")
_cmp_td("compare_typical_day_quarter", O.orders_hourly_load(), TQ.orders_hourly_view, "Q", "reference",
        "JN6/CMP6: every quarter's typical day against the previous quarter's, stamp labels.")


_PAIR1 = ("2024-01-03", "2024-01-11")
_PAIR2 = ("2024-01-02", "2024-01-10", "2024-01-20")


@register("select_pairs", _cmp_stats_sql(
    O.events_load("H"), "D", "shifted", 1, None, None, True,
    where=f"""WHERE CAST(period_start_1 AS DATE) IN ({', '.join(f"DATE '{d}'" for d in _PAIR1)})
      AND CAST(period_start_2 AS DATE) IN ({', '.join(f"DATE '{d}'" for d in _PAIR2)})"""))
def select_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT8: a two-key comparison table restricted by two key lists."""
    st = stats.energy_stats(TQ.events_view(spark, sf_dir), "D", "H")
    c = compare.compare_stats(st, st, "D", "shifted", 1)
    sel = select.select_pairs(c, "period_start_1", [_d + " 00:00:00" for _d in _PAIR1],
                              "period_start_2", [_d + " 00:00:00" for _d in _PAIR2])
    return sel


# ===========================================================================
# Sources and sinks (SRC1-7, SNK1-4, REG1-3)
# ===========================================================================

def _unpivot_sql() -> str:
    l15 = O.events_load("15min", name="l15")
    readings = """SELECT c.series, CAST(c.d AS TIMESTAMP) + to_minutes(CAST((c.q - 1) * 15 AS BIGINT)) AS dt,
                         l.Energy AS energy, 0 AS o1, 0 AS o2, 0 AS o3, 0 AS o4
                  FROM (SELECT series, d, unnest(generate_series(1, 96)) AS q
                        FROM (SELECT DISTINCT series, CAST(DateTimeStart AS DATE) AS d FROM l15)) c
                  LEFT JOIN l15 l ON l.series = c.series
                   AND l.DateTimeStart = CAST(c.d AS TIMESTAMP) + to_minutes(CAST((c.q - 1) * 15 AS BIGINT))"""
    return _load_sql(l15 + ", " + O.load_ctes(readings, "H", p="u_"))


@register("unpivot_quarters", _unpivot_sql())
def unpivot_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2: 15-minute loads laid out as 96 quarter columns per day, unpivoted
    back to readings and loaded hourly."""
    from loadgrid.plans.load import load_series
    from loadgrid.sources.files import pivot_quarters, unpivot_quarters as unpivot

    l15 = TQ.events_load(spark, sf_dir, "15min")
    wide = pivot_quarters(l15.select("series", F.col("DateTimeStart").alias("DateTime"), "Energy"))
    return load_series(unpivot(wide), DEFAULT, "H")


@register("csv_round_trip", _load_sql(O.events_load("H")))
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1-SNK3: an hourly load kept under a name, written as CSV by the
    catalog's sink (``save_last``) and read back with its own columns."""
    import uuid

    from loadgrid.plans.catalog import TableCatalog
    from loadgrid.session import scratch_path

    cat = TableCatalog(spark)
    cat.keep("events hourly", TQ.events_load(spark, sf_dir, "H"), "energy_data", "H")
    path = cat.save_last(scratch_path(spark, f"csv_round_trip/{uuid.uuid4().hex}"), overwrite=False)
    return spark.read.schema("series string, DateTimeStart timestamp_ntz, DateTime timestamp_ntz, Energy double") \
        .option("header", True).option("mode", "FAILFAST").csv(path)


@register("load_meter_files", _load_sql(O.events_load("H")))
def load_meter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1, SRC3, SRC4: all readings of ``events`` written as delimited files
    in one folder per meter, with month-first stamps; read back by position,
    the meter taken from the folder's name, and loaded hourly."""
    import uuid

    from loadgrid.plans.load import load_series, parsed_once
    from loadgrid.session import scratch_path
    from loadgrid.sources.files import read_meter_files, write_meter_folders

    path = scratch_path(spark, f"meter_files/{uuid.uuid4().hex}")
    write_meter_folders(TQ.events_readings(spark, sf_dir).select(
        "series", F.date_format("DateTime", "M/d/yyyy H:mm:ss").alias("stamp"), "Energy"), path)
    return load_series(parsed_once(read_meter_files(spark, path, name_from="dir")), DEFAULT, "H", order=["__blk", "__row"])


@register("stored_load_range", _sel(_view(O.events_load("H"), _range_sql(*EVENT_RANGE)), "v", LOAD_D, LOAD_O))
def stored_load_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT1 on a stored load: the range is pushed into its scan."""
    import uuid

    from loadgrid.plans.load import store_load
    from loadgrid.session import scratch_path

    stored = store_load(TQ.events_load(spark, sf_dir, "H"), scratch_path(spark, f"stored_load/{uuid.uuid4().hex}"))
    return select.filter_range(filtered(stored), *EVENT_RANGE)


@register("start_stamped", _load_sql(f"""r AS ({O.events_readings()}),
    x AS (SELECT series, dt AS t, energy, 0 AS shift FROM r),
    {O.binned_ctes('x', 'H', 'sum', 'skip')},
    load AS (SELECT series, bin AS DateTimeStart, bin AS DateTime, Energy FROM f)"""))
def start_stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSM1 for readings stamped at the start of their interval."""
    return TQ.events_load(spark, sf_dir, "H", DEFAULT.with_(measurement_is_before_index=False))


@register("snapshot_round_trip", _stats_sql(O.events_load("H"), "D"))
def snapshot_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REG1 + SNK4 + SRC6: keep a load and its statistics, snapshot the
    catalog to Parquet, restore the newest snapshot, read the statistics."""
    import uuid

    from loadgrid.plans.catalog import TableCatalog
    from loadgrid.session import scratch_path

    root = scratch_path(spark, f"snapshots/{uuid.uuid4().hex}")
    cat = TableCatalog(spark)
    load = TQ.events_load(spark, sf_dir, "H")
    cat.keep("events hourly", load, "energy_data", "H")
    cat.keep("events_daily_stats", stats.energy_stats(filtered(load), "D"), "energy_stats_data", "D")
    cat.store_state(root)
    restored = TableCatalog(spark)
    restored.load_state(root)
    return restored.get("events_daily_stats")


# ===========================================================================
# Sub-hourly loads inside the other operators (RSM5 / Q4) and power input
# ===========================================================================

def _hourly_of_15min_ctes(where: str = "") -> str:
    """``h15``: the 15-minute event loads' filtered view as hourly rows (sum,
    last stamp) of the hours that have rows."""
    return f"""{O.events_load('15min', name='l15')},
    v15 AS (SELECT * FROM l15 WHERE Energy IS NOT NULL {where}),
    h15 AS (SELECT series, date_trunc('hour', DateTimeStart) AS DateTimeStart, max(DateTime) AS DateTime,
                   sum(Energy) AS Energy FROM v15 GROUP BY series, date_trunc('hour', DateTimeStart))"""


def _business_view(spark, sf_dir):
    return select.select_rows(filtered(TQ.events_load(spark, sf_dir, "15min")), None, 0, 1)


@register("stats_day_15min_business_hours", f"""WITH {_hourly_of_15min_ctes(' AND ' + _bhour_sql())},
    {O.stats_ctes('h15', 'D')}
    SELECT {O.qcols(*O.stats_cols('D'))} FROM st""")
def stats_day_15min_business_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSM5 + FLT4 + AGG1: daily statistics of 15-minute loads in business hours."""
    return stats.energy_stats(_business_view(spark, sf_dir), "D", "15min")


@register("distribution_15min_business", (lambda t: f"WITH {t[0]}\nSELECT {O.qcols(t[1], t[2])} FROM dist")(
    _dist_ctes(_hourly_of_15min_ctes(" AND " + _bhour_sql()), EVENT_TYPES, "D", True, False, view_src="h15")))
def distribution_15min_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSM5 + FLT4 + DST1: 15-minute loads in business hours, on their common hours."""
    return distribution.energy_distribution(_business_view(spark, sf_dir), EVENT_TYPES, "D", "15min")


@register("typical_day_15min", f"WITH {_td_ctes(_hourly_of_15min_ctes(), 'M', src='h15')}\nSELECT "
                               f"{O.qcols(TD_D, ['series', 'year', 'month', 'hour', *TD_O])} FROM td")
def typical_day_15min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TYP1-3 on a 15-minute load: converted to hourly rows first (RSM5)."""
    view = filtered(TQ.events_load(spark, sf_dir, "15min"))
    return typical_day.typical_day(view, "M", "15min")


def _dist15_sql() -> str:
    ctes, d, o = _dist_ctes(_hourly_of_15min_ctes(), EVENT_TYPES, "D", True, False, view_src="h15")
    return f"WITH {ctes}\nSELECT {O.qcols(d, o)} FROM dist"


@register("distribution_15min", _dist15_sql())
def distribution_15min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DST1 on 15-minute loads: hourly rows first, then common stamps."""
    view = filtered(TQ.events_load(spark, sf_dir, "15min"))
    return distribution.energy_distribution(view, EVENT_TYPES, "D", "15min")


_fn = _stats_q(TQ.events_load, "H", "M", POWER)
_fn.__doc__ = "AGG1-8 on a power load (hourly means)."
register("stats_month_power", _stats_sql(O.events_load("H", how="mean"), "M"))(_fn)


# ===========================================================================
# Rejects and counts of files, names, checks, the catalog (SRC1-4, SRC7, REG2-3, ...)
# ===========================================================================

def _planted(spark, sf_dir) -> DataFrame:
    """All events as texts, some of them unreadable: by the event's number a
    stamp that is none, readings that are no number, missing ones."""
    e = TQ.table(spark, sf_dir, "events")
    n = F.col("event_id")
    stamp = F.when(n % 97 == 0, "not a day").otherwise(F.date_format(F.col("ts").cast("timestamp_ntz"), "M/d/yyyy H:mm:ss"))
    reading = F.when(n % 97 == 0, "1.5").when(n % 89 == 0, "abc").when(n % 83 == 0, "1,234.5").when(n % 79 == 0, "").when(n % 71 == 0, "NA") \
        .otherwise(F.col("value").cast("string"))
    return e.select(F.col("event_type").alias("series"), stamp.alias("stamp"), reading.alias("reading"))


def _meter_folders(spark, rows: DataFrame, name: str) -> str:
    import uuid

    from loadgrid.session import scratch_path
    from loadgrid.sources.files import write_meter_folders

    path = scratch_path(spark, f"{name}/{uuid.uuid4().hex}")
    write_meter_folders(rows, path)
    return path


@register("meter_file_rejects", """SELECT event_type AS series,
    CASE WHEN event_id % 97 = 0 THEN 'not a day' ELSE strftime(ts, '%-m/%-d/%Y %-H:%M:%S') END AS stamp,
    CASE WHEN event_id % 97 = 0 THEN '1.5' WHEN event_id % 89 = 0 THEN 'abc' ELSE '1,234.5' END AS reading,
    CASE WHEN event_id % 97 = 0 THEN 'no stamp layout fits' ELSE 'the reading is no number' END AS reason
    FROM events WHERE event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 83 = 0""")
def meter_file_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1: the unreadable rows of meter files with the reason."""
    from loadgrid.sources.files import read_readings

    path = _meter_folders(spark, _planted(spark, sf_dir), "planted")
    return read_readings(spark, path, name_from="dir", rejects=True).drop("file")


@register("meter_file_counts", """WITH r AS (SELECT event_type AS series, event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 83 = 0 AS bad,
        event_id % 79 = 0 OR event_id % 71 = 0 OR value IS NULL OR isnan(value) AS missing FROM events)
    SELECT series, count(*) AS lines, count(*) FILTER (WHERE NOT bad AND NOT missing) AS readings,
           count(*) FILTER (WHERE NOT bad AND missing) AS missing, count(*) FILTER (WHERE bad) AS rejects FROM r GROUP BY series""")
def meter_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1, SRC3: lines, readings, missing ones and rejects of every meter's files."""
    from loadgrid.sources.files import read_counts

    path = _meter_folders(spark, _planted(spark, sf_dir), "planted")
    c = read_counts(spark, path, name_from="dir").groupBy("series")
    return c.agg(*[F.sum(n).cast("long").alias(n) for n in ("lines", "readings", "missing", "rejects")])


_WIDE_DAYS = O.events_load("15min", name="l15") + """,
    d AS (SELECT DISTINCT series, CAST(DateTimeStart AS DATE) AS d FROM l15)"""


def _wide_planted(spark, sf_dir) -> DataFrame:
    """The 15-minute event loads in the wide layout, as texts: every 11th day
    of a month without a date, on every 7th a cell that is no number, on every
    5th one that is not available."""
    from loadgrid.sources.files import QUARTERS, pivot_quarters

    wide = pivot_quarters(TQ.events_load(spark, sf_dir, "15min").select("series", F.col("DateTimeStart").alias("DateTime"), "Energy"))
    day = F.col("Date_") % 100
    cells = [F.col(f"`{q}`").cast("string").alias(q) for q in QUARTERS]
    cells[4] = F.when(day % 7 == 0, "x").when(day % 5 == 0, "n/a").otherwise(F.col("`5`").cast("string")).alias("5")
    return wide.select("series", F.when(day % 11 == 0, "someday").otherwise(F.col("Date_").cast("string")).alias("Date_"), *cells)


@register("wide_file_rejects", f"""WITH {_WIDE_DAYS}
    SELECT series, CASE WHEN day(d) % 11 = 0 THEN 'someday' ELSE strftime(d, '%Y%m%d') END AS date,
           CASE WHEN day(d) % 11 <> 0 THEN 5 END AS day_quarter, CASE WHEN day(d) % 11 <> 0 THEN 'x' END AS cell,
           CASE WHEN day(d) % 11 = 0 THEN 'the date is none' ELSE 'the cell is no number' END AS reason
    FROM d WHERE day(d) % 11 = 0 OR day(d) % 7 = 0""")
def wide_file_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2: the unreadable lines and cells of wide files with the reason."""
    from loadgrid.sources.files import read_wide_csv

    path = _meter_folders(spark, _wide_planted(spark, sf_dir), "wide_planted")
    return read_wide_csv(spark, path, name_from="dir", rejects=True).drop("file")


@register("wide_files", f"""WITH {O.events_load("15min", name="l15")},
    d AS (SELECT DISTINCT series, CAST(DateTimeStart AS DATE) AS d FROM l15),
    q AS (SELECT series, CAST(d AS TIMESTAMP) + to_minutes(CAST(15 * q AS BIGINT)) AS DateTime FROM d, (SELECT unnest(range(96)) AS q))
    SELECT q.series, q.DateTime, {O.q('l15.Energy')} AS Energy FROM q LEFT JOIN l15 ON l15.series = q.series AND l15.DateTimeStart = q.DateTime""")
def wide_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2: wide files, every day a line of 96 cells, read as readings."""
    from loadgrid.sources.files import pivot_quarters, read_wide_csv

    wide = pivot_quarters(TQ.events_load(spark, sf_dir, "15min").select("series", F.col("DateTimeStart").alias("DateTime"), "Energy"))
    return read_wide_csv(spark, _meter_folders(spark, wide, "wide"), name_from="dir")


@register("meter_names", r"""SELECT p_partkey, regexp_replace(trim(p_name), '\s+', '_', 'g') || '_' || p_brand AS hourly,
    regexp_replace(trim(p_name), '\s+', '_', 'g') || '_' || p_brand || '_period_D' AS daily FROM part""")
def meter_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4, SC11: names of meters from the names of their files (URL-encoded,
    with white space around and inside, an extension, a period)."""
    from loadgrid.functions.naming import series_name_column

    p = TQ.table(spark, sf_dir, "part")
    file = F.replace(F.url_encode(F.concat(F.lit(" "), "p_name", F.lit("  "), "p_brand", F.lit(" .csv"))), F.lit("+"), F.lit("%20"))
    return p.select("p_partkey", series_name_column(file).alias("hourly"), series_name_column(file, "D").alias("daily"))


@register("catalog_tables", f"""WITH {O.events_load('H')}, {O.orders_load('D', name='load2', p='o_')},
    v AS (SELECT * FROM load WHERE Energy IS NOT NULL), {O.stats_ctes('v', 'D')}
    SELECT 'events_hourly' AS name, 'energy_data' AS kind, 'H' AS period, count(*) AS n_rows FROM load
    UNION ALL SELECT 'orders', 'energy_data', 'D', count(*) FROM load2
    UNION ALL SELECT 'daily', 'energy_stats_data', 'D', count(*) FROM st""")
def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT12, REG1, REG2: tables kept under names, one removed, listed by kind
    (names are found as they were given), with their rows."""
    from functools import reduce

    from loadgrid.plans.catalog import TableCatalog

    cat = TableCatalog(spark)
    load = TQ.events_load(spark, sf_dir, "H")
    cat.keep(" events  hourly ", load, "energy_data", "H")
    cat.keep("orders", TQ.orders_load(spark, sf_dir, "D"), "energy_data", "D")
    cat.keep("dropped", load, "energy_data", "H")
    cat.keep("daily", stats.energy_stats(filtered(cat.get(" events  hourly ")), "D"), "energy_stats_data", "D")
    cat.remove("dropped")
    listed = [(n, k) for k in ("energy_data", "energy_stats_data", "typical_day") for n in cat.names(k)]
    return reduce(DataFrame.unionByName, [cat.get(n).agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(n).alias("name"), F.lit(k).alias("kind"), F.lit(cat.entry(n).period).alias("period"), "n_rows") for n, k in listed])


_CHECKS = (("a file of unknown format", "NotImplementedError"), ("a table that is not kept", "TableNotFound"),
           ("loads of different resolutions distributed", "ValueError"), ("statistics of different periods compared", "ValueError"),
           ("a whole-range profile compared", "PeriodNotSupported"), ("a typical day of days", "PeriodNotSupported"),
           ("a typical day of years", "PeriodNotSupported"))


@register("raised_checks", f"""WITH {O.events_load('H')}, n AS (SELECT count(*) AS n_rows FROM load),
    c(check_, error) AS (VALUES {', '.join(str(c) for c in _CHECKS)})
    SELECT check_ AS "check", error, n_rows FROM c, n""")
def raised_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7, DST5, TYP6, CMP7, REG3: what the commands refuse, one row for
    each with the error, beside the rows of the load that they were given."""
    from loadgrid.plans.catalog import TableCatalog
    from loadgrid.sources.files import check_format

    cat = TableCatalog(spark)
    load = TQ.events_load(spark, sf_dir, "H")
    cat.keep("hours", load, "energy_data", "H")
    cat.keep("days", TQ.orders_load(spark, sf_dir, "D"), "energy_data", "D")
    daily, weekly = cat.energy_stats("hours", "D"), cat.energy_stats("hours", "W")
    whole = cat.typical_day("hours", "no_period")
    tries = {"a file of unknown format": lambda: check_format("xlsx"), "a table that is not kept": lambda: cat.get("weeks"),
             "loads of different resolutions distributed": lambda: cat.energy_dist(["hours", "days"], EVENT_TYPES),
             "statistics of different periods compared": lambda: cat.compare_stats(daily, weekly),
             "a whole-range profile compared": lambda: cat.compare_typical_day(whole),
             "a typical day of days": lambda: cat.typical_day("hours", "D"), "a typical day of years": lambda: cat.typical_day("hours", "Y")}
    raised = []
    for what, call in tries.items():
        try:
            call()
            raised.append((what, "nothing"))
        except Exception as e:      # the error is the result
            raised.append((what, type(e).__name__))
    said = F.explode(F.array(*[F.struct(F.lit(w).alias("check"), F.lit(e).alias("error")) for w, e in raised]))
    return load.agg(F.count(F.lit(1)).alias("n_rows")).select(said.alias("x"), "n_rows").select("x.*", "n_rows")


def _sorted_td_sql() -> str:
    own = ", ".join(f"{k}_{i}" for i in (1, 2) for k in ("year", "month"))
    inner = _cmp_td_sql(O.orders_hourly_load(), "M").rsplit("SELECT", 1)[0]
    return f"{inner}SELECT series, {own}, hour, row_number() OVER (PARTITION BY series ORDER BY {own}, hour) AS position FROM tp"


@register("compare_typical_day_sorted", _sorted_td_sql())
def compare_typical_day_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT2: a comparison of typical days in display order, numbered."""
    td = typical_day.typical_day(TQ.orders_hourly_view(spark, sf_dir), "M")
    out = compare.sort_typical_day_comparison(compare.compare_typical_day(td, "M"), "M")
    return out.select("series", *compare.display_order("M"), "position")


@register("stored_load_meters", _sel(_view(O.events_load("H"), f"""AND series IN ('click', 'view')
    AND CAST(DateTimeStart AS DATE) IN ({_PICKED_SQL})"""), "v", LOAD_D, LOAD_O))
def stored_load_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT7, FLT9, JN10 on a stored load in the mixed layout: the meters and
    the bounds of the days are pushed into its scan."""
    import uuid

    from loadgrid.plans.load import store_load
    from loadgrid.session import scratch_path

    stored = store_load(TQ.events_load(spark, sf_dir, "H"), scratch_path(spark, f"stored_load/{uuid.uuid4().hex}"), layout="mixed")
    return select.select_keys(select.select_keys(filtered(stored), "series", ["click", "view"]), "DateTimeStart", PICKED_DAYS, by_day=True)
