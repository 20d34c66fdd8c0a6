"""DuckDB twins of the registered queries (the correctness oracle).

Written independently of the Spark code: plain SQL over the provided tables.
Gap filling, for instance, is a per-series ``generate_series`` grid left-joined
to the bins here, while the Spark side explodes the gaps after a window.
Double outputs are quantised with the same arithmetic as
``loadgrid.plans.table_queries.quantize``.
"""

from __future__ import annotations

EPS = "2.220446049250313e-15"

# Fixed values that must equal the original tool's column names.
ROW_STATS = ("sum", "mean", "min", "idxmin", "max", "idxmax", "std", "count")
BLOCK_STATS = ("mean", "min", "idxmin", "max", "idxmax", "std", "count")
WORD = {"H": "Hourly", "D": "Daily", "W": "Weekly", "M": "Monthly", "Q": "Quarterly", "Y": "Yearly"}
TRUNC = {"H": "hour", "D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}
STEP = {"H": "INTERVAL 1 HOUR", "D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAY", "M": "INTERVAL 1 MONTH",
        "Q": "INTERVAL 3 MONTH", "Y": "INTERVAL 12 MONTH"}


def q(expr: str) -> str:
    off = "0.3183098861837907"
    e = f"greatest(floor(log10(greatest(abs({expr}), 1e-300))) - 6, -8)"
    return (f"(CASE WHEN {e} < 0 THEN floor(({expr}) * pow(10.0, -{e}) + {off}) / pow(10.0, -{e}) "
            f"ELSE floor(({expr}) / pow(10.0, {e}) + {off}) * pow(10.0, {e}) END)")


def qcols(doubles, others=()) -> str:
    parts = [f'"{c}"' for c in others] + [f'{q(chr(34) + c + chr(34))} AS "{c}"' for c in doubles]
    return ", ".join(parts)


def rnd(ts: str) -> str:
    return f"date_trunc('second', {ts} + INTERVAL 500 MILLISECOND)"


def nn(v: str) -> str:
    return f"(CASE WHEN isnan(CAST({v} AS DOUBLE)) THEN NULL ELSE CAST({v} AS DOUBLE) END)"


# -- readings: series, dt, energy, o1, o2 (order keys) ---------------------

def events_readings() -> str:
    return f"""
    SELECT event_type AS series, {rnd('ts')} AS dt, {nn('value')} AS energy, event_id AS o1, 0 AS o2,
           0 AS o3, 0 AS o4 FROM events
    UNION ALL
    SELECT 'total' AS series, {rnd('ts')} AS dt, {nn('value')} AS energy, event_id AS o1, 0 AS o2,
           0 AS o3, 0 AS o4 FROM events"""


def orders_readings() -> str:
    return f"""
    SELECT o_orderpriority AS series, {rnd('o_orderdate')} AS dt, {nn('o_totalprice')} AS energy,
           o_orderkey AS o1, 0 AS o2, 0 AS o3, 0 AS o4 FROM orders"""


def orders_hourly_readings() -> str:
    return f"""
    SELECT o_orderpriority AS series, {rnd('o_orderdate')} + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS dt,
           {nn('o_totalprice')} AS energy, o_orderkey AS o1, 0 AS o2, 0 AS o3, 0 AS o4 FROM orders"""


def orders_hourly_load(**kw) -> str:
    return load_ctes(orders_hourly_readings(), "H", **kw)


def lineitem_readings(value: str = "l_quantity") -> str:
    return f"""
    SELECT l_returnflag AS series, {rnd('l_shipdate')} AS dt, {nn(value)} AS energy,
           l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3, l_suppkey AS o4 FROM lineitem"""


def bin_expr(period: str, t: str) -> str:
    if period.endswith("min"):
        n = int(period[:-3])
        return f"(date_trunc('day', {t}) + to_minutes(CAST(floor((hour({t}) * 60 + minute({t})) / {n}) * {n} AS BIGINT)))"
    return f"date_trunc('{TRUNC[period]}', {t})"


def step(period: str) -> str:
    if period.endswith("min"):
        return f"INTERVAL {int(period[:-3])} MINUTE"
    return STEP[period]


def label_expr(period: str, b: str) -> str:
    if period in ("H", "D") or period.endswith("min"):
        return b
    if period == "W":
        return f"({b} + INTERVAL 6 DAY)"
    if period == "M":
        return f"CAST(last_day({b}) AS TIMESTAMP)"
    if period == "Q":
        return f"CAST(last_day({b} + INTERVAL 2 MONTH) AS TIMESTAMP)"
    return f"CAST(make_date(CAST(year({b}) AS BIGINT), 12, 31) AS TIMESTAMP)"


def shift_ctes(src: str, ts: str = "dt", order: str = "dt, o1, o2, o3, o4", p: str = "") -> str:
    """``{p}sh(series, shift)``: hours+minutes of the first-two-rows delta."""
    return f"""
    {p}rn_ AS (SELECT series, {ts} AS x, row_number() OVER (PARTITION BY series ORDER BY {order}) AS rn FROM {src}),
    {p}iv_ AS (SELECT series, date_diff('second', min(x) FILTER (WHERE rn = 1), min(x) FILTER (WHERE rn = 2)) AS delta
            FROM {p}rn_ WHERE rn <= 2 GROUP BY series),
    {p}sh AS (SELECT series, COALESCE(((delta % 86400 + 86400) % 86400) // 3600 * 3600
                                   + (((delta % 86400 + 86400) % 86400) // 60) % 60 * 60, 0) AS shift FROM {p}iv_)"""


def energy_expr(how: str, null_sum: str) -> str:
    if how == "mean":
        return "m"
    if null_sum == "propagate":
        return "CASE WHEN n_rows IS NULL THEN 0.0 WHEN n_val = n_rows THEN COALESCE(s, 0.0) ELSE NULL END"
    return "CASE WHEN n_rows IS NULL THEN 0.0 ELSE COALESCE(s, 0.0) END"


def binned_ctes(src: str, period: str, how: str, null_sum: str, t: str = "t", value: str = "energy",
                prefix: str = "") -> str:
    """``{prefix}f(series, shift, bin, Energy)`` with every bin from first to last."""
    p = prefix
    return f"""
    {p}b AS (SELECT series, shift, {bin_expr(period, t)} AS bin, count(*) AS n_rows, count({value}) AS n_val,
                sum({value}) AS s, avg({value}) AS m FROM {src} GROUP BY ALL),
    {p}g AS (SELECT series, shift, unnest(generate_series(lo, hi, {step(period)})) AS bin
            FROM (SELECT series, shift, min(bin) AS lo, max(bin) AS hi FROM {p}b GROUP BY series, shift)),
    {p}f AS (SELECT g.series, g.shift, g.bin, {energy_expr(how, null_sum)} AS Energy
            FROM {p}g g LEFT JOIN {p}b b ON g.series = b.series AND g.shift = b.shift AND g.bin = b.bin)"""


def end_expr(period: str, label: str, end_stamped: bool = True) -> str:
    if not end_stamped:
        return label
    if period == "H":
        return f"({label} + INTERVAL 1 HOUR)"
    if period.endswith("min"):
        return f"({label} + to_seconds(CAST(shift AS BIGINT)))"
    return label


def load_ctes(readings: str, period: str = "H", how: str = "sum", null_sum: str = "skip",
              zero_ok: bool = True, fill: str | None = None, name: str = "load", p: str = "") -> str:
    """CTE list ending in ``{name}(series, DateTimeStart, DateTime, Energy)``;
    internal CTE names carry the prefix ``p``."""
    e = "energy" if zero_ok else "CASE WHEN energy = 0 THEN NULL ELSE energy END"
    fill_cte = ""
    src = f"{p}x"
    if fill:
        fill_cte = "," + fill_ctes(f"{p}x", fill, p=p)
        src = f"{p}xf"
    return f"""
    {p}r AS ({readings}),
    {shift_ctes(f'{p}r', p=p)},
    {p}x AS (SELECT r.series, r.dt - to_seconds(CAST(sh.shift AS BIGINT)) AS t, {e} AS energy, sh.shift,
                r.o1, r.o2, r.o3, r.o4
          FROM {p}r r JOIN {p}sh sh ON r.series = sh.series){fill_cte},
    {binned_ctes(src, period, how, null_sum, prefix=p)},
    {name} AS (SELECT series, {label_expr(period, 'bin')} AS DateTimeStart,
                      {end_expr(period, label_expr(period, 'bin'))} AS DateTime, Energy FROM {p}f)"""


def fill_ctes(src: str, mode: str, p: str = "") -> str:
    """``xf``: ``energy`` filled by row position per series (interpolate /
    ffill / bfill / interpolate+ffill+bfill)."""
    w1 = "(PARTITION BY series ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    w2 = "(PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    lin = "CASE WHEN energy IS NOT NULL THEN energy WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv " \
          "ELSE pv + (nv - pv) * CAST(pos - pp AS DOUBLE) / CAST(np - pp AS DOUBLE) END"
    out = {"interpolate": lin, "ffill": "COALESCE(energy, pv)", "bfill": "COALESCE(energy, nv)",
           "all": f"COALESCE({lin}, nv)", "interp_ffill": lin}[mode]
    return f"""
    {p}xp_ AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t, o1, o2, o3, o4) AS pos FROM {src}),
    {p}xn_ AS (SELECT *, last_value(energy IGNORE NULLS) OVER {w1} AS pv,
                 last_value(CASE WHEN energy IS NOT NULL THEN pos END IGNORE NULLS) OVER {w1} AS pp,
                 first_value(energy IGNORE NULLS) OVER {w2} AS nv,
                 first_value(CASE WHEN energy IS NOT NULL THEN pos END IGNORE NULLS) OVER {w2} AS np FROM {p}xp_),
    {p}xf AS (SELECT series, t, {out} AS energy, shift, o1, o2, o3, o4 FROM {p}xn_)"""


def events_load(period: str = "H", **kw) -> str:
    return load_ctes(events_readings(), period, **kw)


def orders_load(period: str = "D", **kw) -> str:
    return load_ctes(orders_readings(), period, **kw)


def lineitem_load(period: str = "D", value: str = "l_quantity", **kw) -> str:
    return load_ctes(lineitem_readings(value), period, **kw)


# -- statistics -------------------------------------------------------------

def stat_sql(stat: str, v: str, t: str, col: str) -> str:
    return {
        "sum": f"COALESCE(sum({v}), 0.0)",
        "mean": f"avg({v})",
        "min": f"min({v})",
        "max": f"max({v})",
        "idxmin": f"first({t} ORDER BY {v} ASC, {t} ASC) FILTER (WHERE {v} IS NOT NULL)",
        "idxmax": f"first({t} ORDER BY {v} DESC, {t} ASC) FILTER (WHERE {v} IS NOT NULL)",
        "std": f"stddev_samp({v})",
        "count": f"count({v})",
    }[stat] + f' AS "{col}"'


def stats_ctes(view: str, period: str, name: str = "st") -> str:
    g = f"{WORD[period]}_Energy_Hourly_Stats"
    rows = ", ".join(stat_sql(s, "Energy", "DateTimeStart", f"{g}__{s}") for s in ROW_STATS)
    out = f"""
    {name}_r AS (SELECT series, date_trunc('{TRUNC[period]}', DateTimeStart) AS period_start, {rows}
               FROM {view} GROUP BY ALL)"""
    joins = f"{name}_r"
    if period in ("W", "M", "Q", "Y"):
        dstats = ", ".join(stat_sql(s, "day_energy", "day", f"Daily_Energy__{s}") for s in BLOCK_STATS)
        out += f""",
    {name}_d0 AS (SELECT series, date_trunc('day', DateTimeStart) AS day, avg(Energy) AS dm, count(Energy) AS dn
                FROM {view} GROUP BY ALL),
    {name}_d1 AS (SELECT series, day, dm * max(dn) OVER (PARTITION BY series) AS day_energy FROM {name}_d0),
    {name}_d AS (SELECT series, date_trunc('{TRUNC[period]}', day) AS period_start, {dstats}
               FROM {name}_d1 GROUP BY ALL)"""
        joins += f" JOIN {name}_d USING (series, period_start)"
    if period in ("Q", "Y"):
        mstats = ", ".join(stat_sql(s, "month_energy", "month", f"Monthly_Energy__{s}") for s in BLOCK_STATS)
        out += f""",
    {name}_m0 AS (SELECT series, date_trunc('month', DateTimeStart) AS month, COALESCE(sum(Energy), 0.0) AS month_energy
                FROM {view} GROUP BY ALL),
    {name}_m AS (SELECT series, date_trunc('{TRUNC[period]}', month) AS period_start, {mstats}
               FROM {name}_m0 GROUP BY ALL)"""
        joins += f" JOIN {name}_m USING (series, period_start)"
    out += f""",
    {name} AS (SELECT * FROM {joins})"""
    return out


def stats_cols(period: str) -> tuple[list[str], list[str]]:
    """(double columns, other columns) of a statistics table."""
    g = f"{WORD[period]}_Energy_Hourly_Stats"
    d, o = [], ["series", "period_start"]
    blocks = [(g, ROW_STATS)]
    if period in ("W", "M", "Q", "Y"):
        blocks.append(("Daily_Energy", BLOCK_STATS))
    if period in ("Q", "Y"):
        blocks.append(("Monthly_Energy", BLOCK_STATS))
    for grp, stats in blocks:
        for s in stats:
            (o if s in ("idxmin", "idxmax", "count") else d).append(f"{grp}__{s}")
    return d, o
