"""Operator 13: cheapest repair of conversations by weighted CYK parsing.

The turns of a conversation are to read ``(s?(ua)+)?`` by the initials of
their roles. The repair grammar is in Chomsky normal form over spans of rows:
a nonterminal ``(p, q)`` derives the edits of a span that take the pattern
from state p to state q, so its rules are ``(p, q) -> (p, r) (r, q)``. A row
alone has terminal rules: Keep (0), Rerole to user or assistant (2), Delete
(3, the only one for blank and repeated rows); a row that is left and breaks
off costs 1 more. The insertion closure adds user and assistant turns without
text (2 each) on both sides of a row. A cell holds the least (cost, audit) of
each nonterminal, the audit being the edits' initials.

Two audits of one span and nonterminal that cost the same are never a prefix
of each other (the longer one would hold more insertions), so the least audit
of a span is made of least audits of its parts, and any two ways to cut a span
give the same cell. Spans of up to ``CHART`` rows are filled bottom-up by
length over all their cuts; longer ones join neighbouring spans of doubling
length. Cells depend on the rows' symbols only and are remembered by them.

What Spark does: equal rows of a conversation and turn are counted, a row's
first occurrence is found by an aggregation, and the rows are
range-partitioned by (conv_id, turn) and sorted, so a conversation may span
many tasks. Every task turns each run of a conversation into one cell; the few
cells of a conversation are joined in order, and the edits go back to the rows
by their place. No task needs all texts of a conversation.

Rows go by turn, nulls first; rows of one turn by the SHA-256 of role and
text. Null roles and texts count as one space. Null ids are a conversation of
their own. Roles are judged by their first character. Other columns are
ignored. An empty table gives an empty result; a conversation without rows has
zeros, an empty audit and no repaired rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, prepare, staged
from .prefix_trie import turn_digest

# --- the grammar ---------------------------------------------------------------

#: States of the pattern: 0 before the first turn, 1 after s, 2 after u, 3 after a.
STATES, START, FINAL = 4, 0, (0, 3)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
CHART = 8
_PAIRS = [(p, q) for p in range(STATES) for q in range(STATES)]


def join(a: tuple, b: tuple) -> tuple:
    """The cell of two neighbouring spans: all rules (p, q) -> (p, r) (r, q)."""
    out = []
    for p, q in _PAIRS:
        best = None
        for r in range(STATES):
            x, y = a[p * STATES + r], b[r * STATES + q]
            if x is not None and y is not None:
                z = (x[0] + y[0], x[1] + y[1])
                if best is None or z < best:
                    best = z
        out.append(best)
    return tuple(out)


def least(a: tuple, b: tuple) -> tuple:
    return tuple(y if x is None else x if y is None else min(x, y) for x, y in zip(a, b))


def _insertions() -> tuple:
    """Any number of inserted turns, none included."""
    one = tuple((INSERT, "I") if any(STEP.get((p, x)) == q for x in "ua") else None for p, q in _PAIRS)
    none = tuple((0, "") if p == q else None for p, q in _PAIRS)
    out = none
    for _ in range(STATES):
        out = least(out, join(out, least(none, one)))
    return out


EMPTY = _insertions()


def terminal(symbol: str) -> tuple:
    """The closed cell of one row. ``symbol``: ``D`` and ``d`` must go; else
    its role's initial (s, u, a or o for others), in upper case if it breaks off."""
    cell: list = [(DELETE, "D") if p == q else None for p, q in _PAIRS]
    if symbol not in "Dd":
        extra = TRUNCATED if symbol.isupper() else 0
        for p in range(STATES):
            for x, cost, edit in [(symbol.lower(), KEEP, "K"), ("u", REROLE, "R"), ("a", REROLE, "R")]:
                q = STEP.get((p, x))
                if q is not None:
                    new = (cost + extra, edit)
                    cell[p * STATES + q] = min(cell[p * STATES + q] or new, new)
    return join(join(EMPTY, tuple(cell)), EMPTY)


#: A task's cells by symbols (at most 9 ** CHART exist; kept while few).
_CELLS: dict[str, tuple] = {}
MAX_CELLS = 1 << 14


def chart(symbols: str) -> tuple:
    """The cell of a short span: bottom-up by length, over all cuts."""
    got = _CELLS.get(symbols)
    if got is not None:
        return got
    n = len(symbols)
    cells = {(i, 1): terminal(x) for i, x in enumerate(symbols)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            cell = join(cells[i, 1], cells[i + 1, size - 1])
            for cut in range(2, size):
                cell = least(cell, join(cells[i, cut], cells[i + cut, size - cut]))
            cells[i, size] = cell
    if len(_CELLS) >= MAX_CELLS:
        _CELLS.clear()
    _CELLS[symbols] = cells[0, n] if n else EMPTY
    return _CELLS[symbols]


def parse(symbols: str) -> tuple:
    """The cell of a span of any length."""
    return combine([chart(symbols[i: i + CHART]) for i in range(0, len(symbols), CHART)])


def combine(cells: list) -> tuple:
    """The cell of neighbouring spans, by spans of doubling length."""
    while len(cells) > 1:
        cells = [join(*cells[i: i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else EMPTY


def best(cell: tuple) -> tuple[int, str]:
    return min(cell[START * STATES + q] for q in FINAL if cell[START * STATES + q] is not None)


def outcome(symbols: str, audit: str, state: int = START) -> tuple[list[str], int]:
    """What becomes of each row: ``U`` / ``A`` an inserted turn, ``k`` kept,
    ``u`` / ``a`` given that role. Insertions stand with the row before them
    (with the first one if there is none), copies (``d``) with their row. And
    the state behind."""
    out, at = [""], -1
    for edit in audit:
        if edit != "I":
            at += 1
            if at and symbols[at] != "d":
                out.append("")
        if edit == "D":
            continue
        x = symbols[at].lower() if edit == "K" else "a" if state == 2 else "u"
        state = STEP[state, x]
        out[-1] += "k" if edit == "K" else x if edit == "R" else x.upper()
    return out, state


# --- rows ------------------------------------------------------------------------

_SPACE = r"\x20\x09-\x0D"

def faults(turns: DataFrame) -> DataFrame:
    """The distinct rows of ``turns(conv_id, turn, role, text)`` with their
    number ``n``, ``digest``, the ``blank`` / ``again`` / ``cut`` marks of the
    first of them, and its grammar symbol ``x`` (see :func:`terminal`)."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = staged(turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
                  .groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
                  .withColumn("digest", turn_digest(F.col("role"), F.col("text"))), "repair-rows")
    # rows seen under several turns: all but the first turn repeat it
    seen = staged(rows.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("g")).agg(
        F.count("*").alias("k"), F.min("turn").alias("lo"), F.max(F.col("turn").isNull()).alias("none")).where("k > 1"), "repair-seen")
    d = rows.join(seen, rows["conv_id"].eqNullSafe(seen["c"]) & (rows["digest"] == seen["g"]), "left")
    again = F.coalesce(F.col("turn").isNotNull() & (F.col("none") | (F.col("turn") > F.col("lo"))), F.lit(False))
    first = F.substring("role", 1, 1)
    d = d.select("conv_id", "turn", "role", "text", "n", "digest", (~F.col("text").rlike(f"[^{_SPACE}]")).alias("blank"), again.alias("again"),
                 (~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")).alias("cut"), first.alias("initial"))
    letter = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    return d.withColumn("x", F.when(F.col("blank") | F.col("again"), "D").when(F.col("cut"), F.upper(letter)).otherwise(letter))


def placed(rows: DataFrame) -> DataFrame:
    """Rows in order: ``at`` rises by 1 along the rows of a task, conversation
    by conversation; written, since later steps refer to it."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest"]
    return staged(rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "digest").sortWithinPartitions(*order)
                  .withColumn("at", F.monotonically_increasing_id()), "repair-placed")


_RUN = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("symbols", pa.string()), ("head", pa.string()), ("tail", pa.string()),
                  ("illegal", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
_RUN_DDL = "conv_id long, at long, symbols string, head string, tail string, illegal long, costs array<long>, audits array<string>"
#: Neighbouring initials that are in order.
LEGAL = {"su", "ua", "au"}


def _runs(batches):
    """Rows in order -> one cell for each run of a conversation."""
    def emit(runs):
        cells = [parse(r[2]) for r in runs]
        return batch(_RUN, *map(list, zip(*runs)), [[None if c is None else c[0] for c in cell] for cell in cells],
                     [[None if c is None else c[1] for c in cell] for cell in cells])

    done, conv, start, last, symbols, head, tail, illegal = [], None, None, None, [], None, None, 0
    for b in batches:
        for c, at, x, initial, n in zip(*(col.to_pylist() for col in b.columns)):
            if start is not None and (c != conv or at != last + 1):
                done.append((conv, start, "".join(symbols), head, tail, illegal))
                start = None
            if start is None:
                conv, start, symbols, head, illegal = c, at, [], initial, 0
            else:
                illegal += tail + initial not in LEGAL
            symbols.append(x + "d" * (n - 1))
            illegal += n - 1                  # no initial may follow itself
            tail, last = initial, at
        if len(done) >= 1024:
            yield emit(done)
            done = []
    if start is not None:
        done.append((conv, start, "".join(symbols), head, tail, illegal))
    if done:
        yield emit(done)


_PLAN = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("symbols", pa.string()), ("part", pa.string()), ("state", pa.int32()),
                   ("cost", pa.int64()), ("illegal", pa.int64()), ("audit", pa.string())])


def _joined(runs: list[dict]) -> list[tuple]:
    """The runs of one conversation -> its cheapest repair, cut back into runs;
    the first one also has what holds for all: cost, illegal, whole audit."""
    cells = [tuple(None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"])) for r in runs]
    cost, audit = best(combine(cells))
    illegal = sum(r["illegal"] for r in runs) + sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(runs, runs[1:]))
    out, state, at = [], START, 0
    for i, r in enumerate(runs):
        end, left = at, len(r["symbols"])
        while left:                           # insertions go in front of a row, those at the end to the last run
            left -= audit[end] != "I"
            end += 1
        if i + 1 == len(runs):
            end = len(audit)
        out.append((r["conv_id"], r["at"], r["symbols"], audit[at:end], state, *((cost, illegal, audit) if i == 0 else (None, None, None))))
        if i + 1 < len(runs):
            _, state = outcome(r["symbols"], audit[at:end], state)
        at = end
    return out


def _plans(batches):
    """Runs by conversation and place -> their repairs."""
    runs: list[dict] = []
    for b in batches:
        out = []
        for r in b.to_pylist():
            if runs and r["conv_id"] != runs[0]["conv_id"]:
                out += _joined(runs)
                runs = []
            runs.append(r)
        if out:
            yield batch(_PLAN, *map(list, zip(*out)))
    if runs:
        yield batch(_PLAN, *map(list, zip(*_joined(runs))))


_PLAN_DDL = "conv_id long, at long, symbols string, part string, state int, cost long, illegal long, audit string"


def plan(rows: DataFrame) -> DataFrame:
    """``placed`` rows -> their cheapest repair: a row for each run, and on the
    first run of a conversation its ``cost``, ``illegal`` pairs and ``audit``."""
    runs = staged(rows.select("conv_id", "at", "x", "initial", "n").mapInArrow(_runs, _RUN_DDL), "repair-runs")
    return staged(runs.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_plans, _PLAN_DDL), "repair-plan")


_OUT = pa.schema([("at", pa.int64()), ("out", pa.string())])


def _outcomes(batches):
    for b in batches:
        for at, symbols, part, state in zip(*(c.to_pylist() for c in b.columns)):
            out, _ = outcome(symbols, part, state)
            yield batch(_OUT, list(range(at, at + len(out))), out)


def repaired_turns(rows: DataFrame, repair: DataFrame) -> DataFrame:
    """The repaired conversations, ``(conv_id, at, place, role, text)`` in the
    order of (at, place); inserted turns have an empty text."""
    out = repair.select("at", "symbols", "part", "state").mapInArrow(_outcomes, "at long, out string").where("out <> ''")
    letters = F.transform(F.sequence(F.lit(1), F.length("out")), lambda i: F.substr("out", i, F.lit(1)))
    x = F.col("x")
    return rows.select("conv_id", "at", "role", "text").join(out, "at").select("conv_id", "at", "role", "text", F.posexplode(letters).alias("place", "x")) \
        .select("conv_id", "at", "place", F.when(x.isin("u", "U"), "user").when(x.isin("a", "A"), "assistant").otherwise(F.col("role")).alias("role"),
                F.when(x.isin("U", "A"), "").otherwise(F.col("text")).alias("text"))


_SHA = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def _digest(batches):
    conv, state = None, None
    for b in batches:
        out = []
        for c, line in zip(*(col.to_pylist() for col in b.columns)):
            if state is not None and c == conv:
                state.update(b"\n" + line.encode("utf-8", "surrogatepass"))
                continue
            if state is not None:
                out.append((conv, state.hexdigest()))
            conv, state = c, hashlib.sha256(line.encode("utf-8", "surrogatepass"))
        if out:
            yield batch(_SHA, *map(list, zip(*out)))
    if state is not None:
        yield batch(_SHA, [conv], [state.hexdigest()])


def digests(repaired: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of the lines ``role:text`` of each conversation, in a stream."""
    return repaired.select("conv_id", "at", "place", F.concat("role", F.lit(":"), "text").alias("line")).repartition("conv_id") \
        .sortWithinPartitions("conv_id", "at", "place").select("conv_id", "line").mapInArrow(_digest, "conv_id long, repaired_sha256 string")


def summary(ids: DataFrame, rows: DataFrame, repair: DataFrame, sha: DataFrame) -> DataFrame:
    """One row for each of ``ids(conv_id)``: gaps, faults, illegal pairs, cost,
    audit and the digest of the repaired turns."""
    n = F.col("n")
    counts = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("again"), n).otherwise(n - 1)).alias("duplicate"),
        F.sum(F.when(F.col("cut") & ~F.col("blank") & ~F.col("again"), 1).otherwise(0)).alias("truncated"))
    out = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for side in (counts, repair.where("audit IS NOT NULL").select("conv_id", "illegal", "cost", "audit"), sha):
        s = side.withColumnRenamed("conv_id", "__id")
        out = out.join(s, F.col("conv_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The placed rows of ``turns(conv_id, turn, role, text)``, their repair and the repaired turns."""
    prepare(turns.sparkSession)
    rows = placed(faults(turns))
    p = plan(rows)
    return rows, p, repaired_turns(rows, p)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations broken in fixed ways, by the CRC-32 of ``conv_id:turn``."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    return conversations.withColumn("k", kind).where("k <> 0").select(
        "conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(text_of("role")).alias("role"), text.alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


# DuckDB: the damage by a CRC-32 table; the cheapest edits by a walk over the rows with one (cost, audit, lines) for each state
def _oracle() -> str:
    ins = lambda s, who: f"CASE WHEN {s} IS NOT NULL THEN {{c: {s}.c + 2, a: {s}.a || 'I', t: list_append({s}.t, '{who}:')}} END"
    drop = lambda s: f"CASE WHEN {s} IS NOT NULL THEN {{c: {s}.c + 3, a: {s}.a || 'D', t: {s}.t}} END"
    keep = lambda s, x: (f"CASE WHEN {s} IS NOT NULL AND NOT gone AND i = '{x}' THEN "  # noqa: E731
                         f"{{c: {s}.c + cut, a: {s}.a || 'K', t: list_append({s}.t, role || ':' || text)}} END")
    turn = lambda s, who: (f"CASE WHEN {s} IS NOT NULL AND NOT gone THEN "  # noqa: E731
                           f"{{c: {s}.c + 2 + cut, a: {s}.a || 'R', t: list_append({s}.t, '{who}:' || text)}} END")
    closed = f"(SELECT * REPLACE (least(s3, {ins('s2', 'assistant')}) AS s3) FROM (SELECT * REPLACE (least(s2, {ins('s0', 'user')}, {ins('s1', 'user')}, " \
             f"{ins('s3', 'user')}) AS s2) FROM w))"
    to_user = ", ".join([keep(s, "u") for s in ("s0", "s1", "s3")] + [turn(s, "user") for s in ("s0", "s1", "s3")])
    return rf"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
         lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295::BIGINT,
          list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
          lambda a, x: xor(t[CAST(xor(a, x) & 255 AS INT) + 1], a >> 8)), 4294967295) % 20 AS k FROM conversations, tab),
dmg AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
               CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy FROM src WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(sha256(role) || sha256(text)), copy) AS p FROM dmg),
f AS (SELECT conv_id, turn, p, role, text, substr(role, 1, 1) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS again,
             CAST(NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS BIGINT) AS cut,
             lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS nxt FROM o),
g AS (SELECT *, blank OR again AS gone FROM f),
ids AS (SELECT DISTINCT conv_id FROM conversations),
w AS (SELECT conv_id, 0::BIGINT AS p, {{c: 0::BIGINT, a: '', t: []::VARCHAR[]}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]) AS s1,
             NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]) AS s2, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]) AS s3 FROM ids
      UNION ALL
      SELECT w.conv_id, g.p, {drop('s0')}, least({drop('s1')}, {keep('s0', 's')}), least({drop('s2')}, {to_user}),
             least({drop('s3')}, {keep('s2', 'a')}, {turn('s2', 'assistant')})
      FROM {closed} w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.p = w.p + 1),
z AS (SELECT conv_id, least(s0, s3) AS b FROM {closed} QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY p DESC) = 1),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
             count(*) FILTER (WHERE again AND NOT blank) AS duplicate, count(*) FILTER (WHERE cut = 1 AND NOT gone) AS truncated,
             count(*) FILTER (WHERE nxt IS NOT NULL AND i || nxt NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, b.c AS cost, b.a AS audit, sha256(array_to_string(b.t, chr(10))) AS repaired_sha256
FROM z LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM z.conv_id
"""


ORACLE = _oracle()
