"""Readers of meter files.

* two-column delimited files (stamp, reading), the columns taken by position
  whatever their header says; many files are one read, each file a series
  named after it (or after its ``series=<name>`` folder);
* the wide quarter-hour layout: one row per day (``Date_`` = yyyymmdd) and
  columns ``1`` .. ``96``, unpivoted to readings.

The readers declare their schema (no inference pass) and stay lazy. Nothing
unreadable becomes a missing reading: a line with missing or surplus fields, a
stamp or date that fits no layout and a reading or cell that is no number
raise when the rows are read, or are the result with ``rejects``, which also
tells why. Empty texts and the usual marks for "not available" are missing.
``read_counts`` adds up lines, missing readings and rejects file by file.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, LoadConfig
from ..functions.joins import small_side
from ..functions.naming import series_name_column, series_name_from_file
from ..functions.time import ntz, round_to_second

SERIES = "series"

# Stamp layouts tried in order after ISO; a call reads all its files either
# month first or day first, never row by row.
_ANY = ("yyyy/M/d[ H:mm[:ss]]", "yyyyMMdd[ HH:mm:ss]", "d MMM yyyy[ H:mm[:ss]]", "d MMMM yyyy[ H:mm[:ss]]",
        "MMM d yyyy[ H:mm[:ss]]", "MMM d, yyyy[ H:mm[:ss]]", "MMMM d, yyyy[ H:mm[:ss]]")
MONTH_FIRST = _ANY + tuple(f"M{s}d{s}yyyy{t}" for s in "/-." for t in ("[ H:mm[:ss]]", " h:mm[:ss] a"))
DAY_FIRST = _ANY + tuple(f"d{s}M{s}yyyy{t}" for s in "/-." for t in ("[ H:mm[:ss]]", " h:mm[:ss] a"))

READINGS_SCHEMA = T.StructType([
    T.StructField("DateTime", T.StringType(), True),
    T.StructField("Energy", T.StringType(), True),
])

QUARTERS = [str(q) for q in range(1, 97)]
WIDE_TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in ("Date_", *QUARTERS)])

SUPPORTED_FORMATS = ("csv", "parquet")

# Texts that count as a missing reading, as in common table readers.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
           "NaN", "None", "n/a", "nan", "null")
_LINE, _STAMP = "__line", "__stamp"


def parse_datetime(c: Column, day_first: bool = False, formats: Sequence[str] | None = None) -> Column:
    """The stamp as wall time (a zone in the text is not applied); NULL if
    neither ISO nor one of the layouts fits."""
    text = F.trim(c)
    layouts = formats or (DAY_FIRST if day_first else MONTH_FIRST)

    def read(layout: str) -> Column:
        got, shape = ntz(F.try_to_timestamp(text, F.lit(layout))), layout_shape(layout)
        return got if shape is None else F.when(text.rlike(shape), got)

    return F.coalesce(text.try_cast("timestamp_ntz"), *[read(f) for f in layouts])


_FIELDS = {"yyyy": "[+-]?[0-9]{4,}", "MMM": "[A-Za-z]+", "MMMM": "[A-Za-z]+", "a": "[A-Za-z]+", **{c: "[+-]?[0-9]+" for c in "MdHh"},
           **{c: "[0-9]{2}" for c in ("MM", "dd", "HH", "hh", "mm", "ss")}, "[": "(?:", "]": ")?"}


def layout_shape(layout: str) -> str | None:
    """A pattern that every text of a layout has (other texts may have it too),
    so that a stamp is only read by layouts it can fit: one that fails costs an
    exception. None for a layout with other fields than those above."""
    out = []
    for part in re.findall(r"([A-Za-z])(\1*)|(.)", layout, re.S):
        field = part[0] + part[1]
        if field and field not in _FIELDS or part[2] in ("'", "#", "{", "}"):
            return None
        out.append(_FIELDS.get(field or part[2]) or re.escape(part[2]))
    return f"^{''.join(out)}$"


def parse_energy(c: Column, decimal_comma: bool = False) -> Column:
    """The reading; NULL for a missing one, and for a text that is no number
    (see :func:`no_number`)."""
    s = F.trim(c.cast("string"))
    if decimal_comma:
        s = F.regexp_replace(s, ",", ".")
    v = s.try_cast("double")
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def no_number(c: Column, decimal_comma: bool = False) -> Column:
    """Whether a reading is neither a number nor missing."""
    s = F.trim(c.cast("string"))
    number = (F.regexp_replace(s, ",", ".") if decimal_comma else s).try_cast("double")
    return F.coalesce(number.isNull() & ~s.isin(*MISSING), F.lit(False))


def _or_raise(value: Column, why: Column, said: Column) -> Column:
    """``value`` where ``why`` is NULL; raises what is wrong elsewhere."""
    return F.when(why.isNull(), value).otherwise(F.raise_error(said).cast("double"))


def check_format(fmt: str) -> str:
    f = fmt.lower().lstrip(".")
    if f not in SUPPORTED_FORMATS:
        raise NotImplementedError(f"unsupported file type {fmt!r}; supported: {SUPPORTED_FORMATS}")
    return f


def read_readings(spark: SparkSession, paths: str | Sequence[str], fmt: str = "csv", *, header: bool = True,
                  sep: str = ",", name_from: str = "file", period: str | None = None,
                  cfg: LoadConfig = DEFAULT, decimal_comma: bool = False, day_first: bool = False,
                  formats: Sequence[str] | None = None, rejects: bool = False) -> DataFrame:
    """Two-column meter files -> readings ``series, DateTime, Energy, __blk,
    __row`` (the last two keep each file's row order for equal stamps).

    ``name_from``: ``"file"`` -- series = file name without extension, trimmed,
    inner white space as ``_``, plus ``_period_<p>`` for a non-default period;
    ``"dir"`` -- the ``series=<name>`` folder (Spark partition discovery).

    Slash, dash and dot dates are read month first unless ``day_first``. A row
    whose stamp fits no layout, a reading that is no number and a delimited
    line with missing or surplus fields raise; with ``rejects`` the call
    returns those rows instead (``series, stamp, reading, reason, file``).
    """
    raw, first, second, series, stamped = _two_columns(spark, paths, fmt, header, sep, name_from, period, cfg)
    ts = first.cast("timestamp_ntz") if stamped else parse_datetime(first.cast("string"), day_first, formats)
    why = _fault(raw, ts, second, decimal_comma)
    if rejects:
        return raw.select(series.alias(SERIES), first.cast("string").alias("stamp"), second.cast("string").alias("reading"),
                          why.alias("reason"), F.col("_metadata.file_path").alias("file")).where(F.col("reason").isNotNull())
    # a step of its own, as each stamp is used more than once; DateTime itself reads it once, for filters that Spark moves below the step
    raw, stamp = raw.withColumn(_STAMP, ts), F.col(_STAMP)
    why, other = _fault(raw, stamp, second, decimal_comma), _fault(raw, F.lit(True), second, decimal_comma)
    said = F.concat(F.lit("meter "), series, F.lit(": "), why, F.lit(" ("), F.coalesce(first.cast("string"), F.lit("an empty stamp")), F.lit(", "),
                    F.coalesce(second.cast("string"), F.lit("no reading")), F.lit(")"))
    return raw.select(
        series.alias(SERIES),
        round_to_second(F.coalesce(F.when(other.isNull(), stamp), F.raise_error(said).cast("timestamp_ntz"))).alias("DateTime"),
        _or_raise(parse_energy(second, decimal_comma), why, said).alias("Energy"),
        F.col("_metadata.file_block_start").alias("__blk"),
        F.monotonically_increasing_id().alias("__row"))


def _two_columns(spark, paths, fmt, header, sep, name_from, period, cfg):
    """The raw rows of two-column files, the two columns, the series, and whether the first one is a stamp already."""
    fmt = check_format(fmt)
    paths = [paths] if isinstance(paths, str) else list(paths)
    if fmt == "csv":
        raw = _lines(spark, READINGS_SCHEMA, header, sep, paths)
        first, second = F.col("DateTime"), F.col("Energy")
    else:
        raw = spark.read.parquet(*paths)
        cols = [c for c in raw.columns if c != SERIES]
        first, second = F.col(f"`{cols[0]}`"), F.col(f"`{cols[1]}`")
    if name_from == "file":
        series = series_name_column(F.col("_metadata.file_name"), period, cfg.time_resolution)
        _require_own_names(raw)
    elif name_from == "dir":
        series = F.col(SERIES).cast("string")
        if period is not None and period != cfg.time_resolution:
            series = F.concat(series, F.lit(f"_period_{period}"))
    else:
        raise ValueError("name_from must be 'file' or 'dir'")
    stamped = fmt == "parquet" and isinstance(raw.schema[0].dataType, (T.TimestampType, T.TimestampNTZType))
    return raw, first, second, series, stamped


def _lines(spark: SparkSession, schema: T.StructType, header: bool, sep: str, paths: list[str]) -> DataFrame:
    """Delimited lines; one with missing or surplus fields keeps its text in
    ``__line`` (which takes whole lines: no fields are left unread)."""
    own = T.StructType([*schema.fields, T.StructField(_LINE, T.StringType(), True)])
    return spark.read.schema(own).option("header", header).option("sep", sep).option("enforceSchema", True).option("columnPruning", False) \
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _LINE).csv(paths)


def _fault(raw: DataFrame, ts: Column, reading: Column, decimal_comma: bool) -> Column:
    """Why a two-column row can't be read; NULL if it can."""
    fields = F.col(_LINE).isNotNull() if _LINE in raw.columns else F.lit(False)
    return F.when(fields, "missing or surplus fields").when(ts.isNull(), "no stamp layout fits") \
        .when(no_number(reading, decimal_comma), "the reading is no number")


def _require_own_names(raw: DataFrame) -> None:
    """Raise if files of different names give one series (``a b.csv`` and
    ``a_b.csv``, or one name in two folders): they would be one meter. The
    names come from the listing that the driver has anyway, not from the rows."""
    seen: dict[str, str] = {}
    for f in raw.inputFiles():
        n = series_name_from_file(unquote(f.rsplit("/", 1)[-1]))
        if seen.setdefault(n, f) != f:
            raise ValueError(f"two files are named like meter {n!r}: {seen[n]} and {f}; rename one or read by folder")


def read_counts(spark: SparkSession, paths: str | Sequence[str], fmt: str = "csv", *, header: bool = True, sep: str = ",",
                name_from: str = "file", period: str | None = None, cfg: LoadConfig = DEFAULT, decimal_comma: bool = False,
                day_first: bool = False, formats: Sequence[str] | None = None) -> DataFrame:
    """What :func:`read_readings` finds in each file: ``series, file, lines,
    readings, missing, rejects``. One aggregation by file (partial sums per
    task), and no line raises."""
    raw, first, second, series, stamped = _two_columns(spark, paths, fmt, header, sep, name_from, period, cfg)
    ts = first.cast("timestamp_ntz") if stamped else parse_datetime(first.cast("string"), day_first, formats)
    bad = _fault(raw, ts, second, decimal_comma).isNotNull()
    none = parse_energy(second, decimal_comma).isNull()
    rows = raw.select(series.alias(SERIES), F.col("_metadata.file_path").alias("file"), bad.alias("bad"), none.alias("none"))
    return rows.groupBy(SERIES, "file").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(~F.col("bad") & ~F.col("none")).alias("readings"),
        F.count_if(~F.col("bad") & F.col("none")).alias("missing"), F.count_if("bad").alias("rejects"))


#: Rows of one file of a meter.
METER_FILE_ROWS = 5_000_000


def write_meter_folders(readings: DataFrame, path: str, rows_per_file: int = METER_FILE_ROWS) -> None:
    """``series`` and more columns -> delimited files in ``series=<name>``
    folders (read with ``name_from="dir"``). Every meter's rows are counted
    first and dealt over ceil(rows / rows_per_file) salts, a task writing whole
    (meter, salt) groups: a small meter is one file, and no task writes a large
    meter alone."""
    spark = readings.sparkSession
    rest = [F.col(f"`{c}`") for c in readings.columns if c != SERIES]
    counts = readings.groupBy(SERIES).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).cast("int").alias("__files"))
    sized = readings.join(small_side(counts, readings.select(SERIES), 500_000).withColumnRenamed(SERIES, "__s"),
                          F.col(SERIES).eqNullSafe(F.col("__s")), "left").drop("__s")
    salted = sized.withColumn("__salt", F.pmod(F.xxhash64(*rest), F.col("__files"))).drop("__files")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted.repartition(parts, SERIES, "__salt").drop("__salt").sortWithinPartitions(SERIES).write.partitionBy(SERIES).option("header", True).csv(path)


def unpivot_quarters(wide: DataFrame, date_col: str = "Date_", id_cols: Sequence[str] = (SERIES,)) -> DataFrame:
    """Wide quarter-hour rows -> readings: ``Date_`` + (q - 1) x 15 minutes.
    Cells without a value stay as missing readings."""
    qcols = [c for c in wide.columns if c in QUARTERS]
    ids = [c for c in id_cols if c in wide.columns]
    w = wide.select(*ids, date_col, *[F.col(f"`{q}`").cast("double").alias(q) for q in qcols])
    long = w.unpivot([*ids, date_col], qcols, "day_quarter", "Energy")
    return long.select(*ids, _quarter_stamp(F.col(date_col).cast("string"), F.col("day_quarter")).alias("DateTime"), F.col("Energy"))


def _quarter_stamp(date: Column, quarter: Column) -> Column:
    """The stamp of a day's quarter: ``yyyyMMdd`` + (quarter - 1) x 15 minutes."""
    return F.timestamp_add("MINUTE", (quarter.cast("int") - 1) * 15, F.to_date(date, "yyyyMMdd").cast("timestamp_ntz"))


def read_wide_csv(spark: SparkSession, paths: str | Sequence[str], *, sep: str = ",", name_from: str = "file",
                  period: str | None = None, cfg: LoadConfig = DEFAULT, rejects: bool = False) -> DataFrame:
    """Wide quarter-hour files -> readings (series from the file name, or from
    the ``series=<name>`` folder). A line with missing or surplus fields, a
    date that is none and a cell that is no number raise; with ``rejects`` the
    call returns them instead: ``series, date, day_quarter, cell, reason,
    file``, the quarter and cell only where a cell is at fault."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = _lines(spark, WIDE_TEXT_SCHEMA, True, sep, paths)
    if name_from == "file":
        series = series_name_column(F.col("_metadata.file_name"), period, cfg.time_resolution)
        _require_own_names(raw)
    elif name_from == "dir":
        series = F.col(SERIES).cast("string")
    else:
        raise ValueError("name_from must be 'file' or 'dir'")
    day = F.try_to_timestamp(F.trim("Date_"), F.lit("yyyyMMdd"))
    row_fault = F.when(F.col(_LINE).isNotNull(), "missing or surplus fields").when(day.isNull(), "the date is none")
    rows = raw.select(series.alias(SERIES), F.trim("Date_").alias("Date_"), *[F.col(f"`{q}`") for q in QUARTERS], row_fault.alias("why"),
                      F.col("_metadata.file_path").alias("file"))
    if rejects:
        lines = rows.where(F.col("why").isNotNull()).select(SERIES, F.col("Date_").alias("date"), F.lit(None).cast("int").alias("day_quarter"),
                                                            F.lit(None).cast("string").alias("cell"), F.col("why").alias("reason"), "file")
        cells = rows.where(F.col("why").isNull()).unpivot([SERIES, "Date_", "file"], QUARTERS, "q", "cell").where(no_number(F.col("cell")))
        return lines.unionByName(cells.select(SERIES, F.col("Date_").alias("date"), F.col("q").cast("int").alias("day_quarter"), "cell",
                                              F.lit("the cell is no number").alias("reason"), "file"))
    # the texts are unpivoted, so that one expression reads all cells
    cell = F.col("Energy")
    why = F.coalesce(F.col("why"), F.when(no_number(cell), F.concat(F.lit("quarter "), F.col("day_quarter"), F.lit(": the cell is no number"))))
    said = F.concat(F.lit("meter "), F.col(SERIES), F.lit(", day "), F.coalesce("Date_", F.lit("without a date")), F.lit(", "), why)
    long = rows.unpivot([SERIES, "Date_", "why"], QUARTERS, "day_quarter", "Energy")
    return long.select(SERIES, _quarter_stamp(F.when(F.col("why").isNull(), F.col("Date_")), F.col("day_quarter")).alias("DateTime"),
                       _or_raise(parse_energy(cell), why, said).alias("Energy"))


def pivot_quarters(readings: DataFrame, date_col: str = "Date_") -> DataFrame:
    """Readings on a 15-minute grid -> the wide layout (inverse of
    :func:`unpivot_quarters`); the quarter list is given, so no distinct pass."""
    ts = F.col("DateTime")
    q = ((F.hour(ts) * 60 + F.minute(ts)) / 15).cast("int") + 1
    d = F.date_format(ts, "yyyyMMdd").cast("int")
    return (readings.select(SERIES, d.alias(date_col), q.alias("__q"), "Energy")
            .groupBy(SERIES, date_col).pivot("__q", list(range(1, 97))).agg(F.first("Energy"))
            .select(SERIES, date_col, *[F.col(str(i)).alias(str(i)) for i in range(1, 97)]))


def read_meter_files(spark: SparkSession, paths: str | Sequence[str], cfg: LoadConfig = DEFAULT,
                     fmt: str = "csv", period: str | None = None, **kw) -> DataFrame:
    """The configured input layout: the wide quarter-hour layout when
    ``cfg.custom_data_load`` is set, two-column files otherwise."""
    check_format(fmt)
    if cfg.custom_data_load:
        if fmt != "csv":
            raise NotImplementedError("the wide quarter-hour layout is read from delimited files")
        return read_wide_csv(spark, paths, period=period, cfg=cfg, **kw)
    return read_readings(spark, paths, fmt, period=period, cfg=cfg, **kw)
