"""Operator 3: best-fit packing with certified bounds.

Documents are tokenized and cut (``tokens``); pieces of the full length are
sequences of their own. All other pieces are dealt evenly into partitions of
bounded size, each packed by best-fit decreasing. Dual-feasible functions give
a lower bound of the partition's number of sequences: where the packing meets
it, it is certified optimal and final. A partition with a gap keeps its
completely filled sequences and exchanges the pieces of all others with the
other partitions that have gaps; these are dealt anew and packed again, until
everything is certified or a round saves no sequence (a single partition has
nothing to exchange with). Every round after the first works only on what was
released. ``certificates`` gives each partition's bound, its sequences and
whether they are certified.

Null texts count as empty; an empty text is its end id alone. Rows that
repeat a doc_id are packed as documents of their own; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, prepare, staged, texts_of
from .tokens import END_ID, MAX_TOKENS, RANKS, TOKENIZER, Ids, cuts, little_endian

#: Pieces of one packing task.
PART_ROWS = 25_000
#: Parameters of the dual-feasible functions u(k).
DFF_K = range(1, 21)

_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64())])
PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(tokenizer: str, ranks: str | None, end_id: int, limit: int):
    def run(batches):
        encode = Ids(tokenizer, ranks)
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                raw = little_endian(encode(text) + [end_id])
                for k, (s, n) in enumerate(cuts(len(raw) // 4, limit)):
                    out.append((doc_id, k, s, n, zlib.crc32(raw[4 * s: 4 * (s + n)])))
            if out:
                yield batch(_PIECE, *zip(*out))
    return run


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, end_id: int = END_ID,
           limit: int = MAX_TOKENS) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _pieces(tokenizer, ranks, end_id, limit), PIECE_DDL)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Sequences that any packing of ``sizes`` needs: the best of the
    threshold functions (one for each smallest size regarded) and of u(k)."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)
    n_le = np.cumsum(count)
    s_le = np.cumsum(count * np.arange(capacity + 1))
    best = -(-int(s_le[-1]) // capacity)
    half = capacity // 2
    for low in range(1, half + 1):
        big = n_le[capacity] - n_le[capacity - low]
        mid, mid_sum = n_le[capacity - low] - n_le[half], s_le[capacity - low] - s_le[half]
        small_sum = s_le[half] - s_le[low - 1]
        best = max(best, int(big + mid + max(0, -(-int(small_sum - (mid * capacity - mid_sum)) // capacity))))
    x = np.arange(capacity + 1)
    for k in DFF_K:
        scaled = (k + 1) * x
        units = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)   # in 1 / (k * capacity)
        best = max(best, -(-int((count * units).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size, and the fill of each bin."""
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, room = 0, []          # bit r of free: a bin with r places left
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fit = free >> s
        if fit:
            r = s + (fit & -fit).bit_length() - 1
            b = open_bins[r].pop()
            if not open_bins[r]:
                free &= ~(1 << r)
        else:
            b, r = len(room), capacity
            room.append(capacity)
        bin_of[i], offset[i] = b, capacity - r
        room[b] = r - s
        if r > s:
            open_bins[r - s].append(b)
            free |= 1 << (r - s)
    return bin_of, offset, capacity - np.array(room, np.int64)


def _pack(capacity: int, seq_base: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        sizes = pdf["length"].to_numpy()
        bins, offset, fill = best_fit_decreasing(sizes, capacity)
        bound = lower_bound(sizes, capacity)
        sure = len(fill) <= bound
        pdf["sequence_id"] = seq_base + int(pdf["part"].iloc[0]) * (1 << 24) + bins
        pdf["offset"] = offset
        pdf["final"] = True if sure else fill[bins] == capacity
        pdf["certified"] = sure
        # completely filled sequences of a partition with a gap are their own bound
        pdf["bound"] = np.where(sure | ~pdf["final"], bound - (0 if sure else int((fill == capacity).sum())), 0)
        return pdf.drop(columns="part")
    return run


def pack(piece_rows: DataFrame, capacity: int = MAX_TOKENS, part_rows: int = PART_ROWS, rounds: int | None = None,
         proof: bool = False) -> DataFrame:
    """``piece_rows`` (any columns with doc_id, piece and length 1..capacity)
    plus sequence_id and offset; with ``proof`` also certified and bound of
    the partition, for ``certificates``. ``rounds``: None for no limit."""
    rows = staged(piece_rows, "pieces")
    schema = rows.schema.add("sequence_id", "long").add("offset", "long").add("final", "boolean") \
        .add("certified", "boolean").add("bound", "long")
    full = rows.where(F.col("length") == capacity).withColumn("sequence_id", -F.monotonically_increasing_id() - 1) \
        .withColumn("offset", F.lit(0).cast("long")).withColumn("certified", F.lit(True)).withColumn("bound", F.lit(1).cast("long"))
    todo, done, before, r = rows.where(F.col("length") < capacity), [full], None, 0
    while True:
        n = todo.count()
        if not n:
            break
        parts = math.ceil(n / part_rows)
        dealt = todo.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(r)), F.lit(parts)))
        packed = staged(dealt.repartition(parts, "part").groupBy("part").applyInPandas(
            _pack(capacity, r << 48), schema), f"round{r}")
        done.append(packed.where("final").drop("final"))
        open_rows = packed.where("NOT final")
        made, bins = packed.agg(F.count_distinct("sequence_id"), F.count_distinct(F.expr("IF(final, NULL, sequence_id)"))).first()
        r += 1
        if parts == 1 or not bins or (before is not None and made >= before) or r == rounds:
            done.append(open_rows.drop("final"))     # nothing left to exchange with, or the round saved nothing
            break
        todo, before = open_rows.drop("final", "certified", "bound", "sequence_id", "offset"), bins
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out if proof else out.drop("certified", "bound")


def certificates(packed: DataFrame) -> DataFrame:
    """Of ``pack(proof=True)``: part, sequences, bound and certified of each
    partition in what it kept. Sequences of one full piece are their own bound
    and stand in one row (part null)."""
    part = F.when(F.col("sequence_id") >= 0, F.shiftright("sequence_id", 24))
    return packed.groupBy(part.alias("part"), "sequence_id").agg(F.max("bound").alias("bound")) \
        .withColumn("own", F.col("part").isNull() | (F.col("bound") == 0)).groupBy("part").agg(
            F.count("*").alias("sequences"), (F.count_if("own") + F.coalesce(F.max(F.when(~F.col("own"), F.col("bound"))), F.lit(0)))
            .alias("bound")).withColumn("certified", F.col("sequences") <= F.col("bound"))


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, end_id: int = END_ID,
                   capacity: int = MAX_TOKENS) -> DataFrame:
    return pack(pieces(docs, tokenizer, ranks, end_id, capacity), capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
