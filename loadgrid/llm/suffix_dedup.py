"""Operator 1: removal of repeated byte strings by counts of anchored fingerprints.

A byte goes if it lies in a ``threshold``-byte string of its document that
also starts anywhere else in the corpus (same document included).

Sorting a rank for every byte position would move many times the corpus. Here
one anchor stands for a run of neighbouring start positions: the position of
the smallest ``seed``-byte fingerprint inside a start's threshold-byte window.
Equal windows have their anchor at the same place, so an anchor rank groups
all starts that can be equal. In place of prefix doubling, four counts at fixed
widths follow, to both sides of the anchor:

* rank 0: a fingerprint of the ``seed`` bytes at the anchor; anchors with a rank of their own
  are done, none of their starts repeats;
* rank 1: (rank 0, all bytes that the run's windows cover); if two runs share
  it, every start of both repeats, and they are done;
* rank 2: for what is left, blocks of ``BLOCK`` starts, ranked by (rank 0, the
  bytes that all windows of the block share) and by (rank 0, all bytes they
  cover): a block whose shared bytes are unique is done, one whose covered
  bytes are not is done as well;
* rank 3: single starts of the remaining blocks, by their whole window.

Rank 0 only groups; all later ranks are 128-bit BLAKE2 digests of the bytes
themselves, so texts made to share a fingerprint are told apart. Each rank is
counted by a Spark aggregation and joined back; unique ones leave before the next, so only a few percent of the positions
reach the last. Rank 1 keeps one run per distinct content for the later
ranks: a thousand copies cost as much as two.

Documents are told apart by (doc_id, fingerprint of the text); repeated rows
count as separate documents, whose equal ranges are kept once. Null or short texts lose nothing; null doc_ids
and other columns pass through untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, broadcast_below, lean, longs, prepare, staged
from .textkernels import U, chunks, digests, prefix_sums, sliding_min, span_hash

THRESHOLD, SEED, BLOCK = 400, 128, 16
#: Up to so many document keys (16 bytes each) are broadcast to pick the texts of a rank.
MAX_KEYS = 500_000
_TILE = 1 << 18

_ANCHOR = pa.schema([("rank0", pa.int64()), ("doc_id", pa.int64()), ("doc_h", pa.int64()), ("anchor", pa.int64()),
                     ("d_hi", pa.int32()), ("d_lo", pa.int32()), ("rank1", pa.int64()), ("rank1b", pa.int64())])
_NODE = pa.schema([("rank0", pa.int64()), ("doc_id", pa.int64()), ("doc_h", pa.int64()), ("anchor", pa.int64()),
                   ("d_lo", pa.int32()), ("d_hi", pa.int32()), ("copies", pa.int32()), ("core", pa.binary()),
                   ("span", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _anchors_of(buf: np.ndarray, ends: np.ndarray, threshold: int, seed: int):
    """Runs of starts that share an anchor: first start, last start, anchor,
    document, fingerprint of the seed and digest of all that the run covers."""
    n = len(buf)
    if n < threshold:
        return None
    h = prefix_sums(buf)
    at = np.arange(n - seed + 1)
    grams = span_hash(h, at, at + seed)
    key = (grams >> U(28) << U(28)) | at.astype(np.uint64)
    anchor = (sliding_min(key, threshold - seed + 1) & U(2**28 - 1)).astype(np.int64)
    doc = np.searchsorted(ends, np.arange(len(anchor)), side="right")
    start = np.flatnonzero(np.arange(len(anchor)) + threshold <= ends[doc])
    if not len(start):
        return None
    a, d = anchor[start], doc[start]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1) | (d[1:] != d[:-1])])
    lo, hi = start[new], start[np.r_[new[1:] - 1, len(start) - 1]]
    return lo, hi, a[new], d[new], grams[a[new]], digests(buf, lo, hi + threshold)


def _anchor_rows(threshold: int, seed: int):
    def run(batches):
        for b in batches:
            ids, hs = b.column(0), b.column(1).to_pylist()
            raw = [x or b"" for x in b.column(2).to_pylist()]
            pieces = []      # (row, offset, bytes): long texts in overlapping tiles
            for r, x in enumerate(raw):
                for o in range(0, max(len(x) - threshold + 1, 0), _TILE):
                    pieces.append((r, o, x[o: o + _TILE + threshold - 1]))
            for i, j in chunks([len(p[2]) for p in pieces], _TILE):
                part = pieces[i:j]
                ends = np.cumsum([len(p[2]) for p in part])
                got = _anchors_of(np.frombuffer(b"".join(p[2] for p in part), np.uint8), ends, threshold, seed)
                if got is None:
                    continue
                lo, hi, a, d, gram, span = got
                row = np.array([p[0] for p in part])[d]
                shift = np.array([p[1] - (e - len(p[2])) for p, e in zip(part, ends)])[d]
                yield batch(_ANCHOR, longs(gram), ids.take(pa.array(row)), np.array(hs, np.int64)[row],
                            a + shift, (a - lo).astype(np.int32), (a - hi).astype(np.int32), longs(span[:, 0]), longs(span[:, 1]))
    return run


def _tagged(digest: np.ndarray, tag: np.ndarray) -> list[bytes]:
    """Digests as 16 bytes that also differ by ``tag``."""
    out = digest.copy()
    out[:, 0] ^= tag
    raw = out.tobytes()
    return [raw[k: k + 16] for k in range(0, len(raw), 16)]


def _node_rows(threshold: int, block: int):
    """Blocks of starts of the listed runs with the digests of the bytes that
    all their windows share and of all that they cover. ``span`` is null where
    the run or the document does not hold the whole block."""
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                text, doc_id, doc_h, runs = (c[r].as_py() for c in b.columns[2:3] + b.columns[0:2] + b.columns[3:4])
                anchor = np.array([r["anchor"] for r in runs], np.int64)
                rank0 = np.array([r["rank0"] for r in runs], np.int64)
                copies = np.array([r["copies"] for r in runs], np.int32)
                d_lo = np.array([r["d_lo"] for r in runs], np.int64)
                d_hi = np.array([r["d_hi"] for r in runs], np.int64)
                buf = np.frombuffer(text, np.uint8)
                first = d_lo // block
                k = d_hi // block - first + 1
                own = np.repeat(np.arange(len(runs)), k)
                b0 = (np.arange(len(own)) - np.repeat(np.cumsum(k) - k, k) + first[own]) * block
                lo, hi = np.maximum(b0, d_lo[own]), np.minimum(b0 + block - 1, d_hi[own])
                a = anchor[own]
                whole = (lo == b0) & (hi == b0 + block - 1)
                tag = (b0 + 1).astype(np.uint64) * U(0x9E3779B97F4A7C15)
                for i in range(0, len(own), 1 << 14):
                    s = slice(i, i + (1 << 14))
                    core = _tagged(digests(buf, a[s] - b0[s], a[s] - (b0[s] + block - 1) + threshold), tag[s])
                    if block == 1:
                        span = pa.nulls(len(core), pa.binary())         # a start alone is its own core
                    else:
                        span = pa.array(_tagged(digests(buf, a[s] - hi[s], a[s] - lo[s] + threshold), tag[s]), pa.binary(), mask=~whole[s])
                    yield batch(_NODE, rank0[own[s]], [doc_id] * len(own[s]), [doc_h] * len(own[s]), a[s],
                                lo[s].astype(np.int32), hi[s].astype(np.int32), copies[own[s]], core, span)
    return run


def _with_text(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """The texts of the documents that ``runs`` name, with their runs."""
    per_doc = runs.distinct().groupBy("doc_id", "doc_h").agg(F.collect_list(
        F.struct("rank0", "anchor", "d_lo", "d_hi", "copies")).alias("runs"))
    keys = broadcast_below(runs.select(F.col("doc_id").alias("k_id"), F.col("doc_h").alias("k_h")).distinct(), MAX_KEYS)
    some = docs.join(keys, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("doc_h") == F.col("k_h")), "left_semi") \
        .dropDuplicates(["doc_id", "doc_h"])
    p = per_doc.select(F.col("doc_id").alias("k_id"), F.col("doc_h").alias("k_h"), "runs")
    return some.join(p, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("doc_h") == F.col("k_h"))) \
        .select("doc_id", "doc_h", "data", "runs")


def repeated_starts(docs: DataFrame, threshold: int = THRESHOLD, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """``docs(doc_id, doc_h, data binary)`` -> ``(doc_id, doc_h, lo, hi)``:
    ranges of starts whose threshold-byte string starts elsewhere too."""
    anchors = staged(docs.select("doc_id", "doc_h", "data").mapInArrow(lean(_anchor_rows(threshold, seed)), _ddl(_ANCHOR)),
                     "anchors")
    # counts are written before they are joined back: a join of two scans can be split at hot ranks
    shared = staged(anchors.groupBy("rank0").agg(F.count("*").alias("n")).where("n > 1").select("rank0"), "rank0-shared")
    left = staged(anchors.join(shared, "rank0"), "rank0")

    key = ["rank0", "d_lo", "d_hi", "rank1", "rank1b"]
    classes = staged(left.groupBy(*key).agg(F.count("*").alias("n"), F.min(
        F.struct("doc_id", "doc_h", "anchor")).alias("one")), "rank1")
    whole = left.join(classes.where("n > 1").select(*key), key) \
        .select("doc_id", "doc_h", (F.col("anchor") - F.col("d_hi")).alias("lo"),
                (F.col("anchor") - F.col("d_lo")).alias("hi"))

    unsure = staged(classes.groupBy("rank0").agg(F.min("n").alias("m"), F.count("*").alias("k")).where("m = 1 AND k > 1")
                    .select("rank0"), "rank1-unsure")
    runs = staged(classes.join(unsure, "rank0").select(
        "rank0", "one.doc_id", "one.doc_h", "one.anchor", "d_lo", "d_hi", F.least("n", F.lit(2)).cast("int").alias("copies")),
        "runs")
    nodes = staged(_with_text(docs, runs).mapInArrow(lean(_node_rows(threshold, block)), _ddl(_NODE)), "rank2")
    cores = staged(nodes.groupBy("rank0", "core").agg(F.sum("copies").alias("n_core")).where("n_core > 1"), "rank2-cores")
    spans = staged(nodes.where("span IS NOT NULL").groupBy("rank0", "span").agg(F.sum("copies").alias("n_span"))
                   .where("n_span > 1"), "rank2-spans")
    left = staged(nodes.where("copies = 1").join(cores, ["rank0", "core"]).join(spans, ["rank0", "span"], "left")
                  .withColumn("done", F.coalesce("n_span", F.lit(0)) > 1).drop("span", "n_core", "n_span"), "rank2-left")
    blocks = left.where("done")

    # single starts of the open blocks, and of every block that shares their common bytes
    open_keys = staged(left.where("NOT done").select("rank0", "core").distinct(), "rank2-open")
    open_runs = staged(nodes.join(open_keys, ["rank0", "core"], "left_semi").drop("core", "span"), "rank3-runs")
    singles = staged(_with_text(docs, open_runs).mapInArrow(lean(_node_rows(threshold, 1)), _ddl(_NODE)), "rank3")
    twice = staged(singles.groupBy("rank0", "core").agg(F.sum("copies").alias("n")).where("n > 1").select("rank0", "core"),
                   "rank3-shared")
    starts = singles.where("copies = 1").join(twice, ["rank0", "core"], "left_semi")

    as_range = [F.col("doc_id"), F.col("doc_h"), (F.col("anchor") - F.col("d_hi")).alias("lo"),
                (F.col("anchor") - F.col("d_lo")).alias("hi")]
    return whole.unionByName(blocks.select(*as_range)).unionByName(starts.select(*as_range))


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                   ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _remove(threshold: int, keep_text: bool):
    def run(batches):
        for b in batches:
            out = []
            for doc_id, data, starts in zip(*(c.to_pylist() for c in b.columns)):
                iv = np.array([(r["lo"], r["hi"] + threshold) for r in starts], np.int64)
                iv = iv[np.argsort(iv[:, 0], kind="stable")]
                reach = np.maximum.accumulate(iv[:, 1])
                first = np.flatnonzero(np.r_[True, iv[1:, 0] > reach[:-1]])
                lo, hi = iv[first, 0], reach[np.r_[first[1:] - 1, len(iv) - 1]]
                kept = b"".join(data[x:y] for x, y in zip(np.r_[0, hi], np.r_[lo, len(data)]))
                out.append((doc_id, len(data), int((hi - lo).sum()), len(lo), hashlib.sha256(kept).hexdigest(),
                            kept if keep_text else None))
            if out:
                yield batch(_KEPT, *zip(*out))
    return run


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, keep_text: bool = True, seed: int = SEED,
                   block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: n_bytes, n_removed, n_spans
    (maximal removed runs), kept_sha256 and, if ``keep_text``, the kept bytes.
    Null texts count as empty; an empty table gives an empty result."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc_h"),
                       F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"))
    ranges = repeated_starts(docs.where(F.length("data") >= threshold), threshold, seed, block)
    per_doc = staged(ranges.distinct().groupBy(F.col("doc_id").alias("k_id"), F.col("doc_h").alias("k_h"))
                     .agg(F.collect_list(F.struct("lo", "hi")).alias("starts")), "starts")
    keys = broadcast_below(per_doc.select("k_id", "k_h"), MAX_KEYS)
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("doc_h") == F.col("k_h"))
    cut = docs.join(keys, same, "left_semi").join(per_doc, same).select("doc_id", "data", "starts") \
        .mapInArrow(lean(_remove(threshold, keep_text)), _ddl(_KEPT))
    rest = docs.join(keys, same, "left_anti").select(
        "doc_id", F.length("data").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2("data", 256).alias("kept_sha256"),
        (F.col("data") if keep_text else F.lit(None).cast("binary")).alias("kept"))
    return cut.unionByName(rest)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT r, unnest(range(0, length(x) // 2 - 399)) AS s, x FROM d WHERE length(x) >= 800),
w AS (SELECT r, s, md5_number(substr(x, 2 * s + 1, 800)) AS h FROM p),
t AS (SELECT r, s FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT r, s, s - 400 > coalesce(lag(s) OVER (PARTITION BY r ORDER BY s), -401) AS new FROM t),
i AS (SELECT r, s, count_if(new) OVER (PARTITION BY r ORDER BY s) AS k FROM g),
c AS (SELECT r, k, min(s) AS lo, max(s) + 400 AS hi FROM i GROUP BY r, k),
e AS (SELECT r, lo, hi, lead(lo) OVER (PARTITION BY r ORDER BY lo) AS nxt, row_number() OVER (PARTITION BY r ORDER BY lo) AS n FROM c),
j AS (SELECT e.r, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans,
             min_by(substr(x, 1, 2 * lo), n) || string_agg(substr(x, 2 * hi + 1, 2 * (coalesce(nxt, length(x) // 2) - hi)), '' ORDER BY n) AS kept
      FROM e JOIN d ON e.r = d.r GROUP BY e.r)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN j ON d.r = j.r
"""
