"""Operator 10: benchmark items inside documents, by size-partitioned MinHash.

An item is contained in a document if at least ``threshold`` of its distinct
five-word shingles occur in it. Items are partitioned by size: class ``s``
holds items of s/2 to s shingles. For each class a document is seen through
windows of 2s shingles, every s shingles, so a passage of up to s shingles
lies in one window whole. In a partition sizes are known, so the containment
threshold t turns into a Jaccard similarity of at least
t*q / (2s + (1-t)*q) for an item of q distinct shingles. With single-value
bands, ``functions`` = ln(miss) / ln(1 - J) hash functions leave a passage
undetected with probability ``miss``; unrelated texts share no shingle, so
single-value bands still give few candidates.

Two bitmaps of fixed size travel to the tasks: of the items' shingles, and of
their MinHash values. A window without a bit of the first can't share a
MinHash with any item and is skipped; a MinHash without a bit of the second
can't join. Both only save work: a full bitmap would change no result. The
values that pass are joined to the items' values by Spark, and every
candidate pair is verified by the exact count of common shingles.

Items and documents of fewer than five words have no shingle and match
nothing, nor do null texts. Null ids and repeated rows stay: repeated document
rows share the document's matches, repeated item rows are one item.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_below, fresh, prepare, staged, texts_of
from .textkernels import U, chunks, distinct_per_text, mix, shingles

SHINGLE, THRESHOLD, MISS, BITS = 5, 0.8, 1e-6, 23
MAX_KEYS = 500_000
_CHUNK = 1 << 20


def _salt(f: int) -> np.uint64:
    return mix(np.array([f], np.uint64) + U(0x51ED270B))[0] | U(1)


def _bit(x: np.ndarray) -> np.ndarray:
    return (x >> U(64 - BITS)).astype(np.int64)


def _value_key(s: int, f: int, v: np.ndarray) -> np.ndarray:
    return mix(v ^ mix(np.array([s * 100_003 + f], np.uint64)))


_ITEM = pa.schema([("item_id", pa.int64()), ("item_h", pa.int64()), ("s", pa.int64()), ("q", pa.int64()),
                   ("shingles", pa.list_(pa.int64()))])


def _item_rows(n: int):
    def run(batches):
        for b in batches:
            v, at = shingles(texts_of(b.column(2)), n, short=False)
            d, _, first = distinct_per_text(v, at)
            rows = [i for i in range(b.num_rows) if at[i + 1] > at[i]]
            t = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(t), b.column(1).take(t),
                pa.array([1 << max(0, int(at[i + 1] - at[i] - 1).bit_length()) for i in rows], pa.int64()),
                pa.array([int(first[i + 1] - first[i]) for i in rows], pa.int64()),
                pa.array([d[first[i]: first[i + 1]].view(np.int64).tolist() for i in rows], _ITEM[4].type)], schema=_ITEM)
    return run


def _item_keys(functions: dict[int, int]):
    """The MinHash values of each item as keys of (class, function, value)."""
    def run(batches):
        for b in batches:
            out = []
            for i, h, s, sh in zip(*(c.to_pylist() for c in b.columns)):
                x = np.array(sh, np.int64).view(np.uint64)
                keys = [_value_key(s, f, (x * _salt(f)).min(keepdims=True))[0] for f in range(functions[s])]
                out += [(i, h, k) for k in np.array(keys, np.uint64).view(np.int64).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["item_id", "item_h", "key"])
    return run


_HIT = pa.schema([("doc_id", pa.int64()), ("doc_h", pa.int64()), ("keys", pa.list_(pa.int64())),
                  ("shingles", pa.list_(pa.int64()))])


def _bitmap(df: DataFrame, column: str) -> np.ndarray:
    """Bitmap of 2**BITS bits of the values' first bits; the distinct bits are
    all that reaches the driver, so the size is bounded whatever the input."""
    bits = df.select(F.shiftrightunsigned(column, 64 - BITS).alias("bit")).distinct().toArrow()["bit"].to_numpy()
    full = np.zeros(1 << BITS, bool)
    full[bits] = True
    return np.packbits(full)


def _hits(functions: dict[int, int], n: int, shingle_bits, key_bits):
    def run(batches):
        known, wanted = np.unpackbits(shingle_bits.value).view(bool), np.unpackbits(key_bits.value).view(bool)
        for b in batches:
            texts = texts_of(b.column(2))
            for i, j in chunks([len(t) for t in texts], _CHUNK):
                v, at = shingles(texts[i:j], n, short=False)
                pos = np.flatnonzero(known[_bit(v)])
                if not len(pos):
                    continue
                count = np.diff(at)
                found: dict[int, set] = {}
                for s, k in functions.items():
                    blocks = -(-count // s)
                    start = np.cumsum(blocks) - blocks                    # first block of each text
                    owner = np.repeat(np.arange(j - i), blocks)
                    begin = at[owner] + (np.arange(len(owner)) - start[owner]) * s
                    text = np.searchsorted(at, pos, side="right") - 1
                    block = start[text] + (pos - at[text]) // s
                    # windows are a block and the next one of the text
                    w = np.unique(np.concatenate([block, block - 1]))
                    w = w[(w >= 0)]
                    w = w[np.isin(w, block) | ((w + 1 < len(owner)) & (owner[np.minimum(w + 1, len(owner) - 1)] == owner[w]))]
                    lo, hi = begin[w], np.minimum(begin[w] + 2 * s, at[owner[w] + 1])
                    size = hi - lo
                    idx = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
                    x, cut = v[idx], np.cumsum(size) - size
                    for f in range(k):
                        keys = _value_key(s, f, np.minimum.reduceat(x * _salt(f), cut))
                        for m in np.flatnonzero(wanted[_bit(keys)]):
                            found.setdefault(int(owner[w[m]]), set()).add(int(keys[m].view(np.int64)))
                if found:
                    rows = sorted(found)
                    t = pa.array([i + r for r in rows], pa.int64())
                    text = np.searchsorted(at, pos, side="right") - 1
                    yield pa.RecordBatch.from_arrays([
                        b.column(0).take(t), b.column(1).take(t), pa.array([sorted(found[r]) for r in rows], _HIT[2].type),
                        pa.array([np.unique(v[pos[text == r]]).view(np.int64).tolist() for r in rows], _HIT[3].type)],
                        schema=_HIT)
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE,
                 miss: float = MISS) -> DataFrame:
    """``docs(doc_id, text)``, ``benchmark(item_id, text)`` -> every pair whose
    containment reaches the threshold: doc_id, item_id, n_common, n_shingles,
    containment and the keys doc_h, item_h (xxhash64 of the texts)."""
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc_h"), "text")
    items = staged(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item_h"), "text")
                   .distinct().mapInArrow(_item_rows(n), "item_id long, item_h long, s long, q long, shingles array<long>"),
                   "items")
    functions = {}
    for r in items.groupBy("s").agg(F.min("q").alias("q")).collect():      # one row per size class
        jaccard = threshold * r["q"] / (2 * r["s"] + (1 - threshold) * r["q"])
        functions[r["s"]] = math.ceil(math.log(miss) / math.log(1 - min(jaccard, 0.999)))
    keys = staged(items.select("item_id", "item_h", "s", "shingles").mapInArrow(
        _item_keys(functions), "item_id long, item_h long, key long"), "item-keys")
    bits = [spark.sparkContext.broadcast(_bitmap(*x)) for x in
            ((items.select(F.explode("shingles").alias("x")), "x"), (keys, "key"))]
    hits = staged(docs.mapInArrow(_hits(functions, n, *bits), "doc_id long, doc_h long, keys array<long>, shingles array<long>"),
                  "hits")
    pairs = hits.select("doc_id", "doc_h", F.explode("keys").alias("key")).join(keys, "key") \
        .select("doc_id", "doc_h", "item_id", "item_h").distinct()
    of_doc = hits.select(F.col("doc_id").alias("d"), F.col("doc_h").alias("dh"), F.col("shingles").alias("sd")) \
        .dropDuplicates(["d", "dh"])
    of_item = items.select(F.col("item_id").alias("i"), F.col("item_h").alias("ih"), "q", F.col("shingles").alias("si"))
    common = F.size(F.array_intersect("sd", "si"))
    return pairs.join(of_item, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_h") == F.col("ih"))) \
        .join(of_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("doc_h") == F.col("dh"))) \
        .select("doc_id", "item_id", common.cast("long").alias("n_common"), F.col("q").alias("n_shingles"),
                (common / F.col("q")).alias("containment"), "doc_h", "item_h") \
        .where(F.col("n_common") >= F.lit(threshold) * F.col("n_shingles") - F.lit(1e-9))


def clean(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """``docs`` without the rows that contain a benchmark item."""
    d, h, i, k = fresh(docs, "__doc", "__h", "__id", "__k")
    bad = staged(contaminated(docs.select("doc_id", "text"), benchmark, **kw).select(
        F.col("doc_id").alias(i), F.col("doc_h").alias(k)).distinct(), "contaminated")
    keyed = docs.withColumn(d, F.col("doc_id").cast("long")).withColumn(h, F.xxhash64("text"))
    return keyed.join(broadcast_below(bad, MAX_KEYS), F.col(d).eqNullSafe(F.col(i)) & (F.col(h) == F.col(k)), "left_anti").drop(d, h)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) >= 5),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b WHERE len(w) >= 5),
q AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS n_common FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_common, n_shingles, n_common / n_shingles AS containment
FROM c JOIN q USING (item_id) WHERE n_common >= 0.8 * n_shingles
"""
