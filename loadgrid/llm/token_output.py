"""Operator 6: packed token-id matrices.

Each task tokenizes its documents, splits those longer than a row losslessly
into pieces (``tokens.cuts``), and packs blocks of at most ``block_tokens``
ids by best-fit decreasing; a segment tree over the free places of the open
rows finds the tightest one in log(row length) steps. Blocks never leave
their task, so ids are not shuffled and memory is bounded by a block plus one
document. One output row is one matrix row: its ids in little-endian binary,
padded to the full length, the cumulative segment lengths (first 0, last the
number of ids before padding), the position at which each id restarts from 0,
and the documents and starts of its segments, from which every document can
be put together again.

Null texts count as empty; an empty text is its end id alone; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, texts_of
from .tokens import END_ID, MAX_TOKENS, RANKS, TOKENIZER, Ids, cuts

BLOCK_TOKENS, PAD_ID = 1 << 20, 0

DDL = ("sequence_id long, n_tokens int, ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, "
       "starts array<long>")
_SCHEMA = pa.schema([("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()),
                     ("position_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
                     ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])


class CapacityTree:
    """Counts of open rows by free places; ``tightest(s)`` is the smallest
    number of free places that still holds ``s``."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, free: int, by: int) -> None:
        i = free + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, s: int) -> int | None:
        i = s + self.size
        if self.count[i]:
            return s
        while i > 1:                       # up to a right sibling with rows, then down its left edge
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def pack_rows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indexes of the sizes in each row, by best-fit decreasing."""
    tree, rows, open_rows = CapacityTree(capacity), [], [[] for _ in range(capacity + 1)]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        free = tree.tightest(sizes[i])
        if free is None:
            free, row = capacity, len(rows)
            rows.append([])
        else:
            row = open_rows[free].pop()
            tree.add(free, -1)
        rows[row].append(i)
        left = free - sizes[i]
        if left:
            open_rows[left].append(row)
            tree.add(left, 1)
    return rows


def _emit(block, capacity: int, dtype: str, pad_id: int, base: int):
    sizes = [len(p[2]) for p in block]
    rows = pack_rows(sizes, capacity)
    ids = np.full((len(rows), capacity), pad_id, np.dtype(dtype))
    pos = np.zeros((len(rows), capacity), np.dtype("<u2" if capacity <= 65536 else "<u4"))
    cu, docs, starts = [], [], []
    for r, members in enumerate(rows):
        at = [0]
        for i in members:
            n = sizes[i]
            ids[r, at[-1]: at[-1] + n] = block[i][2]
            pos[r, at[-1]: at[-1] + n] = np.arange(n)
            at.append(at[-1] + n)
        cu.append(at)
        docs.append([block[i][0] for i in members])
        starts.append([block[i][1] for i in members])
    return pa.RecordBatch.from_arrays([
        pa.array(base + np.arange(len(rows)), pa.int64()), pa.array([c[-1] for c in cu], pa.int32()),
        pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.tobytes() for x in pos], pa.binary()),
        pa.array(cu, _SCHEMA[4].type), pa.array(docs, _SCHEMA[5].type), pa.array(starts, _SCHEMA[6].type)], schema=_SCHEMA)


def _rows(tokenizer, ranks, end_id, capacity, block_tokens, dtype, pad_id):
    def run(batches):
        from pyspark import TaskContext

        encode, block, total, made = Ids(tokenizer, ranks), [], 0, TaskContext.get().partitionId() << 33
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                ids = np.array(encode(text) + [end_id], np.dtype(dtype))
                for s, n in cuts(len(ids), capacity):
                    block.append((doc_id, s, ids[s: s + n]))
                total += len(ids)
                if total >= block_tokens:
                    yield (out := _emit(block, capacity, dtype, pad_id, made))
                    made, block, total = made + out.num_rows, [], 0
        if block:
            yield _emit(block, capacity, dtype, pad_id, made)
    return run


def packed_matrices(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, end_id: int = END_ID,
                    capacity: int = MAX_TOKENS, block_tokens: int = BLOCK_TOKENS, dtype: str = "<u2",
                    pad_id: int = PAD_ID) -> DataFrame:
    """One row per matrix row. ``dtype``: the ids' type, ``<u2`` for
    vocabularies below 65,536, else ``<u4``."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _rows(tokenizer, ranks, end_id, capacity, block_tokens, dtype, pad_id), DDL)


def write_packed(docs: DataFrame, path: str, **kw) -> None:
    """Write the matrices as Parquet, one file per task."""
    packed_matrices(docs, **kw).write.parquet(path)
