"""Operator 5: near-duplicate classes by ProbMinHash.

A text is its set of five-word shingles, weighted 1 + ln(count). Each shingle
is a Poisson process whose rate is its weight: its arrivals fall on random
registers, a register keeps the earliest arrival, and a shingle stops as soon
as its next arrival is later than all registers. Two registers agree with the
probability Jaccard similarity of the two texts.

Registers are banded; texts that agree in a band share a bucket. Copies of a
text (same words) count as one content before that, so buckets hold different
texts only. Buckets of at most ``SMALL`` contents are compared in full. In a
larger one every member is compared with the bucket's centre, the member with
the largest buckets overall (the original of a family of edited copies);
links make components. For members outside their centre's component prefix
filtering finds the rest exactly: two texts at the threshold share a shingle
among the rarest ones that make up more than 1 - threshold of either's weight,
so the members of such buckets are joined by those. So no link that could join
two components goes unseen, without listing all pairs of a family. Candidates
whose registers agree too rarely for the threshold (by ``SLACK`` standard
deviations) are dropped; the rest is verified by the exact probability Jaccard
similarity of the texts. Classes are the components of the links.

Texts without a word are classes of their own. Texts of one to four words
have one shingle, the whole text. Null doc_ids and repeated rows stay, one
output row per input row; a class's id is its smallest doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, broadcast_below, fresh, prepare, staged, texts_of
from .textkernels import U, chunks, distinct_per_text, mix, shingles

SHINGLE, THRESHOLD, BANDS, BAND_ROWS = 5, 0.8, 30, 6
SMALL, SLACK = 12, 5.0
#: Counters of shingle frequencies (4 bytes each) that order the shingles for prefix filtering.
SLOTS = 1 << 20
#: Up to so many text keys (16 bytes) are broadcast to pick texts to verify.
MAX_KEYS = 500_000
_CHUNK = 1 << 20
_GOLD, _ODD = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9)


def weighted_shingles(texts: list[str], n: int = SHINGLE):
    v, first = shingles(texts, n)
    v, count, first = distinct_per_text(v, first)
    return v, 1.0 + np.log(count), first


def prob_minhash(values: np.ndarray, weights: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """Registers (texts x m) of the element that arrives first."""
    texts = len(first) - 1
    when, who = np.full(texts * m, np.inf), np.zeros(texts * m, np.uint64)
    owner = np.repeat(np.arange(texts), np.diff(first))
    limit = np.full(texts, np.inf)
    live, time, state, rate = owner, np.zeros(len(values)), values, weights
    value = values
    while len(live):
        state = mix(state + _GOLD)
        time = time - np.log(((state >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        keep = time < limit[live]
        live, time, state, rate, value = live[keep], time[keep], state[keep], rate[keep], value[keep]
        cell = live * m + (mix(state * _ODD) % U(m)).astype(np.int64)
        hit = np.flatnonzero(time < when[cell])
        hit = hit[np.argsort(-time[hit], kind="stable")]      # the earliest is written last and stays
        when[cell[hit]] = time[hit]
        who[cell[hit]] = value[hit]
        touched = np.unique(live[hit])
        limit[touched] = when.reshape(texts, m)[touched].max(axis=1)
    return who.reshape(texts, m)


def probability_jaccard(va, wa, vb, wb) -> float:
    """Exact similarity of two weighted sets given by ascending values."""
    both, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = wa[ia], wb[ib]
    ratio = x / y
    o = np.argsort(ratio, kind="stable")
    x, y, ratio = x[o], y[o], ratio[o]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    first = np.searchsorted(ratio, ratio, side="left")
    below_y = np.r_[0.0, np.cumsum(y)][first]
    above_x = x.sum() - np.r_[0.0, np.cumsum(x)][first]
    return float((1.0 / ((above_x + only_a) / x + (below_y + only_b) / y)).sum())


_SIGN = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("node", pa.binary()), ("registers", pa.binary()),
                   ("bands", pa.list_(pa.int64()))])


def _signatures(bands: int, band_rows: int, n: int):
    def run(batches):
        for b in batches:
            texts = texts_of(b.column(2))
            for i, j in chunks([len(t) for t in texts], _CHUNK):
                part = texts[i:j]
                raw, at = shingles(part, n)
                size = np.diff(at)
                v, count, first = distinct_per_text(raw, at)
                reg = prob_minhash(v, 1.0 + np.log(count), first, bands * band_rows)
                key = np.repeat(mix(np.arange(bands, dtype=np.uint64) + _GOLD)[None, :], j - i, axis=0)
                grid = reg.reshape(j - i, bands, band_rows)
                for r in range(band_rows):
                    key = mix(key ^ grid[:, :, r]) + _GOLD
                # the content: both sums run over the shingles in their order
                pos = np.arange(len(raw), dtype=np.uint64) - np.repeat(at[:-1], size).astype(np.uint64)
                sums = []
                for salt in (_GOLD, _ODD):
                    total = np.concatenate([[U(0)], np.cumsum(mix(raw ^ mix(pos * _ODD + salt)), dtype=np.uint64)])
                    sums.append(total[at[1:]] - total[at[:-1]])
                node = [x.tobytes() if n_ else None for x, n_ in zip(np.stack(sums, axis=1), size)]
                short = (reg & U(0xFF)).astype(np.uint8)      # unequal ones agree once in 256: the estimate errs upwards
                yield batch(_SIGN, b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), node,
                            [x.tobytes() for x in short], [k.view(np.int64).tolist() if n_ else None
                                                           for k, n_ in zip(key, size)])
    return run


def _agreeing(m: int):
    """Share of agreeing registers of each pair."""
    def run(batches):
        for b in batches:
            a = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, m)
            c = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, m)
            share = (a == c).mean(axis=1) if len(a) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(share)], names=["a", "b", "estimate"])
    return run


def _verified(threshold: float, n: int):
    def run(batches):
        for b in batches:
            left, right = texts_of(b.column(2)), texts_of(b.column(3))
            keep, sims = [], []
            for i, j in chunks([len(x) + len(y) for x, y in zip(left, right)], _CHUNK):
                v, w, at = weighted_shingles(left[i:j] + right[i:j], n)
                for k in range(j - i):
                    p, q = slice(at[k], at[k + 1]), slice(at[k + j - i], at[k + j - i + 1])
                    s = probability_jaccard(v[p], w[p], v[q], w[q])
                    if s >= threshold - 1e-9:
                        keep.append(i + k)
                        sims.append(s)
            t = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(t), b.column(1).take(t), pa.array(sims, pa.float64())],
                                             names=["a", "b", "similarity"])
    return run


def components(nodes: DataFrame, links: DataFrame, name: str = "components") -> DataFrame:
    """``nodes(node)``, ``links(a, b)`` -> ``(node, comp)``: the smallest node
    of each connected component. Labels spread to neighbours and jump along
    their labels' labels until nothing changes; every round is a written
    table, and one shuffle while the labels may be broadcast."""
    both = staged(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), f"{name}-links")
    labels = staged(both.select(F.col("a").alias("node")).distinct().withColumn("comp", F.col("node")), f"{name}-0")
    while True:
        known = broadcast_below(labels, MAX_KEYS)
        near = known.select(F.col("node").alias("n"), F.col("comp").alias("c"))
        spread = both.join(near, F.col("b") == F.col("n")).select(
            F.col("a").alias("node"), F.col("c").alias("comp"), F.lit(None).cast(labels.schema["comp"].dataType).alias("old"))
        low = labels.withColumn("old", F.col("comp")).unionByName(spread).groupBy("node").agg(
            F.min("comp").alias("comp"), F.max("old").alias("old"))
        jump = known.select(F.col("node").alias("j"), F.col("comp").alias("further"))
        new = staged(low.join(jump, F.col("comp") == F.col("j")).select("node", F.least("comp", "further").alias("comp"), "old"),
                     f"{name}-n")
        labels = new.select("node", "comp")
        if new.where("comp <> old").limit(1).count() == 0:
            break
    return nodes.join(broadcast_below(labels, MAX_KEYS), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, bands: int = BANDS,
                    band_rows: int = BAND_ROWS, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, text)`` -> (``doc_id, h, comp, class_id`` one row per
    input row, the verified links between contents). ``h``: xxhash64 of the
    text; ``comp``: the class's content key, null for texts without a word."""
    prepare(docs.sparkSession)
    m = bands * band_rows
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    signed = staged(docs.select("doc_id", "h", "text").mapInArrow(
        _signatures(bands, band_rows, n), "doc_id long, h long, node binary, registers binary, bands array<long>"), "signed")
    contents = staged(signed.where("node IS NOT NULL").groupBy("node").agg(
        F.min(F.struct("doc_id", "h")).alias("one"), F.first("registers").alias("registers"),
        F.first("bands").alias("bands"), F.min("doc_id").alias("low_id")), "contents")

    rows = contents.select("node", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = rows.join(sizes, "bucket")
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    members = staged(members.join(weight, "node"), "members")
    large = members.where(F.col("size") > small).select("bucket", "node", "weight")
    few = members.where(F.col("size") <= small).select("bucket", "node")

    def pairs_of(x: DataFrame) -> DataFrame:
        return x.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    centres = staged(large.groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("c"))
                     .select("bucket", F.col("c.node").alias("centre")), "centres")
    few_pairs = few.withColumnRenamed("node", "a").join(few.withColumnRenamed("node", "b"), "bucket").where("a < b")
    star = large.join(centres, "bucket").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    links = _links(docs, contents, pairs_of(few_pairs.select("a", "b").unionByName(star)), threshold, m, n)
    comps = staged(components(contents.select("node"), links), "comps")

    main = centres.join(comps.select(F.col("node").alias("centre"), F.col("comp").alias("main")), "centre").select("bucket", "main")
    labelled = staged(large.join(comps, "node").join(main, "bucket").select("bucket", "node", "comp", "main"), "labelled")
    open_buckets = staged(labelled.where("comp <> main").select("bucket").distinct(), "open")
    if open_buckets.limit(1).count():
        inside = staged(labelled.join(open_buckets, "bucket").groupBy("node", "comp").agg(
            F.max(F.col("comp") != F.col("main")).alias("outside")), "open-members")
        more = _links(docs, contents, pairs_of(_prefix_pairs(docs, contents, inside, threshold, n)), threshold, m, n)
        if more.limit(1).count():       # the components that they join
            links = links.unionByName(more)
            ends = [comps.select(F.col("node").alias(x), F.col("comp").alias(f"comp_{x}")) for x in "ab"]
            across = more.join(ends[0], "a").join(ends[1], "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
            whole = components(comps.select(F.col("comp").alias("node")).distinct(), across, "merged") \
                .select(F.col("node").alias("part"), F.col("comp").alias("whole"))
            comps = staged(comps.join(whole, F.col("comp") == F.col("part")).select("node", F.col("whole").alias("comp")), "comps-merged")
    ids = contents.select("node", "low_id").join(comps, "node")
    by_class = ids.groupBy("comp").agg(F.min("low_id").alias("class_id"))
    of_node = ids.join(by_class, "comp").select("node", "comp", "class_id")
    rows = signed.select("doc_id", "h", "node").join(of_node, "node", "left")
    alone = F.when(F.col("node").isNull(), F.col("doc_id"))
    return rows.select("doc_id", "h", "comp", F.coalesce("class_id", alone).alias("class_id")), links


def _texts(docs: DataFrame, contents: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes(node)`` -> ``(node, text)``."""
    keys = contents.select("node", F.col("one.doc_id").alias("k_id"), F.col("one.h").alias("k_h")).join(nodes, "node")
    keys = broadcast_below(keys, MAX_KEYS)
    return staged(docs.join(keys, docs.doc_id.eqNullSafe(keys.k_id) & (docs.h == keys.k_h)).select("node", "text")
                  .dropDuplicates(["node"]), "texts")


def _slot(v: np.ndarray) -> np.ndarray:
    return (mix(v ^ _GOLD) % U(SLOTS)).astype(np.int64)


def _slot_counts(n: int):
    def run(batches):
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            texts = texts_of(b.column(0))
            for i, j in chunks([len(t) for t in texts], _CHUNK):
                total += np.bincount(_slot(weighted_shingles(texts[i:j], n)[0]), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])
    return run


def _prefixes(counts, threshold: float, n: int):
    """The shingles of each text's prefix that occur in another text too (a
    slot that was hit once holds a shingle of one text)."""
    def run(batches):
        for b in batches:
            texts, own, out, sizes = texts_of(b.column(1)), [], [], [[], [], []]
            for i, j in chunks([len(t) for t in texts], _CHUNK):
                v, w, at = weighted_shingles(texts[i:j], n)
                c = counts.value[_slot(v)]
                owner = np.repeat(np.arange(j - i), np.diff(at))
                o = np.lexsort((v, c, owner))
                before = np.cumsum(w[o]) - w[o]
                before = before - before[at[:-1]][owner]           # each text's weight before the shingle
                total = np.add.reduceat(w, at[:-1])[owner] if len(w) else w
                hit = (before <= (1 - threshold) * total + 1e-6) & (c[o] > 1)
                out.append(v[o][hit])
                single = np.diff(at).astype(np.float64)[owner]
                for column, x in zip(sizes, (before, total, total - single)):
                    column.append(x[hit])
                own.append(owner[hit] + i)
            t = pa.array(np.concatenate(own) if own else [], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(t), b.column(2).take(t), b.column(3).take(t),
                                              pa.array(np.concatenate(out).view(np.int64) if out else [], pa.int64()),
                                              *[pa.array(np.concatenate(x) if x else [], pa.float64()) for x in sizes]],
                                             names=["node", "comp", "outside", "shingle", "u", "w", "e"])
    return run


def _prefix_pairs(docs: DataFrame, contents: DataFrame, members: DataFrame, threshold: float, n: int) -> DataFrame:
    """Pairs of an outside member and a member of another component that can
    reach the threshold. If weights X of W and Y of V of two texts lie on
    shingles that they don't have in common, their similarity is at most
    1 / (1 + X / (W - X) + Y / (V - Y)): each common shingle's term is at most
    x*y / (y + Y*x) of its shares x and y of its texts, which is concave. At
    their rarest common shingle, X and Y are at least the weights that come
    before it (``u``); and as their common shingles weigh 1 or more on either
    side, X - Y differs from W - V by the weights above 1 (``e``) at most."""
    texts = _texts(docs, contents, members.select("node"))
    got = texts.select("text").mapInArrow(_slot_counts(n), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.uint32)                            # SLOTS numbers, whatever the input
    counts[got["slot"].to_numpy()] = np.minimum(got["n"].to_numpy(), 2**32 - 1)
    rows = staged(members.join(texts, "node").select("node", "text", "comp", "outside").mapInArrow(
        _prefixes(docs.sparkSession.sparkContext.broadcast(counts), threshold, n),
        "node binary, comp binary, outside boolean, shingle long, u double, w double, e double"), "prefixes")
    x = rows.where("outside").select(F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("comp", "shingle", "u", "w", "e")])
    y = rows.select(F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("comp", "shingle", "u", "w", "e")])
    c = F.col
    only_a = F.greatest(c("u_a"), c("u_b") + c("w_a") - c("w_b") - c("e_a") - c("e_b"))
    only_b = F.greatest(c("u_b"), c("u_a") + c("w_b") - c("w_a") - c("e_a") - c("e_b"))
    near = (only_a < c("w_a")) & (only_b < c("w_b")) & (
        F.try_divide(only_a, c("w_a") - only_a) + F.try_divide(only_b, c("w_b") - only_b) <= 1 / threshold - 1 + 1e-6)
    return x.join(y, (c("shingle_a") == c("shingle_b")) & (c("comp_a") != c("comp_b")) & near).select("a", "b")


def _links(docs: DataFrame, contents: DataFrame, pairs: DataFrame, threshold: float, m: int, n: int) -> DataFrame:
    """The pairs whose texts reach the threshold."""
    c = contents.select("node", "registers")
    left = c.select(F.col("node").alias("a"), F.col("registers").alias("ra"))
    right = c.select(F.col("node").alias("b"), F.col("registers").alias("rb"))
    least = threshold - SLACK * (threshold * (1 - threshold) / m) ** 0.5
    likely = staged(pairs.join(left, "a").join(right, "b").select("a", "b", "ra", "rb").mapInArrow(
        _agreeing(m), "a binary, b binary, estimate double").where(F.col("estimate") >= least), "likely")
    keys = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
    texts = _texts(docs, contents, keys)
    return staged(likely.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
                  .join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
                  .select("a", "b", "ta", "tb").mapInArrow(_verified(threshold, n), "a binary, b binary, similarity double"),
                  "links")


def classes(docs: DataFrame, **kw) -> DataFrame:
    """``(doc_id, class_id)``, one row per input row."""
    return near_duplicates(docs, **kw)[0].select("doc_id", "class_id")


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` without near-duplicates: of each class the row with the
    smallest doc_id stays (rows without an id come last; then the smallest
    fingerprint). Rows without a word stay."""
    rows, _ = near_duplicates(docs.select("doc_id", "text"), **kw)
    rows = staged(rows.where("comp IS NOT NULL"), "class-rows")
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("k"))
    d, h, i, k = fresh(docs, "__doc", "__h", "__id", "__k")
    drop = staged(rows.join(first, "comp").where(~(F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("h") == F.col("k.h"))))
                  .select(F.col("doc_id").alias(i), F.col("h").alias(k)).distinct(), "dropped")
    same = F.col(d).eqNullSafe(F.col(i)) & (F.col(h) == F.col(k))
    keyed = docs.withColumn(d, F.col("doc_id").cast("long")).withColumn(h, F.xxhash64("text"))
    kept = keyed.join(broadcast_below(drop, MAX_KEYS), same, "left_anti")
    twice = staged(rows.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").select(
        F.col("doc_id").alias(i), F.col("h").alias(k)), "repeated")
    if twice.limit(1).count():      # a kept text whose very row repeats
        once = kept.join(twice, same, "left_semi").dropDuplicates([d, h])
        kept = kept.join(twice, same, "left_anti").unionByName(once)
    return kept.drop(d, h)
