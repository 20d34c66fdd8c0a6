"""Results that must be exact whatever the texts: strings made to share
fingerprints, rows repeated many times, ids that repeat with other vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loadgrid.llm import exact_topk, suffix_dedup, textkernels as K


def _swapped(bits: int) -> tuple[str, str]:
    s = "a"
    for _ in range(bits):
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_texts_with_equal_fingerprints_lose_nothing(spark):
    one, two = _swapped(8)                       # polynomial sums modulo 2**64 can't tell these apart
    rnd = np.random.default_rng(1)
    seed = "".join(rnd.choice(list("cdefgh"), 128))
    rows = [(1, one + seed + two), (2, two + seed + one)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=False).collect()
    assert [(r["n_bytes"], r["n_removed"]) for r in out] == [(640, 0), (640, 0)]


def test_digests_tell_strings_apart():
    buf = np.frombuffer("".join(_swapped(8)).encode(), np.uint8)
    d = K.digests(buf, np.array([0, 256, 0]), np.array([256, 512, 256]))
    assert (d[0] == d[2]).all() and (d[0] != d[1]).any()


def test_repeated_rows_keep_few_ranges(spark):
    rnd = np.random.default_rng(2)
    text = "".join(rnd.choice(list("abcdefghij "), 2400))
    docs = spark.createDataFrame([(5, text)] * 400 + [(6, text[:300])], "doc_id long, text string")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("doc_h"), F.col("text").cast("binary").alias("data"))
    ranges = suffix_dedup.repeated_starts(keyed.where(F.length("data") >= 400)).distinct()
    assert ranges.count() <= 40
    out = suffix_dedup.remove_repeats(docs, keep_text=False).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(5, 2400, 2400, 1, 400), (6, 300, 0, 0, 1)]


def test_rows_that_share_an_id_are_all_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (None, [3.0, 0.0]), (3, None), (4, [float("nan"), 1.0]),
            (50, [0.25, 0.0]), (50, [0.5, 0.5]), (7, [1.0])]
    v = exact_topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = [tuple(r) for r in exact_topk.top_k(v, F.col("vec_id") % 50 == 0, k=3, shard_rows=3).collect()]
    assert sorted((r[1:] for r in got if r[0] == 0), key=lambda r: r[0]) == [(1, None, 3 * 256 * 256), (2, 1, 2 * 256 * 256), (3, 2, 256 * 256)]
    # two rows of id 50: each is a query, and a candidate of the other
    assert len([r for r in got if r[0] == 50]) == 6


def test_ranges_of_pairs_grow_with_the_corpus(spark):
    from loadgrid.llm import lm_scoring as L
    assert [L.range_bits(n, 1000) for n in (0, 1, 1000, 1001, 10**6)] == [1, 1, 1, 2, 10]
    rnd = np.random.default_rng(9)
    texts = [" ".join(rnd.choice(["a", "b", "cc", "d"], 30)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    yes, no = F.lit(True), F.lit(False)
    one = L.score(docs, no, yes).orderBy("doc_id").collect()
    many = L.score(docs, no, yes, block_bytes=300, range_bytes=64).orderBy("doc_id").collect()
    for x, y in zip(one, many):
        assert x["base_score"] == y["base_score"] and abs(x["score"] - y["score"]) < 1e-9


def test_words_of_blocks_are_packed_by_ranges(spark):
    import pyarrow as pa
    from loadgrid.llm import lm_scoring as L
    texts = [b" Foo  bar\t\x0b\x0c\r\nBAZ \xff\xc3", b"", b"   ", None, b"a\x1cb \x85C\xa0d \xc2\xa0 z", "É x".encode(), b"w" * 5000, None]
    for col in (pa.array(texts, pa.binary()), pa.array([b"q q", *texts, None], pa.binary()).slice(1, len(texts))):
        flat, size = L.words(col)
        want = [(t or b"").lower().split() for t in texts]
        assert flat.to_pylist() == [w for t in want for w in t] and size.tolist() == [len(t) for t in want]
    local, ids = L._numbered([L.words(pa.array(texts[:3], pa.binary())), L.words(pa.array(texts[3:], pa.binary()))])
    name = {i: w for w, i in local.items()}
    assert [[name[i] for i in x.tolist()] for x in ids] == [[*t, b""] for t in want]
    # rows follow blocks and ranges, not distinct words; the cut changes no score
    rnd = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{int(x) % 900}" for x in rnd.integers(0, 3000, 60))) for i in range(60)] + [(None, "w1 w2"), (70, None), (3, "w5"), (3, "w5")]
    docs, yes, no = spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True), F.lit(False)
    key = ("doc_id", "n_tokens", "score")
    one, many = (L.score(docs, no, yes, **k).orderBy(*key).collect() for k in ({}, {"block_bytes": 700, "word_range_bytes": 300}))
    for x, y in zip(one, many):
        assert x["doc_id"] == y["doc_id"] and x["base_score"] == y["base_score"] and abs(x["score"] - y["score"]) < 1e-9
    cut = pa.Table.from_batches(list(L._emit(7, local, ids, [(i, False, True) for i in range(len(ids))])))
    pairs = pa.Table.from_batches(list(L._count_slices(L._slices(1)(cut.drop_columns("slice").to_batches()))))
    table = pa.concat_tables([cut, pairs.drop_columns(["once", "twice"])], promote_options="default")
    dealt = L._dealt(2, 0, 0.5)(table.append_column("kind", pa.array([-1] * table.num_rows)))
    assert dealt.num_rows <= 4 < len(local)
    merged = [r for b in L._merge(dealt.sort_by("slice").to_batches()) for r in b.to_pylist()]
    got = {w: (c, m, t) for r in merged for w, c, m, t in zip(*(x.to_pylist() if isinstance(x, pa.Array) else x.tolist() for x in L._vocabulary(r["words"], r["data"])))}
    assert got == {r["word"]: (r["n"], r["m"], r["t"]) for r in L._word_rows(table).to_pylist()}


def test_blocks_are_worked_off_in_parts():
    import tracemalloc
    import pyarrow as pa
    from loadgrid.llm import lm_scoring as L, textkernels as K
    rng = np.random.default_rng(4)
    text = b" ".join(f"word{int(x)}{'x' * int(x % 23)}".encode() for x in rng.zipf(1.2, 900_000) % 300_000)
    local, ids = L._numbered([L.words(pa.array([text, b"", b"y" * 600_000 + b" word1", None], pa.binary()))])
    cut = pa.Table.from_batches(list(L._emit(0, local, ids, [(i, False, True) for i in range(len(ids))])))
    ids, packed = L._opened(cut["data"][0].as_py(), cut["docs"][0].as_py())[0], cut["words"][0].as_py()
    K._CACHE.pop("pow", None)
    tracemalloc.start()
    key, u, w, number = L._pairs(ids, packed)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * len(ids), peak / len(ids)
    # every token's pair, and one fingerprint for each pair, in order
    assert (w[number] == ids).all() and (u[number] == np.r_[0, ids[:-1]]).all()
    assert (key[1:] > key[:-1]).all() and len(key) == len(np.unique(u.astype(np.int64) << 32 | w))
    # a word has one fingerprint, whatever stands before it
    word = sorted(local)
    some = rng.choice(len(word), 300, replace=False)
    alone = np.array([K.span_hash(K.prefix_sums(np.frombuffer(word[i], np.uint8)), np.array([0]), np.array([len(word[i])]))[0] for i in some.tolist()])
    assert (L._word_keys(packed)[some] == alone).all()
