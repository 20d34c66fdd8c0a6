"""Operator 12 on hand-made texts: base rules against plain Python, the model
against numpy, nulls, empty tables, repeated rows and clashing columns."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from loadgrid.llm import quality_rules as Q

DOCS = "doc_id long, text string, n_words int, score string, kept string, w string"


def _texts():
    rnd = random.Random(4)
    vocabulary = ["the", "a", "of", "and", "ünï", "x|y", "###", "<b>", "word", "tail."]
    out = [None, "", " \t\n", "one", "a b", "a b c", "a a a a", "x\x0by\x0cz", "l1\nl1\n\nl2\nl1\n \n ", "$%&|<>*#", "é e f"]
    out += [rnd.choice([" ", "\n", "  "]).join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 130))) for _ in range(60)]
    return out + [" ".join(f"w{i % 40000}" for i in range(60_000)), "same words here " * 5000]


def _base(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = list(zip(words, words[1:], words[2:]))
    twice = {g for g, n in Counter(grams).items() if n > 1}
    hit = set()
    for i, g in enumerate(grams):
        if g in twice:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed


def test_base_rules_against_plain_python(spark):
    texts = _texts()
    docs = spark.createDataFrame([(i, t, 1, "s", "k", "w") for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: tuple(r[c] for c in Q.BASE) for r in Q.with_base(docs).collect()}
    order = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Q.BASE == order
    for i, t in enumerate(texts):
        assert got[i] == _base(t), (i, (t or "")[:60])


def _features(text, order):
    k = re.findall(r"[0-9A-Za-z_\x80-\U0010FFFF]+|[!-/:-@\[-^`{-~]+", text or "")
    return [zlib.crc32(" ".join(k[i:i + n]).encode()) % Q.BUCKETS for n in range(1, order + 1) for i in range(len(k) - n + 1)]


def _both(spark, order):
    texts = [t for t in _texts() if t is None or len(t) < 5000]
    docs = spark.createDataFrame([(i, t, 1, "s", "k", "w") for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, int(i % 6 == 1)) for i in range(0, len(texts), 1)] + [(None, 1, 0), (3, 1, None), (4, None, None)],
                                   "doc_id long, quality int, toxic int")
    marked, good = Q.trusted_flag(docs, labels)
    scored = Q.judge(docs, Q.fit(marked, good, order=order), order=order, threshold=-0.1)
    return texts, {r["doc_id"]: r for r in scored.collect()}


def test_scores_against_plain_python(spark):
    for order in (1, 2):
        texts, got = _both(spark, order)
        trusted = {i for i in range(len(texts)) if i % 2 == 1 and i % 6 != 1}
        raw, good = Counter(), Counter()
        for i, t in enumerate(texts):
            raw.update(_features(t, order))
            good.update(_features(t, order) if i in trusted else [])
        share = lambda c, b: math.log((c[b] + 1) / (sum(c.values()) + Q.BUCKETS))
        for i, t in enumerate(texts):
            f = _features(t, order)
            want = sum(share(good, b) - share(raw, b) for b in f) / len(f) if f else 0.0
            assert abs(got[i]["score"] - want) < 1e-9
            assert got[i]["kept"] == (not _base(t)[5] and want >= -0.1)


def test_columns_rows_and_empty_tables(spark):
    rows = [(1, "a b", 1, "s", "k", "w"), (1, "a b", 1, "s", "k", "w"), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = Q.judge(docs, Q.fit(*Q.trusted_flag(docs, none)))
    assert sorted(out.columns) == sorted(["doc_id", "text", "w", *Q.BASE, "score", "kept"])
    assert out.count() == 3 and out.where("kept").count() == 0
    empty = docs.limit(0)
    assert Q.judge(empty, Q.fit(*Q.trusted_flag(empty, none))).count() == 0


def test_junk_goes_and_clean_text_stays(spark):
    rnd = random.Random(8)
    clean = [" ".join(rnd.choice(["the", "river", f"n{rnd.randrange(400)}", f"m{rnd.randrange(400)}"]) for _ in range(120)) + "." for _ in range(80)]
    junk = [" ".join(w + rnd.choice(["$$$", "&&&", "%%%", "###"]) for w in c.split()) for c in clean[:12]]
    docs = spark.createDataFrame(list(enumerate(clean + junk)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    kept = {r[0] for r in Q.judge(docs, Q.fit(*Q.trusted_flag(docs, labels))).where("kept").select("doc_id").collect()}
    assert kept == set(range(80))


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    out = Q.judge(docs, Q.fit(docs, F.lit(True)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "NestedLoop", "Cartesian", "Generate"))


def test_pairs_of_tokens_count_by_default(spark):
    rnd = random.Random(3)
    good = [" ".join(f"a{i % 60} b{i % 60}" for i in (rnd.randrange(60) for _ in range(80))) for _ in range(30)]
    mixed = [" ".join(rnd.sample(t.split(), 160)) for t in good]          # the same words, out of order
    docs = spark.createDataFrame(list(enumerate(good + mixed)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    weights = Q.fit(*Q.trusted_flag(docs, labels))
    got = {r["doc_id"]: r["score"] for r in Q.judge(docs, weights).collect()}
    assert all(got[i] > got[i + 30] + 0.1 for i in range(30))


def test_features_of_every_character_and_order(spark):
    rnd = random.Random(5)
    some = [*map(chr, range(0x180)), " ", "　", "퟿", "￿", "\U00010000", "\U0010ffff"]
    texts = [None, "", " ", "a", "a b", "a-b", "".join(some)] + ["".join(rnd.choices(some, k=rnd.randrange(60))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", Q._tokens("text").alias("k"))
    for order in (1, 2, 4):
        got = docs.select("doc_id", Q._features("k", Q.BUCKETS, order).alias("f"))
        assert {r["doc_id"]: r["f"] for r in got.collect()} == {i: _features(t, order) for i, t in enumerate(texts)}
    # tokens are joined as bytes, without strings in between
    plan = docs.select(Q._features("k", Q.BUCKETS, 2))._jdf.queryExecution().executedPlan().toString()
    assert dict(docs.dtypes)["k"] == "array<binary>" and "concat_ws" not in plan


def test_windows_that_share_only_high_bits_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(Q, "_PLACE", (1 << 62) - 1)          # two bits of a hash are left: all windows look alike at first
    texts = [t for t in _texts() if t is None or len(t) < 5000]
    docs = spark.createDataFrame([(i, t, 1, "s", "k", "w") for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: tuple(r[c] for c in Q.BASE) for r in Q.with_base(docs).collect()}
    assert got == {i: _base(t) for i, t in enumerate(texts)}


def test_features_are_counted_in_columns(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(Q, "staged", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    docs = spark.createDataFrame([(1, "a b a", True), (2, "", True), (3, None, None), (4, "a, b", False)], "doc_id long, text string, good boolean")
    for order in (1, 2, 3):
        want = Counter(x for t in ("a b a", "a, b") for x in _features(t, order))
        weights = {r["bucket"]: r["weight"] for r in Q.fit(docs, F.col("good"), order=order).collect()}
        good, size = Counter(_features("a b a", order)), sum(want.values()) + Q.BUCKETS
        assert weights.keys() == want.keys()
        for b, w in weights.items():
            assert abs(w - math.log((good[b] + 1) / (sum(good.values()) + Q.BUCKETS)) + math.log((want[b] + 1) / size)) < 1e-12
    assert plans and not any("lambda" in p for p in plans)
