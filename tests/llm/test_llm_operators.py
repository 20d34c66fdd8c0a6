"""Edge cases of the training-data operators: nulls, empty and long texts,
ties, repeated rows, empty tables and clashing column names, against brute
force or an exact round trip."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np

from pyspark.sql import functions as F

from loadgrid.llm import (best_fit_packing, decontamination, exact_topk, language_id, lm_scoring, minhash_dedup, pii,
                          suffix_dedup, token_output, tokens, url_filters)
from loadgrid.llm.common import prepare

DOCS = "doc_id long, text string"
random.seed(11)
VOCAB = {"en": ["the", "of", "and", "thing", "tion", "whether", "ing", "shore", "and", "with"],
         "de": ["der", "die", "und", "ungen", "keit", "schön", "über", "nicht", "straße", "ge"]}


def prose(n, lang="en", rng=random):
    return " ".join("".join(rng.choice(VOCAB[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def docs(spark, rows, schema=DOCS):
    return prepare(spark).createDataFrame(rows, schema)


# --- 1: repeated byte strings ----------------------------------------------

def brute_removed(rows, length):
    count = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[p:p + length] for p in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, np.int8)
        for p in range(len(b) - length + 1):
            if count[b[p:p + length]] > 1:
                gone[p:p + length] = 1
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup_matches_brute_force(spark):
    passage, near = prose(30), prose(60, "de")
    edited = near.replace("ungen", "unged", 2)
    rows = [(1, prose(20) + passage + prose(10)), (2, passage + prose(25)), (3, near), (4, edited), (5, near), (6, None),
            (7, ""), (8, "aé" * 150), (9, "ab" * 10), (None, passage), (None, "x" + passage), (10, prose(15)), (10, prose(15)),
            (11, "same row " * 9), (11, "same row " * 9), (12, prose(2000)), (13, "q" * 5000)]
    df = docs(spark, [(i, t, 0, "k") for i, t in rows], "doc_id long, text string, doc_h long, data string")
    got = suffix_dedup.remove_repeats(df, threshold=60, seed=20, block=8)
    assert sorted([tuple(r)[:5] for r in got.collect()], key=str) == brute_removed(rows, 60)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())


def test_suffix_dedup_empty_table(spark):
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0


# --- 2: language ID ----------------------------------------------------------

def test_language_id_held_out_accuracy_and_rejection(spark):
    rows = [(i, prose(random.randint(3, 200), lang), lang, 0.5) for i, lang in enumerate(["en", "de"] * 60)]
    odd = [(900, None, "en", 1.0), (901, "", "en", 1.0), (902, "1234 $$$ 77", None, 1.0),
           (903, "привет мир это другой язык " * 20, None, 1.0), (None, prose(40, "de"), None, 1.0), (904, "the", None, 0.0)]
    df = docs(spark, rows + odd + rows[:2], "doc_id long, text string, lang string, score double")
    train, held = language_id.train_split(df)
    out = language_id.predict(df.withColumn("held", held), language_id.train(train, sample=40, clusters=2)).collect()
    assert len(out) == len(rows) + len(odd) + 2
    by = {r.doc_id: r for r in out}
    held = [r for r in out if r.held and r.text and r.lang]
    assert held and all(r.lang_pred == r.lang for r in held)
    assert not any(r.rejected for r in out if r.doc_id is not None and r.doc_id < 900)
    assert [by[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and by[900].score == 0.0
    assert by[903].rejected and by[903].lang_pred in VOCAB and by[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in out)


def test_language_id_nothing_learned(spark):
    df = docs(spark, [(1, "text", None)], "doc_id long, text string, lang string")
    r = language_id.predict(df, language_id.train(df)).first()
    assert (r.lang_pred, r.rejected) == ("und", True)
    assert language_id.predict(df.limit(0), language_id.train(df.limit(0))).count() == 0


# --- 3, 6: packing -----------------------------------------------------------

TEXTS = [(1, prose(900)), (2, None), (3, ""), (4, "é ü <|endoftext|> \U0001F600 x"), (5, prose(3)), (5, prose(4)), (6, prose(700)),
         (None, prose(30)), (7, "a" * 9000), *[(100 + i, prose(random.randint(1, 300))) for i in range(40)]]


def expected_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    return t.encode(text or "", add_special_tokens=False).ids + [tokens.END_ID]


def test_fast_ids_equal_the_tokenizers_file():
    encode = tokens.Ids()
    rng = random.Random(5)
    alphabet = "ab  \n\t'sé—日本🙂0129,.’\u00a0\u200bßA<|>"
    for n in range(400):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert encode(t) + [tokens.END_ID] == expected_ids(t)


def test_best_fit_packing_round_trip(spark):
    df = docs(spark, [(i, t, 1, 2) for i, t in TEXTS], "doc_id long, text string, length long, part int")
    got = best_fit_packing.pack_documents(df).collect()
    want = collections.Counter()
    for i, t in TEXTS:
        ids = expected_ids(t)
        for k, (s, n) in enumerate(tokens.cuts(len(ids))):
            want[i, k, s, n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    rows = collections.defaultdict(list)
    for r in got:
        rows[r.sequence_id].append((r.offset, r.length))
    for v in rows.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 1024
    assert best_fit_packing.pack_documents(df.limit(0)).count() == 0


def test_pieces_of_the_first_may_be_shorter():
    assert tokens.cuts(1024) == [(0, 1024)] and tokens.cuts(2048) == [(0, 1024), (1024, 1024)]
    assert tokens.cuts(1030) == [(0, 6), (6, 1024)] and tokens.cuts(1) == [(0, 1)]


def exact_bins(sizes, cap):
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= cap:
                place(i + 1, bins[:j] + [bins[j] + sizes[i]] + bins[j + 1:])
        place(i + 1, bins + [sizes[i]])
    place(0, [])
    return best


def test_lower_bound_never_exceeds_the_optimum():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = rng.integers(1, 21, rng.integers(1, 9))
        opt = exact_bins(sorted(map(int, sizes), reverse=True), 20)
        b, off, fill = best_fit_packing.best_fit_decreasing(sizes, 20)
        assert best_fit_packing.lower_bound(sizes, 20) <= opt <= len(fill) and fill.max() <= 20
        assert sorted(map(len, token_output.pack_rows(sizes.tolist(), 20))) == sorted(np.bincount(b).tolist())


def test_rounds_exchange_between_partitions(spark):
    rng = np.random.default_rng(9)
    rows = [(i, 0, int(n)) for i, n in enumerate(rng.integers(1, 1024, 600))]
    df = prepare(spark).createDataFrame(rows, "doc_id long, piece int, length long")
    apart = best_fit_packing.pack(df, part_rows=60, rounds=1).select("sequence_id").distinct().count()
    got = best_fit_packing.pack(df, part_rows=60, rounds=5)
    assert got.count() == 600 and got.select("sequence_id").distinct().count() <= apart


def test_packing_goes_on_until_a_round_saves_nothing_and_shows_its_bounds(spark):
    rng = np.random.default_rng(9)
    rows = [(i, 0, int(n)) for i, n in enumerate(rng.integers(200, 700, 1500))] + [(5000 + i, 0, 1024) for i in range(3)]
    df = prepare(spark).createDataFrame(rows, "doc_id long, piece int, length long")
    packed = best_fit_packing.pack(df, part_rows=40, proof=True).collect()
    four = best_fit_packing.pack(df, part_rows=40, rounds=4).select("sequence_id").distinct().count()
    fill = collections.Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert len(packed) == 1503 and max(fill.values()) <= 1024 and len(fill) <= four
    proof = best_fit_packing.certificates(spark.createDataFrame(packed)).collect()
    assert sum(r.sequences for r in proof) == len(fill) and all(r.bound <= r.sequences for r in proof)
    assert all(r.certified == (r.bound == r.sequences) for r in proof)
    for r in proof:
        sizes = np.array([x.length for x in packed if (x.sequence_id >> 24 if x.sequence_id >= 0 else None) == r.part])
        assert best_fit_packing.lower_bound(sizes, 1024) <= r.sequences
    assert {r.part: r.sequences for r in proof}[None] == 3


def test_token_output_round_trip(spark):
    df = docs(spark, [(i, t, b"x") for i, t in TEXTS], "doc_id long, text string, ids binary")
    back, n = collections.defaultdict(list), 0
    for r in token_output.packed_matrices(df, block_tokens=4000).collect():
        ids, pos = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(pos) == 1024 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for d, s, lo, hi in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert pos[lo:hi].tolist() == list(range(hi - lo))
            back[d].append((s, ids[lo:hi].tolist()))
            n += hi - lo
    assert n == sum(len(expected_ids(t)) for _, t in TEXTS)
    for i, t in TEXTS:
        if i != 5:
            assert sum((x for _, x in sorted(back[i])), []) == expected_ids(t)
    assert sorted(x for _, x in back[5]) == sorted(expected_ids(t) for i, t in TEXTS if i == 5)
    assert token_output.packed_matrices(df.limit(0)).count() == 0


def test_capacity_tree():
    rng = random.Random(2)
    tree, have = token_output.CapacityTree(50), collections.Counter()
    for _ in range(2000):
        x = rng.randint(0, 50)
        if rng.random() < 0.5 or not have[x]:
            tree.add(x, 1)
            have[x] += 1
        else:
            tree.add(x, -1)
            have[x] -= 1
        s = rng.randint(0, 50)
        assert tree.tightest(s) == min((k for k, v in have.items() if v and k >= s), default=None)


# --- 4: url rules -------------------------------------------------------------

def test_url_filters_against_brute_force(spark):
    rules = [*url_filters.RULES, ("block", "b.example.com", "/en"), ("allow", "b.example.com", "/en/x?"), ("block", "org", "")]
    urls = [None, "", "no scheme.com/", "http://COM/", "http://com", "https://www.Example.com/en/a?b#c", "http://x.example.com/en/",
            "http://b.example.com/english", "ftp://a.net/es/1", "a://net/fr/", "http://notnet/es/", "http://a.example.com?en/",
            "http://é.ÉX.com/en/", "http://org#x", "http://a..com/", "http://com./", "x://y://com/en/", "http://" + "a." * 400 + "com/"]
    df = spark.createDataFrame([(i, u, "old", "x") for i, u in enumerate(urls + urls[5:8])],
                               "page_id long, url string, host string, __host string")
    got = {(r.page_id): (r.host, r.path, r.rule, r.verdict, r["__host"]) for r in
           url_filters.judge(df, url_filters.rules_frame(spark, rules)).collect()}
    for i, u in enumerate(urls + urls[5:8]):
        host, path = "", ""
        if u and "://" in u:
            host, path = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S).groups()
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else (0, None, "allow")
        assert got[i] == (host, path, best[1], best[2], "x"), u
    assert {r.verdict for r in url_filters.judge(df, url_filters.rules_frame(spark, [])).collect()} == {"allow"}
    assert url_filters.judge(df.limit(0), url_filters.rules_frame(spark, rules)).count() == 0


def test_url_filters_stay_native(spark):
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    plan = url_filters.judge(df, url_filters.rules_frame(spark, url_filters.RULES))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 5: near-duplicates -------------------------------------------------------

def brute_classes(rows):
    bags = []
    for _, t in rows:
        w = re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", (t or "").lower())
        s = [tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))] if w else []
        bags.append({k: 1 + math.log(v) for k, v in collections.Counter(s).items()})
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = bags[a], bags[b]
        j = sum(1 / sum(max(x.get(e, 0) / x[k], y.get(e, 0) / y[k]) for e in x.keys() | y.keys()) for k in x.keys() & y.keys())
        if j >= 0.8 - 1e-9:
            comp[find(b)] = find(a)
    return [find(i) for i in range(len(rows))]


def test_near_duplicates_match_brute_force(spark):
    base = [prose(80).split() for _ in range(6)]
    rows = []
    for f, words in enumerate(base):
        for c in range(14):
            w = list(words)
            for _ in range(c % 4):
                w[random.randrange(len(w))] = f"x{random.randrange(9999)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(900, None), (901, ""), (902, "!!"), (903, "one two"), (904, "One, two."), (905, "one two three"), (906, prose(6000)),
             (None, " ".join(base[0])), (907, "the same line here now " * 30), (907, "the same line here now " * 30)]
    df = docs(spark, [(i, t, "n", 5) for i, t in rows], "doc_id long, text string, node string, comp int")
    got, links = minhash_dedup.near_duplicates(df, small=4)
    want = brute_classes(rows)
    ids = {c: min((rows[i][0] for i in range(len(rows)) if want[i] == c and rows[i][0] is not None), default=None) for c in set(want)}
    assert collections.Counter((r.doc_id, r.class_id) for r in got.collect()) == \
        collections.Counter((i, ids[c]) for (i, _), c in zip(rows, want))
    kept = [r.doc_id for r in minhash_dedup.keep_one(df, small=4).collect()]
    assert sorted(kept) == sorted(i for i in set(ids.values()))
    assert minhash_dedup.classes(df.limit(0)).count() == 0


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(4)
    v = np.sort(rng.integers(0, 2**63, 60, dtype=np.uint64))
    wa, wb = rng.random(40) + 0.2, rng.random(40) + 0.2
    a, b = v[:40], v[20:]
    exact = minhash_dedup.probability_jaccard(a, wa, b, wb)
    x, y = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    slow = sum(1 / sum(max(x.get(e, 0) / x[k], y.get(e, 0) / y[k]) for e in x.keys() | y.keys()) for k in x.keys() & y.keys())
    assert abs(exact - slow) < 1e-9
    m = 4000
    reg = minhash_dedup.prob_minhash(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([0, 40, 80]), m)
    assert abs((reg[0] == reg[1]).mean() - exact) < 5 * math.sqrt(exact * (1 - exact) / m)


def test_components_of_a_long_chain(spark):
    n = 200
    nodes = spark.createDataFrame([(i,) for i in range(n + 2)], "node long")
    links = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
    got = {r.node: r.comp for r in minhash_dedup.components(nodes, links).collect()}
    assert got == {i: 0 if i < n else i for i in range(n + 2)}


# --- 7: top-k ------------------------------------------------------------------

def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 8) / 256]) for i in range(300)]
    odd = [(None, [0.1] * 8), (900, None), (901, []), (902, [0.1, None] * 4), (903, [float("nan")] * 8), (904, [float("inf")] * 8),
           (950, [1.0, 2.0]), (951, [3.0, 4.0]), (0, rows[0][1]), (1000, [1e30] * 8)]
    df = spark.createDataFrame([(i, v, 1, 7) for i, v in rows + odd], "vec_id long, embedding array<float>, label int, shard int")
    v = exact_topk.quantised(df)
    got = [tuple(r) for r in exact_topk.top_k(v, F.col("vec_id") % 50 == 0, shard_rows=40).orderBy("query_id", "rank").collect()]
    ok = [(n, i, [min(math.floor(256 * np.float32(x)), 2**63 - 1) for x in e]) for n, (i, e) in enumerate(rows + odd)
          if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for n, q, e in ok:
        if q is not None and q % 50 == 0:
            s = sorted((-min(max(sum(a * b for a, b in zip(e, f)), -2**63), 2**63 - 1), i is None, i or 0) for m, i, f in ok if m != n and len(e) == len(f))
            want += [(q, r + 1, None if none else i, -x) for r, (x, none, i) in enumerate(s[:5])]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert exact_topk.top_k(v.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# --- 8: personal data -----------------------------------------------------------

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(t):
    out = []
    for k, (name, p) in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            if (k == 0 or k == 1 and all(int(x) <= 255 for x in m.group().split("."))
                    or k == 2 and 14 <= len(d) <= 19 and pii.luhn(d) or k == 3 and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(8)
    for alphabet in ("0123456789..--  +()@a%é\n2255", "40012 -+.", "a.@b-%_+1"):
        for _ in range(8000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 45)))
            assert pii.base_spans(t) == brute_spans(t), t
    assert pii.base_spans("1" * 200_000 + "@" + "a" * 200_000) == []


def filled(rng, n):
    d = [4] + [rng.randrange(10) for _ in range(14)]
    card = next("".join(map(str, d)) + str(c) for c in range(10) if pii.luhn("".join(map(str, d)) + str(c)))
    pick = [f"{rng.choice('abc')}{n}.x@mail{rng.randrange(9)}.example.com", ".".join(str(rng.randrange(256)) for _ in range(4)), card,
            f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"]
    return prose(30, rng=rng) + " " + rng.choice(pick) + ", " + prose(20, rng=rng) + f" {rng.randrange(99999)}."


def test_pii_tagger_learns_and_spans_hold(spark):
    rng = random.Random(21)
    rows = [(i, filled(rng, i)) for i in range(400)]
    extra = [(900, None), (901, ""), (902, prose(400)), (903, "call (555) 555-0199 now or 4111.1111.1111.1111"), (None, rows[0][1]),
             (904, "long " * 20000 + rows[1][1])]
    df = docs(spark, rows + extra + rows[:1])
    model = pii.train(df.where("doc_id < 300"), epochs=10)
    hit = total = 0
    for _, t in rows[300:]:
        spans = {(s, e) for s, _, e in brute_spans(t)}
        hit += len(spans & {(s, e) for s, _, e in pii.added_spans([t], [[]], model)[0]})
        total += len(spans)
    assert total > 80 and hit / total > 0.8          # the tagger alone, on texts it has not seen
    out = pii.find(df, model).collect()
    assert len(out) == len(rows) + len(extra) + 1
    texts = collections.defaultdict(set)
    for i, t in rows + extra:
        texts[i].add(t or "")
    for r in out:
        (t,) = texts[r.doc_id]
        b = pii.joined(brute_spans(t))
        assert r.base_sha256 == hashlib.sha256(b.encode()).hexdigest()
        assert set(filter(None, b.split(","))) <= set(r.spans.split(","))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in brute_spans(t)) for i in range(4)]
    clean = {r.doc_id: r.spans for r in out}
    assert clean[900] == clean[901] == clean[902] == ""
    red = {r.doc_id: r for r in pii.redact(df.withColumn("n_chars", __import__("pyspark").sql.functions.length("text"))
                                          .withColumn("__p", __import__("pyspark").sql.functions.lit(1)), model).collect()}
    assert red[902].text == texts[902].copy().pop() and red[900].text is None
    assert not brute_spans(red[1].text) and red[1].n_chars == len(red[1].text) and red[1]["__p"] == 1
    assert pii.find(df.limit(0), None).count() == 0 and pii.train(df.where("doc_id = 902")) is None


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    p = pii._init(rng)
    ids, y = rng.integers(1, 60, (3, 7)), rng.integers(0, 1, (3, 7))
    y[:, 2], y[:, 3] = 1, 2
    _, g = pii.gradients(p, ids, y)
    for k in ("emb", "wf", "ub", "out", "trans", "start", "bb"):
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        old, eps = p[k][at], 1e-5
        p[k][at] = old + eps
        up = pii.gradients(p, ids, y)[0]
        p[k][at] = old - eps
        down = pii.gradients(p, ids, y)[0]
        p[k][at] = old
        assert abs((up - down) / (2 * eps) - g[k][at]) < 1e-5, k


def test_masking_overlaps():
    assert pii.masked("ab 12 cd", [(3, 2, 5), (4, 3, 6)]) == "ab [CARD]cd"
    assert pii.masked("x", []) == "x" and pii.masked("abc", [(0, 0, 3)]) == "[EMAIL]"


# --- 9: language model -----------------------------------------------------------

def test_lm_scores(spark):
    from pyspark.sql import functions as F
    rng = random.Random(31)
    rows = [(i, prose(60, rng=rng).title()) for i in range(120)] + [(500, None), (501, ""), (502, "zzqq ☃ unseen\x0bword"), (None, "the of"),
                                                                   (3, "twice"), (3, "twice"), (503, "W " * 3000)]
    df = docs(spark, [(i, t, 1) for i, t in rows], "doc_id long, text string, block int")
    left = lm_scoring.remainder(F.col("doc_id"), 7)
    out = lm_scoring.score(df, F.coalesce(left == 2, F.lit(False)), F.coalesce(left != 2, F.lit(False)), block_bytes=5000).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + [None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t in toks if i is not None and not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6))
                  for i, t in toks)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 and math.isfinite(r.score) and r.spelled_score <= r.score + 1e-9 for r in out)
    assert len({round(r.score, 9) for r in out if r.doc_id == 3 and r.n_tokens == 2}) == 1      # equal texts, equal scores
    ho = [r for r in out if r.held_out]
    assert sum(r.score for r in ho) > sum(r.base_score for r in ho)      # better than add-one on unseen texts
    none = lm_scoring.score(df, F.lit(False), F.lit(False)).first()
    assert none.train_tokens == 0 and none.n_known == 0
    assert lm_scoring.score(df.limit(0), F.lit(False), F.lit(True)).count() == 0


def test_lm_scores_follow_the_order_of_words(spark):
    from pyspark.sql import functions as F
    rng, follow = random.Random(7), {w: [f"w{(3 * w + k) % 40}" for k in range(2)] for w in range(40)}
    def chain():
        out = [f"w{rng.randrange(40)}"]
        for _ in range(50):
            out.append(rng.choice(follow[int(out[-1][1:])]))
        return out
    rows = [(i, " ".join(chain()), 1) for i in range(150)]
    for i in range(20):
        t = chain()
        rows += [(1000 + 2 * i, " ".join(t), 1), (1001 + 2 * i, " ".join(rng.sample(t, len(t))), 1)]
    out = lm_scoring.score(docs(spark, rows, "doc_id long, text string, block int"), F.col("doc_id") >= 1000, F.col("doc_id") < 1000,
                           block_bytes=3000).collect()
    got = {r.doc_id: r for r in out}
    for i in range(1000, 1040, 2):
        assert abs(got[i].base_score - got[i + 1].base_score) < 1e-6 and got[i].score > got[i + 1].score + 10


def test_pairs_are_counted_over_all_blocks():
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401
    rng, emitted, want = random.Random(8), [], collections.Counter()
    for block in range(4):
        local, texts, meta, lists = {}, [], [], []
        for i in range(30):
            t = [f"w{int(rng.random() ** 3 * 40)}".encode() for _ in range(rng.randrange(12))] + [b""]
            train = rng.random() < 0.7
            texts.append(np.array([local.setdefault(w, len(local)) for w in t], "<u4"))
            meta.append((i if i else None, not train, train))
            lists.append(t)
            if train:
                want.update(zip([b"", *t], t))
        emitted.append((lists, *lm_scoring._emit(block, local, texts, meta)))
    cut = pa.Table.from_batches([e[1] for e in emitted])
    rows = pa.Table.from_batches(list(lm_scoring._slices(6)(cut.drop_columns("slice").to_batches()))).sort_by([("slice", "ascending"), ("block", "ascending")])
    back = pa.Table.from_batches(list(lm_scoring._count_slices(rows.to_batches(max_chunksize=7), pack_bytes=300)))
    assert sum(back["once"].to_pylist()) == sum(n == 1 for n in want.values())
    assert sum(back["twice"].to_pylist()) == sum(n == 2 for n in want.values())
    m, t, n = collections.Counter(), collections.Counter(), collections.Counter()
    for block, (lists, own) in enumerate(emitted):
        mine = back.filter(pa.compute.equal(back["block"], block)).drop_columns(["once", "twice"])
        table = pa.concat_tables([mine, pa.Table.from_batches([own])], promote_options="default")
        data, packed, meta, c, _ = lm_scoring._block_of(table)
        ids, doc_id, size, flags = lm_scoring._opened(data, meta)
        assert flags[0] & 1 and doc_id[1:].tolist() == list(range(1, 30)) and size.tolist() == [len(x) for x in lists]
        number = lm_scoring._pairs(ids, packed)[3]
        flat = [p for x in lists for p in zip([b"", *x], x)]
        assert c[number].tolist() == [want[p] for p in flat]
        for r in lm_scoring._word_rows(table).to_pylist():
            m[r["word"]] += r["m"]
            t[r["word"]] += r["t"]
            n[r["word"]] += r["n"]
    assert +m == collections.Counter(w for _, w in want) and +t == collections.Counter(u for u, _ in want)
    assert all(n[w] == sum(k for (_, x), k in want.items() if x == w) for w in n)
    # the probabilities after each word, and that of unknown words, sum to one
    total = sum(m.values())
    p1 = {w: m[w] / (total + 1.0) for w in m if m[w]} | {None: 1.0 / (total + 1.0)}
    for u in t:
        p = [10 ** float(lm_scoring.pair_log10(np.array(want[u, w]), np.array(n[u]), np.array(t[u]), np.log10(q), 0.6)) for w, q in p1.items()]
        assert abs(sum(p) - 1) < 1e-9


def test_pairs_are_seated_by_draws(spark):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(4)
    n, v = 3000, 60
    u, w, key = rng.integers(0, v, n), rng.integers(0, v, n), rng.integers(0, 2**63, n).astype(np.uint64)
    c = rng.integers(0, 40, n) * (rng.random(n) < 0.8)
    logp, one = np.log10(rng.dirichlet(np.ones(v))), np.bincount(u, np.minimum(c, 1), minlength=v)
    t = lm_scoring.pair_tables(key, c, u, w, [(one, logp)], 0.6)
    assert ((t >= np.minimum(c, 1)) & (t <= c)).all() and (t[c > 5] > 1).mean() > 0.2
    some = rng.permutation(n)[:500]                   # another block, other numbers of the words: the same tables
    assert (lm_scoring.pair_tables(key[some], c[some], v - 1 - u[some], v - 1 - w[some], [(one[::-1], logp[::-1])], 0.6) == t[some]).all()
    two = lm_scoring.pair_tables(key, c, u, w, [(one, logp), (np.bincount(u, t, minlength=v), logp)], 0.6)
    assert ((two >= np.minimum(c, 1)) & (two <= c)).all() and (two != t).any()
    # after a word with drawn tables the probabilities sum to one
    n_u, t_u = np.array([7, 3, 2]), np.array([3.0, 1.0, 1.0])
    p1 = np.array([0.2, 0.3, 0.4, 0.1])
    p = 10 ** lm_scoring.pair_log10(np.r_[n_u, 0], 12, 5.0, np.log10(p1), 0.6, np.r_[t_u, 0])
    assert abs(p.sum() - 1) < 1e-12
    # scores do not depend on how texts are cut into blocks, and each sweep seats again
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{int(rng.random() ** 3 * 30)}" for _ in range(60))) for i in range(60)]
    df = docs(spark, [(i, t, 1) for i, t in rows], "doc_id long, text string, block int").repartition(3)
    got = [{r.doc_id: round(r.score, 6) for r in lm_scoring.score(df, F.lit(False), F.lit(True), block_bytes=size, pair_sweeps=k).collect()}
           for size, k in ((1 << 20, 1), (700, 1), (1 << 20, 0), (1 << 20, 2))]
    assert got[0] == got[1] and got[0] != got[2] and got[0] != got[3]


def test_spelling_is_a_distribution():
    x = np.array([2, 3, 0, 2, 2, 0, 4, 0, 2, 3, 0])
    code, n = np.unique(lm_scoring.codes(x, 6, 3), return_counts=True)
    m = lm_scoring.Spelling(code, n, 6, 3)
    for _ in range(4):
        m.sweep()
        assert np.allclose(m.predictive(2).reshape(36, 6).sum(axis=1), 1)
        for level in range(3):
            assert (m.tables[level] >= 1).all() and (m.tables[level] <= m.customers[level]).all()


def test_seating_follows_the_sequential_process():
    rng, slow = np.random.default_rng(2), []
    for _ in range(400):
        t = 1
        for k in range(1, 1000):
            a = (1.0 + 0.3 * (3.0 + t)) * 0.3
            t += rng.random() < a / (a + k - 0.3 * t)
        slow.append(t)
    words = np.arange(4000, dtype=np.uint64) * np.uint64(7919)
    for draws in (lm_scoring.Draws(2), lm_scoring.WordDraws(words, 0)):
        many = lm_scoring.seat(draws, np.full(4000, 1000), np.full(4000, 3.0), np.full(4000, 0.3), 0.3, 1.0)
        assert abs(many.mean() - np.mean(slow)) < 0.35
    who = np.arange(4000)
    for mean in (0.5, 7.0, 400.0):
        x = lm_scoring.WordDraws(words, 3).poisson(who, np.full(4000, mean), 128)
        assert abs(x.mean() - mean) < 5 * math.sqrt(mean / 4000) and abs(x.var() / mean - 1) < 0.15


# --- 10: decontamination ------------------------------------------------------------

def test_decontamination_matches_brute_force(spark):
    items = [(k, prose(random.choice([8, 25, 60, 150]))) for k in range(12)] + [(50, None), (51, "too short"), (52, ""), (0, "again " + prose(9))]
    rows = []
    for k, (i, t) in enumerate(items[:12]):
        w = t.split()
        rows.append((len(rows), prose(3000) + " " + t + " " + prose(50)))
        rows.append((len(rows), prose(20) + " " + " ".join(w[: len(w) // 2]) + " " + prose(9)))
        rows.append((len(rows), " ".join(w[:-1] + ["altered"]).upper()))
        rows.append((len(rows), " ".join(w[: len(w) // 2 + 2]) + " gap " + " ".join(w[len(w) // 2 - 2:])))
    rows += [(900, None), (901, ""), (902, "a b c"), (None, items[1][1]), (0, rows[0][1])]
    df = docs(spark, [(i, t, 1, "k") for i, t in rows], "doc_id long, text string, item_id int, keys string")
    bench = spark.createDataFrame(items, "item_id long, text string")

    def grams(t):
        w = re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", (t or "").lower())
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    want = {(i, j, len(grams(t) & grams(u)), len(grams(u))) for i, t in rows for j, u in items
            if grams(u) and len(grams(t) & grams(u)) >= 0.8 * len(grams(u)) - 1e-9}
    got = {(r.doc_id, r.item_id, r.n_common, r.n_shingles) for r in decontamination.contaminated(df, bench).collect()}
    assert got == want and len(want) > 20
    kept = decontamination.clean(df, bench).collect()
    bad = {i for i, *_ in want}
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(i) for i, _ in rows if i not in bad)
    assert kept[0].asDict().keys() == {"doc_id", "text", "item_id", "keys"}
    assert decontamination.contaminated(df.limit(0), bench).count() == 0
    assert decontamination.clean(df, bench.limit(0)).count() == len(rows)


def test_decontamination_full_bitmap_changes_nothing(spark, monkeypatch):
    item = prose(40)
    df = docs(spark, [(1, prose(500) + " " + item), (2, prose(300))])
    monkeypatch.setattr(decontamination, "_bitmap", lambda *a: np.full((1 << decontamination.BITS) // 8, 255, np.uint8))
    assert [r.doc_id for r in decontamination.contaminated(df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()] == [1]


def test_large_family_is_joined_through_prefixes(spark):
    """A family whose members mostly reach only the original: prefixes must find what the centres miss."""
    rng = random.Random(77)
    words = prose(120, rng=rng).split()
    rows = [(0, " ".join(words))]
    for i in range(1, 40):
        w = list(words)
        for k in rng.sample(range(len(w)), rng.choice([2, 3, 5, 8])):
            w[k] = f"y{i}z{k}"
        rows.append((i, " ".join(w)))
    got, _ = minhash_dedup.near_duplicates(docs(spark, rows), small=2)
    want = brute_classes(rows)
    low = {c: min(i for i, k in enumerate(want) if k == c) for c in set(want)}
    assert {r.doc_id: r.class_id for r in got.collect()} == {i: low[c] for i, c in enumerate(want)}
    assert len(set(want)) > 1
