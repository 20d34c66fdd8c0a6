"""Operator 12 (native): quality rules by hashed n-gram log-likelihood ratios.

Every text is cut into tokens (runs of ASCII letters, digits, underscores and
all non-ASCII characters; runs of other visible ASCII characters). Its n-grams
of up to ``order`` (two) tokens are hashed into ``buckets`` features. Two
multinomials with add-``alpha`` smoothing are counted over all documents: one
of the trusted documents, one of the raw corpus. A document's score is the
mean over its features of ``ln(p_trusted / p_raw)``; it is kept if the score
is at least ``threshold``. Nothing is drawn: equal texts get equal verdicts.

Plain rules stand in front (``base``): fewer than ``MIN_WORDS`` words, or more
than half of the words in 3-word windows that the text repeats.

What Spark does: the tokens are exploded with those after them, their features
are columns and counted by one aggregation (a map task sends ``buckets`` rows at most); the weights, one array of
``buckets`` numbers, reach the second scan as a scalar subquery. Base rules
and scores are expressions on the row: no shuffle, no join, and all columns
and repeated rows stay as they are. DataFrame functions only.

Null texts count as empty: no words, so the base rules fail them. A text
without a feature scores 0 and an empty corpus has no weights; the base rules
fail such texts as well. Without a trusted document the scores rank rare
features only. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_below, fresh, keep, staged

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
BUCKETS, ALPHA, ORDER = 1 << 14, 1.0, 2
#: Nats a feature; trusted documents that the model has not seen lie above -0.1, junk below -0.7 (sf0.1).
THRESHOLD = -0.5
#: Up to so many trusted ids (8 bytes each) are broadcast.
MAX_IDS = 500_000
_SPACE = r"\x20\x09-\x0D"
#: Places of windows in the low bits beside the high bits of their hashes; an array holds no more.
_PLACE = (1 << 31) - 1
_ASCII = [chr(i) for i in range(128) if not (chr(i).isalnum() or chr(i) == "_")]
#: ``[0-9A-Za-z_\x80-\x{10FFFF}]+|[!-/:-@\[-^`{-~]+`` character by character: Java looks such classes up in a bitmap.
_TOKEN = "[^{}]+|[{}]+".format(*("".join(f"\\x{ord(c):02X}" for c in chars) for chars in (_ASCII, [c for c in _ASCII if "!" <= c <= "~"])))
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus the base columns (existing ones of these names go)."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    tt, w, ln, h, s, p = fresh(docs, *"__t __w __l __h __s __p".split())
    long = lambda c: c.cast("long")
    own, none = keep(docs, *BASE), F.array().cast("array<long>")
    # each step reads the arrays of the one before more than once, so Spark keeps them apart; Java's \s is _SPACE
    d = docs.select(*own, t.alias(tt), F.array_remove(F.split(t, r"\s+"), "").alias(w),
                    F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{_SPACE}]")).alias(ln))
    d = d.select(*own, tt, ln, long(F.length(F.array_join(w, ""))).alias("word_chars"), F.transform(w, lambda x: F.xxhash64(x)).alias(w))
    window = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))),
                         lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, WINDOW))))
    d = d.select(*own, long(F.size(w)).alias("n_words"), "word_chars", long(F.regexp_count(tt, F.lit("[#*$%&|<>]"))).alias("n_symbols"),
                 long(F.size(ln) - F.size(F.array_distinct(ln))).alias("n_dup_lines"), window.alias(h))
    # equal hashes share their high bits: numbers of those and the place are sorted, and what has
    # neighbours there goes on as whole hashes with places, sorted again: equal ones stand together
    d = d.withColumn(s, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(
        h, lambda x, i: x.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(long(i))))).otherwise(none))
    near = lambda x, j: F.get(s, j).bitwiseXOR(x).between(0, _PLACE)
    place = lambda x: x.bitwiseAND(F.lit(_PLACE)).cast("int")
    d = d.withColumn(s, F.sort_array(F.transform(F.filter(s, lambda x, j: near(x, j - 1) | near(x, j + 1)),
                                                 lambda x: F.struct(F.get(h, place(x)).alias("h"), place(x).alias("i")))))
    same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    d = d.withColumn(p, F.sort_array(F.transform(
        F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])))
    covered = F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", covered)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed).drop(h, s, p)


def _tokens(text: str) -> Column:
    """Tokens as bytes: what is hashed is joined and read without strings in between."""
    return F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(_TOKEN), F.lit(0)).cast("array<binary>")


def _join(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit(b" "), b)


def _number(gram: Column, buckets: int) -> Column:
    """Feature number of an n-gram: CRC-32 of its joined tokens."""
    return (F.crc32(gram) % buckets).cast("int")


def _rest(token: str, n: int) -> Column:
    """A token array from its ``n``-th token on."""
    return F.slice(token, F.lit(n), F.greatest(F.size(token) - (n - 1), F.lit(0)))


def _grams(token: str, order: int) -> Column:
    """The n-grams of a token array: all single tokens, all pairs and so on."""
    out = [F.col(token)]
    for n in range(2, order + 1):
        rest = _rest(token, n)
        out.append(F.zip_with(F.slice(out[-1], F.lit(1), F.size(rest)), rest, _join))
    return F.concat(*out)


def _features(token: str, buckets: int, order: int) -> Column:
    """Feature numbers of a token array, n-gram by n-gram."""
    return F.transform(_grams(token, order), lambda x: _number(x, buckets))


def fit(docs: DataFrame, trusted: Column, buckets: int = BUCKETS, alpha: float = ALPHA, order: int = ORDER,
        text: str = "text") -> DataFrame:
    """``(bucket, weight)`` of the features of the corpus: the log ratio of
    their shares in the trusted documents and in all. At most ``buckets`` rows."""
    # a row for each token and those after it, so that its n-grams are made in columns
    token = [f"t{n}" for n in range(order)]
    rows = docs.select(F.coalesce(trusted, F.lit(False)).alias("good"), _tokens(text).alias("k")) \
        .select("good", F.explode(F.arrays_zip("k", *(_rest("k", n) for n in range(2, order + 1)))).alias("g")) \
        .select("good", "g.*").toDF("good", *token)
    grams = list(accumulate(map(F.col, token), _join))
    counts = staged(rows.select("good", F.explode(F.array(*(_number(g, buckets) for g in grams))).alias("bucket")).where("bucket IS NOT NULL")
                    .groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("good").alias("good")), "feature-counts")
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")).first()
    share = lambda c: F.log((F.col(c) + alpha) / F.lit(float(total[c] + alpha * buckets)))
    return counts.select("bucket", (share("good") - share("raw")).alias("weight"))


def judge(docs: DataFrame, weights: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, order: int = ORDER,
          text: str = "text") -> DataFrame:
    """``docs`` plus the base columns, ``score`` and ``kept``."""
    if buckets > 1 << 16:
        raise ValueError("the weights go to every task: at most 2**16 buckets")
    k, w = fresh(docs, "__k", "__w")
    dense = weights.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(weights), "bucket", "left") \
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("weight", F.lit(0.0)).alias("w")))), lambda x: x["w"]).alias("w"))
    d = with_base(docs, text)
    d = d.select(*keep(d, "score", "kept"), _tokens(text).alias(k)).withColumn(w, dense.scalar())
    # the weights are named once, so Spark reads them in place; named twice, they would be copied into every row
    total = F.aggregate(_grams(k, order), F.lit(0.0), lambda a, x: a + F.get(w, _number(x, buckets)))
    n = sum((F.greatest(F.size(k) - i, F.lit(0)) for i in range(order)), F.lit(0))
    d = d.withColumn("score", F.coalesce(F.try_divide(total, n.cast("double")), F.lit(0.0))).drop(k, w)
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    # a filter on the result would be pushed below and copy each step into the next; it stops at an observation
    return d.observe(f"quality-{uuid.uuid4().hex}", F.count("*").alias("documents"), F.count_if("kept").alias("kept"))


def trusted_flag(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Column]:
    """``docs`` with a mark of the documents that some label calls good
    (quality 1) and none calls toxic, and the column of the mark."""
    good = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(
        F.max("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 AND t = 0") \
        .select("__id", F.lit(True).alias("__trusted"))
    out = docs.join(broadcast_below(good, MAX_IDS), F.col("doc_id") == F.col("__id"), "left")
    return out, F.col("__trusted")


# DuckDB: CRC-32 by table, over the distinct features only
ORACLE = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
         lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, regexp_extract_all(text, '[0-9A-Za-z_\x{80}-\x{10FFFF}]+|[!-/:-@\[-^`{-~]+') AS k,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT r, i, (w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM
          (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1) GROUP BY r),
f AS (SELECT r, unnest(list_concat(k, list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]))) AS g FROM w),
u AS (SELECT DISTINCT g FROM f),
hex AS (SELECT g, list_transform(range(octet_length(encode(g))), lambda i: ('0x' || substr(hex(encode(g)), CAST(2 * i + 1 AS BIGINT), 2))::BIGINT) AS b FROM u),
b AS (SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(t[CAST(xor(c, x) & 255 AS INT) + 1], c >> 8)), 4294967295) % 16384 AS bucket
      FROM hex, tab),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1 AND max(coalesce(toxic, 0)) = 0),
n AS (SELECT bucket, count(*) AS raw, count(*) FILTER (WHERE doc_id IN (FROM good)) AS good FROM f JOIN b USING (g) JOIN d USING (r) GROUP BY bucket),
s AS (SELECT bucket, ln((good + 1) / (sum(good) OVER () + 16384)) - ln((raw + 1) / (sum(raw) OVER () + 16384)) AS weight FROM n),
score AS (SELECT r, avg(weight) AS score FROM f JOIN b USING (g) JOIN s USING (bucket) GROUP BY r)
SELECT doc_id, len(w) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
       CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
       len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
       len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed,
       NOT (len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w)) AND coalesce(score, 0) >= -0.5 AS kept
FROM w LEFT JOIN cov USING (r) LEFT JOIN score USING (r)
"""
