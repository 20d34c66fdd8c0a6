"""Operator 4 (native): URL rules by host-suffix and path-prefix expressions.

Every distinct (host, path) is expanded into its host suffixes times its path
prefixes; an expression's SHA-256 is joined to the rules on a short prefix of
the digest, the full digest confirms, and the longest rule that is left wins.
Only suffixes with as many labels and prefixes of such lengths as some rule
has are made; no other one can match. DataFrame functions only.

Null urls and urls without ``://`` have an empty host and path. Equal urls are
judged once and share the verdict; repeated rows and all other columns stay.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_below, fresh, keep

#: Rules as (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Hex digits of the digest that the join compares.
PREFIX = 8
#: Up to so many rules (some 200 bytes each) are broadcast.
MAX_BROADCAST_RULES = 100_000


def rules_frame(spark: SparkSession, rules) -> DataFrame:
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    if not rows:
        return spark.range(0).select(*(F.lit("").alias(c) for c in ("verdict", "host", "path")))
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased: after the first ``://`` up to ``/ ? #``; path:
    from there up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` (with ``url``; other columns stay) plus host, path, rule and
    verdict. ``rules(verdict, host, path)``: a rule fits its host and all
    subdomains if the path starts with the rule's; the longest (host and path
    together) wins, then the longer host, then block over other verdicts."""
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").distinct()
    shape = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"),
                      F.collect_set(F.length("path")).alias("lengths")).first()
    labels, lengths = shape["labels"] or 0, sorted(shape["lengths"])
    digest = _digest(F.col("host"), F.col("path"))
    keyed = broadcast_below(rules.select(
        digest.alias("r_digest"), F.substring(digest, 1, PREFIX).alias("key"),
        F.concat("host", "path").alias("rule"), F.col("verdict").alias("r_verdict"),
        (F.length("host") + F.length("path")).alias("n"), F.length("host").alias("n_host")), MAX_BROADCAST_RULES)

    host, path = host_and_path(F.col("url"))
    out = keep(pages, "host", "path", "rule", "verdict")
    h, p, b = fresh(pages, "__host", "__path", "__best")
    pages = pages.withColumn(h, host).withColumn(p, path)
    parts = F.split("__host", r"\.")
    n = F.least(F.size(parts), F.lit(labels))
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, -i, i), "."))
    fitting = F.filter(F.array(*[F.lit(x) for x in lengths]), lambda x: x <= F.length("__path"))
    urls = pages.select(F.col(h).alias("__host"), F.col(p).alias("__path")).distinct().where(F.length("__host") > 0)
    if not lengths:
        urls = urls.limit(0)
    hits = urls.select("__host", "__path", F.explode(suffixes).alias("s")) \
        .select("__host", "__path", "s", F.explode(fitting).alias("x")) \
        .withColumn("digest", _digest(F.col("s"), F.substr("__path", F.lit(1), F.col("x")))) \
        .withColumn("key", F.substring("digest", 1, PREFIX)) \
        .join(keyed, "key").where("digest = r_digest")
    best = hits.groupBy(F.col("__host").alias(h), F.col("__path").alias(p)).agg(F.max(F.struct(
        "n", "n_host", (F.col("r_verdict") == "block").alias("blocks"), "rule", "r_verdict")).alias(b))
    return pages.join(best, [h, p], "left").select(
        *out, F.col(h).alias("host"), F.col(p).alias("path"), F.col(f"{b}.rule").alias("rule"),
        F.coalesce(f"{b}.r_verdict", F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                              ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
b AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
      FROM (SELECT DISTINCT host, path FROM p), r
      WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM p LEFT JOIN b ON p.host = b.host AND p.path = b.path
"""
