"""Operator 2: language ID by nearest centroid with rejection by distance.

A text's letters, lower-cased, with one space for everything else, give
character 1- to 3-grams, hashed to ``DIM`` bins and weighted
(1 + ln tf) * idf, at unit length. Document frequencies run over all training
documents (one Spark aggregation). Centroids come from a bounded sample:
about ``SAMPLE`` training documents of each language (a language's n documents
give those whose hash is in the first SAMPLE / n of its range, so no language
is sorted in one task); spherical k-means gives ``CLUSTERS`` centroids per
language. A
text gets the language of the centroid with the highest cosine.

Short texts are farther from any centroid, so the rejection distance depends
on length: sample texts are cut to 2, 4, 8 ... letters, and a text is
rejected below ``RATIO`` times the 1 % quantile of the cosines that cuts of
its length have with their own language.

Null texts and texts without a letter are ``und``, score 0, and rejected; so
is every text if nothing could be learned. Rows without an id are predicted,
but not learned from. Repeated rows and other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_below, fresh, keep, prepare, texts_of
from .textkernels import chunks

DIM, SAMPLE, CLUSTERS, RATIO, ITERATIONS = 4096, 1000, 4, 0.25, 12
UNKNOWN = "und"
#: Up to so many languages' counts are broadcast.
MAX_LANGUAGES, _HASHES = 10_000, 1 << 40
_CHUNK = 1 << 19
_CUTS = [1 << b for b in range(1, 13)]


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)


def _codes(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters with single spaces between words, a space after
    each text, and each text's first index."""
    parts = [t.lower() for t in texts]
    buf = np.frombuffer(("".join(p + " " for p in parts)).encode("utf-32-le", "surrogatepass"), "<u4")
    first = np.cumsum([0] + [len(p) + 1 for p in parts])
    letter = (buf >= 0x10000) | letters[np.minimum(buf, 0xFFFF)]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[first[1:] - 1] = True
    codes = np.where(letter, buf, 32)[keep].astype(np.uint32)
    return codes, np.concatenate([[0], np.cumsum(keep)])[first]


def gram_counts(codes: np.ndarray, first: np.ndarray, dim: int) -> np.ndarray:
    """Counts (texts x dim) of hashed 1- to 3-grams; a text is taken to follow a space."""
    texts = len(first) - 1
    owner = np.repeat(np.arange(texts), np.diff(first))
    c0 = codes
    begin = np.zeros(len(codes), bool)
    begin[first[:-1][np.diff(first) > 0]] = True
    c1 = np.r_[np.uint32(32), codes[:-1]] if len(codes) else codes
    c1[begin] = 32
    c2 = np.r_[np.uint32(32), c1[:-1]] if len(codes) else codes
    c2[begin] = 32
    shift = np.uint32(32 - (dim - 1).bit_length())
    total = np.zeros(texts * dim, np.int64)
    base = owner * dim
    h = c0 * np.uint32(0x9E3779B1)
    for c, k in ((None, 0), (c1, 0x85EBCA77), (c2, 0xC2B2AE3D)):
        if c is not None:
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F) + c * np.uint32(k)
        x = (h ^ (h >> np.uint32(13))) * np.uint32(0x9E3779B1)
        total += np.bincount(base + (x >> shift).astype(np.int64), minlength=texts * dim)
    return total.reshape(texts, dim)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (np.log1p(np.maximum(counts - 1, 0)) + (counts > 0)) * idf
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def k_means(x: np.ndarray, k: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Spherical k-means from farthest-first starts."""
    centres = [x.mean(axis=0)]
    far = int(np.argmin(x @ centres[0]))
    centres = [x[far]]
    near = x @ x[far]
    for _ in range(min(k, len(x)) - 1):
        far = int(np.argmin(near))
        centres.append(x[far])
        near = np.maximum(near, x @ x[far])
    c = np.array(centres)
    for _ in range(iterations):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _frequencies(dim: int):
    def run(batches):
        letters, df, docs = _letters(), np.zeros(dim, np.int64), 0
        for b in batches:
            texts = texts_of(b.column(0))
            for i, j in chunks([len(t) for t in texts], _CHUNK):
                df += (gram_counts(*_codes(texts[i:j], letters), dim) > 0).sum(axis=0)
                docs += j - i
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dim)), pa.array(np.r_[docs, df])], names=["bin", "n"])
    return run


def _fit_language(idf: np.ndarray, dim: int, clusters: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        letters = _letters()
        texts = pdf.sort_values(["h", "text"])["text"].tolist()
        x = np.concatenate([vectors(gram_counts(*_codes(texts[i:j], letters), dim), idf)
                            for i, j in chunks([len(t) for t in texts], _CHUNK)])
        c = k_means(x, clusters)
        sims = np.full((len(texts), len(_CUTS)), np.nan)
        for b, n in enumerate(_CUTS):
            cut = [t[: 2 * n] for t in texts]      # about n letters and what is between them
            codes, first = _codes(cut, letters)
            sims[:, b] = (vectors(gram_counts(codes, first, dim), idf) @ c.T).max(axis=1)
        floor = np.quantile(sims, 0.01, axis=0)
        lang = pdf["lang"].iloc[0]
        return pd.DataFrame({"lang": lang, "centre": [v.astype("<f8").tobytes() for v in c],
                             "floor": [floor.astype("<f8").tobytes()] * len(c)})
    return run


class Model:
    """Centroids, idf and rejection floors; their size depends on the
    parameters and the number of languages only."""

    def __init__(self, langs, centres, idf, floors, ratio):
        self.langs, self.centres, self.idf, self.floors, self.ratio = langs, centres, idf, floors, ratio

    def predict(self, texts: list[str], letters: np.ndarray):
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        codes, first = _codes(texts, letters)
        sims = vectors(gram_counts(codes, first, len(self.idf)), self.idf) @ self.centres.T
        best = np.argmax(sims, axis=1)
        score = np.clip(sims[np.arange(len(texts)), best], 0, 1)
        size = np.clip(np.log2(np.maximum(np.diff(first), 2)).astype(int) - 1, 0, len(_CUTS) - 1)
        return [self.langs[k] for k in best], score, score < self.ratio * self.floors[best, size]


def train(docs: DataFrame, dim: int = DIM, sample: int = SAMPLE, clusters: int = CLUSTERS, ratio: float = RATIO) -> Model:
    """Learn from ``docs(doc_id, text, lang)``; rows without text or lang are left out."""
    prepare(docs.sparkSession)
    docs = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(F.col("text").rlike(r"\p{L}")) \
        .select("doc_id", "text", "lang")
    counts = docs.select("text").mapInArrow(_frequencies(dim), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    got = {r["bin"]: r["n"] for r in counts.collect()}         # dim + 1 rows
    total = got.get(-1, 0)
    idf = np.log((1 + total) / (1 + np.array([got.get(i, 0) for i in range(dim)]))) + 0.1
    sizes = broadcast_below(docs.groupBy("lang").agg(F.count("*").alias("n")), MAX_LANGUAGES)
    h = F.xxhash64("doc_id", "text")
    chosen = docs.join(sizes, "lang").withColumn("h", h).where(F.pmod("h", F.lit(_HASHES)) < F.lit(float(_HASHES * sample)) / F.col("n"))
    fitted = chosen.groupBy("lang").applyInPandas(
        _fit_language(idf, dim, clusters), "lang string, centre binary, floor binary").collect()   # clusters per language
    fitted.sort(key=lambda r: (r["lang"], r["centre"]))
    load = lambda c: np.array([np.frombuffer(r[c], "<f8") for r in fitted])
    return Model([r["lang"] for r in fitted], load("centre"), idf, load("floor"), ratio)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (with ``text``) plus lang_pred, score and rejected."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, letters = Model(**shared.value), _letters()
        for series in batches:
            texts, out = [t or "" for t in series], [pd.DataFrame({"lang": [], "score": [], "rejected": []})]
            for i, j in chunks([len(t) for t in texts], _CHUNK):
                lang, score, rejected = m.predict(texts[i:j], letters)
                out.append(pd.DataFrame({"lang": lang, "score": score, "rejected": rejected}))
            yield pd.concat(out[1:] or out, ignore_index=True)

    udf = F.pandas_udf(run, "lang string, score double, rejected boolean")
    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    (p,) = fresh(docs, "__p")
    return docs.withColumn(p, udf(F.col("text"))).select(
        *keep(docs, "lang_pred", "score", "rejected"), F.when(known, F.col(f"{p}.lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, F.col(f"{p}.score")).otherwise(0.0).alias("score"), (~known | F.col(f"{p}.rejected")).alias("rejected"))


def remainder(doc_id: Column, by: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(by))


def train_split(docs: DataFrame, by: int = 4, held: int = 2) -> tuple[DataFrame, Column]:
    """The training rows and the held-out flag (false without an id)."""
    return docs.where(remainder(F.col("doc_id"), by) != held), F.coalesce(remainder(F.col("doc_id"), by) == held, F.lit(False))
