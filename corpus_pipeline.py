"""Training-corpus pipeline over ``documents``.

Stages, in order: language ID (rejected documents go), near-dedup (one
document of each group stays), benchmark decontamination (documents that
contain an item go), PII (spans become ``[KIND]``, all documents stay),
best-fit packing (one row per piece). Each takes (spark, docs, sf_dir), works
on all rows of its predecessor, and all but the last return the columns of
documents; null or empty texts are rejected by the first stage. ``run``
writes every stage's result as Parquet in the shared checkpoint folder and
rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loadgrid.llm import best_fit_packing, decontamination, language_id, minhash_dedup, pii
from loadgrid.llm.common import prepare, staged, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs)
    return language_id.predict(docs, model).where("NOT rejected").select(*[f"`{c}`" for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack_documents(docs)


STAGES = [("language_id", identify_language), ("near_dedup", near_dedup), ("decontamination", decontaminate),
          ("pii", remove_pii), ("packing", pack)]

#: None: the trained stages have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(prepare(spark), docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
