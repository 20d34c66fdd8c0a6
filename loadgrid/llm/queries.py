"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit_packing, decontamination, exact_topk, language_id, lm_scoring, minhash_dedup, pii, prefix_trie, quality_rules, structure_repair, suffix_dedup, token_output, url_filters
from .common import prepare, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train, held_out = language_id.train_split(docs)
    model = language_id.train(train)
    return language_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return best_fit_packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judge(pages, url_filters.rules_frame(spark, url_filters.RULES)).drop("url")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return minhash_dedup.classes(table(spark, sf_dir, "documents"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return token_output.packed_matrices(table(spark, sf_dir, "documents"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = exact_topk.quantised(table(spark, sf_dir, "embeddings"))
    return exact_topk.top_k(vectors, F.col("vec_id") % 50 == 0)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.train(docs))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lm_scoring.remainder(F.col("doc_id"), 7)
    held_out = F.coalesce(left == 2, F.lit(False))
    return lm_scoring.score(table(spark, sf_dir, "documents"), held_out, F.coalesce(left != 2, F.lit(False)))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")) \
        .drop("doc_h", "item_h").distinct()


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.turns_of(table(spark, sf_dir, "conversations"))))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality_rules.fit(*quality_rules.trusted_flag(docs, table(spark, sf_dir, "labels")))
    return quality_rules.judge(docs, weights).drop("text", "score")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows, plan, turns = structure_repair.repair(structure_repair.damaged(conversations))
    return structure_repair.summary(conversations, rows, plan, structure_repair.digests(turns))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_language_id, op3_best_fit_packing, op4_url_filters, op5_minhash_dedup,
                                   op6_token_output, op7_exact_topk, op8_pii, op9_lm_scoring, op10_decontamination, op11_prefix_trie, op12_quality_rules,
                                   op13_structure_repair)}
ORACLE = {"op1_suffix_dedup": suffix_dedup.ORACLE, "op4_url_filters": url_filters.ORACLE, "op7_exact_topk": exact_topk.ORACLE,
          "op10_decontamination": decontamination.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE, "op12_quality_rules": quality_rules.ORACLE, "op13_structure_repair": structure_repair.ORACLE}
