"""The pipeline stage by stage on the smallest tables."""

from __future__ import annotations

import re


import corpus_pipeline
from loadgrid.llm.common import staged, table

SF = "/root/testdata/sf0.001"


def grams(t):
    w = re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", (t or "").lower())
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    first = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert len(seen["language_id"]) >= 0.98 * len(first)
    kept = list(seen["near_dedup"].items())
    sets = {i: grams(t) for i, t in kept}
    for a in sets:
        for b in sets:
            if a < b:
                assert len(sets[a] & sets[b]) < 0.85 * len(sets[a] | sets[b])
    gone = set(seen["language_id"]) - set(seen["near_dedup"])
    for g in gone:
        assert any(len(grams(first[g]) & sets.get(k, set())) >= 0.6 * len(grams(first[g]) | sets.get(k, set())) for k in sets if k < g)
    items = [grams(r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {i for i, s in sets.items() if any(len(s & x) >= 0.8 * len(x) - 1e-9 for x in items)}
    assert set(seen["decontamination"]) == set(sets) - bad
    assert set(seen["pii"]) == set(seen["decontamination"])
    assert not any(re.search(r"[\w.]+@[\w-]+\.[\w.]+", t) for t in seen["pii"].values())
    unchanged = [i for i, t in seen["pii"].items() if "[" not in t]
    assert all(seen["pii"][i] == first[i] for i in unchanged)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(seen["pii"])


def test_near_dedup_keeps_one_of_each_brute_force_class(spark):
    from test_llm_operators import brute_classes
    docs = staged(corpus_pipeline.identify_language(spark, table(spark, SF, "documents"), SF), "language_id")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {}
    for (i, _), c in zip(rows, brute_classes(rows)):
        kept[c] = min(i, kept.get(c, i))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == sorted(kept.values())


def test_run_equals_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), name)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, out.collect())) == sorted(map(key, docs.collect()))


def test_empty_corpus(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), "none")
    assert docs.count() == 0


def test_odd_rows_and_clashing_columns(spark):
    """Null ids and texts, repeated rows, and columns named like helper columns go through all stages."""
    from pyspark.sql import functions as F
    docs = table(spark, SF, "documents").limit(60)
    text = docs.where("length(text) > 200").orderBy("doc_id").first()["text"]
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    odd = spark.createDataFrame([(None, text + " One more closing line of words here.", "en", None, None), (5000, None, None, None, None), (5001, "", "en", "s", 0),
                                 (None, None, None, None, None)] + [(5002, text[::-1], "en", "s", 9)] * 3, schema)
    docs = staged(docs.unionByName(odd).withColumns({c: F.lit(1) for c in ("__p", "__h", "__doc", "k_id", "h", "n", "rank")}), "odd")
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and {r.doc_id for r in out.collect()} <= ids and out.count() <= docs.count()
        docs = out
    assert docs.where("doc_id IN (5000, 5001)").count() == 0 and docs.where("doc_id = 5002").count() <= 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
