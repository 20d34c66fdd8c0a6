"""What the tagger of operator 8 adds to the patterns, on texts that it was not
trained on: forms that the patterns miss must be found, and plain texts left."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loadgrid.llm import pii
from loadgrid.llm.common import prepare

SF = "/root/testdata/sf0.1"


def test_added_spans_of_unseen_forms(spark):
    prepare(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    model = pii.train(docs.where(fold != 0))
    held = [r["text"] for r in docs.where((fold == 0) & F.col("text").rlike("[0-9@]")).select("text", "doc_id").collect()]
    rng, there, found, added, right, plain = np.random.default_rng(5), Counter(), Counter(), Counter(), Counter(), 0
    for text in held:
        base = pii.base_spans(text)
        plain += len(pii.added_spans([text], [base], model)[0])
        for s, kind, _ in base[:6]:
            a = max(0, s - 60)
            window = text[a: a + pii.WINDOW]
            inside = [(x - a, k, y - a) for x, k, y in base if x >= a and y <= a + len(window)]
            forms = list(pii._variants(window, inside, rng)) if kind >= 2 else []
            if len(forms) < 2:
                continue
            changed, spans = forms[1]
            by_pattern = pii.base_spans(changed)
            got = pii.added_spans([changed], [by_pattern], model)[0]
            for x, k, y in spans:
                if k >= 2 and not any(b < y and x < e for b, _, e in by_pattern):
                    there[k] += 1
                    found[k] += any(g[1] == k and abs(g[0] - x) <= 1 and abs(g[2] - y) <= 1 for g in got)
            for x, k, y in got:
                added[k] += 1
                right[k] += any(x < e and b < y for b, _, e in spans)
    for k in (2, 3):                   # cards, phones
        assert there[k] >= 15 and found[k] >= 0.9 * there[k], (k, there, found)
        assert right[k] >= 0.9 * added[k], (k, added, right)
    assert plain <= 0.03 * len(held)


def test_posteriors_are_shares_of_all_paths():
    p = pii._init(np.random.default_rng(3))
    ids = np.random.default_rng(4).integers(1, 100, (2, 3))
    total = sum(pii.posteriors(p, ids, np.array([[t, 0, 0], [t, 0, 0]], np.int8))[:, 0] for t in range(pii.TAGS))
    assert np.allclose(total, 1.0)


def test_national_numbers_need_a_sure_tagger():
    assert not pii.plausible(3, "612 345 678") and pii.plausible(3, "612 345 678", 0.95)
    assert not pii.plausible(3, "12 34", 1.0) and not pii.plausible(3, "612x345678", 1.0)
    assert pii.plausible(3, "+1 (372) 555-7739")
