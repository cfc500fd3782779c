"""The pipeline's near-copy stage against all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
from lodestone.llm import near_copies

from test_operators import brute_fp


def jaccard(a: str, b: str) -> float:
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_edited_copies_go_as_all_pairs_say(spark):
    rnd = random.Random(12)
    fresh = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    texts = []
    for size in (30, 120, 400):
        base = fresh(size)
        texts.append(" ".join(base))
        for share in (0.002, 0.005, 0.01, 0.015, 0.02, 0.03, 0.05) * 6:
            copy = list(base)
            for at in rnd.sample(range(size), max(1, round(size * share))):
                copy[at] = "x"
            texts.append(" ".join(copy))
    texts += [" ".join(fresh(60)) for _ in range(40)] + [" ".join(fresh(3)), texts[0].upper(), texts[5]]
    n, fps = len(texts), [brute_fp(t) for t in texts]
    pairs = [(i, j) for i in range(n) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8 or (fps[i] ^ fps[j]).bit_count() <= 3]
    assert sum((fps[i] ^ fps[j]).bit_count() > 3 for i, j in pairs) > 100
    want = list(range(n))
    for _ in range(n):
        for i, j in pairs:
            want[i] = want[j] = min(want[i], want[j])
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    extra = [(None, texts[0], "en", "a", 1), (None, None, None, None, None), (n, "", None, None, 0), (n + 1, " \n", None, None, 2)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect() if r["doc_id"] is not None)
    assert got == sorted(set(want)) + [n]
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0
