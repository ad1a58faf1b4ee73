"""Thresholds and trees come from all labelled rows, however many."""

import random

import numpy as np

from stridemill.llm import quality_forest


def test_many_labels_are_learned_from_where_they_are(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(500)}" + "#" * (rng.random() < (0.3 if k % 5 == 0 else 0.03)) for _ in range(60)) for k in range(600)]
    docs = spark.createDataFrame([*enumerate(texts), (7, "w " * 3)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 5 != 0)) for k in range(600)] + [(3, 2)], "doc_id long, quality int")
    seen, learned = [], quality_forest.learned
    monkeypatch.setattr(quality_forest, "learned", lambda c, bad, *a, **b: seen.append(len(c)) or learned(c, bad, *a, **b))
    one = quality_forest.fit(docs, labels, trees=10, size=64)
    monkeypatch.setattr(quality_forest, "GATHERED", 100)
    other = quality_forest.fit(docs, labels, trees=10, size=64)
    assert len(seen) == 1 and seen[0] >= 599 and len(one.groups) == len(other.groups) == 5
    for (a, own, t), (b, same, u) in zip(one.groups, other.groups, strict=True):
        assert own == same and abs(t - u) < 1e-12 and np.array_equal(a.split, b.split) and np.array_equal(a.path, b.path)
    assert min(t for *_, t in one.groups) < 1
