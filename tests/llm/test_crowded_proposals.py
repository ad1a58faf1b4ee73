"""Links that no node proposes, as it has closer ones that turn out not to be similar."""

import random

import pytest

from stridemill.llm import shingle_join


def shingles(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


@pytest.mark.parametrize("nodes", [3, 1024])
def test_links_beyond_the_closest_are_found(spark, monkeypatch, nodes):
    """Two documents of similarity 0.80, each with eight truncated copies at 0.797 that are closer by their bits, and one proposal a shingle."""
    monkeypatch.setattr(shingle_join, "BLOCK_NODES", nodes)
    rng, docs, pairs = random.Random(4), [], []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(500)]
        a, b = (base + [f"g{g}{c}{i}" for i in range(61)] for c in "ab")
        pairs.append((len(docs), len(docs) + 1))
        docs += [a, b]
        for k in range(8):
            for own in (a, b):
                cut = rng.randint(0, 430)
                docs.append(own[:cut] + own[cut + 106 + k % 3 :])
    sets = [shingles(d) for d in docs]
    root = list(range(len(docs)))
    for v in range(len(docs)):
        for u in range(v):
            if root[u] != root[v] and similar(sets[u], sets[v]):
                low, high = sorted((root[u], root[v]))
                root = [low if r == high else r for r in root]
    assert all(root[a] == root[b] for a, b in pairs)
    monkeypatch.setattr(shingle_join, "_proposed", lambda nodes, radius: nodes.sparkSession.createDataFrame([], "u long, v long"))
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in shingle_join.near_duplicates(df, closest=1).collect()}
    assert [got[k] for k in range(len(docs))] == root
