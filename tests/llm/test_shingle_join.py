"""The pipeline's near-duplicate stage against the similarity of all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from stridemill.llm import shingle_join, simhash


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def kept_by_brute_force(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for v in range(len(texts)):
        for u in range(v):
            if root[u] != root[v] and similar(sets[u], sets[v]):
                low, high = sorted((root[u], root[v]))
                root = [low if r == high else r for r in root]
    return {k for k, r in enumerate(root) if r == k}


def edited(seed):
    """Texts with passages cut, appended or replaced and single words changed, of similarities around 0.8, and a line that many share."""
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(40_000)]
    line = " ".join(rng.choice(words) for _ in range(14))
    texts = ["", " ", "one", "One", "two words"]
    for k in range(60):
        own = [rng.choice(words) for _ in range(rng.randint(30, 600))]
        texts.append(" ".join(own))
        part = int(len(own) * rng.uniform(0.02, 0.3))
        more = [rng.choice(words) for _ in range(part)]
        at = rng.randrange(len(own) - part)
        few = own[:]
        for _ in range(max(1, part // 6)):
            few[rng.randrange(len(own))] = "changed"
        texts += [" ".join(x) for x in (own + more, own[part:], own[:at] + more + own[at + part :], few)]
        if k % 3 == 0:
            texts += [f"{line} {' '.join(rng.choice(words) for _ in range(rng.randint(10, 50)))}", f"{texts[-1]} {line}"]
    return texts


def stage(spark, texts):
    docs = spark.createDataFrame([*enumerate(texts), (None, "kept")], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sum(r["doc_id"] is None for r in kept) == 1
    return {r["doc_id"] for r in kept} - {None}


def test_stage_joins_every_pair_of_similarity_0_8(spark):
    texts = edited(1)
    got, want = stage(spark, texts), kept_by_brute_force(texts)
    assert len(want) < len(texts) * 2 / 3
    assert got <= want  # nothing stays that the rule joins


def test_nothing_below_similarity_0_8_goes(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        own = [f"w{rng.randrange(9000)}" for _ in range(300)]
        texts += [" ".join(own), " ".join(own[:225] + [f"v{rng.randrange(9000)}" for _ in range(75)]), " ".join(own[:232])]
        for k in rng.sample(range(300), 10):
            own[k] = "changed"
        texts.append(" ".join(own))
    want = kept_by_brute_force(texts)
    assert stage(spark, texts) == want
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.without_duplicates(docs, radius=5, shingle=5, exact=True).collect()} == want


def test_crowded_shingles_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "WORDS", 1)
    texts = edited(2)[:90]
    assert stage(spark, texts) == kept_by_brute_force(texts)


def test_parity_bits_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(6)
    ruled_out = dissimilar = 0
    for _ in range(1500):
        n = int(rng.integers(1, 900))
        a = set(rng.integers(2**64, size=n, dtype=np.uint64).tolist())
        b = {x for x in a if rng.random() > rng.choice([0.02, 0.1, 0.3])} | set(rng.integers(2**64, size=rng.integers(0, n // 5 + 2), dtype=np.uint64).tolist())
        if not b or not a:
            continue
        least = shingle_join.apart(*(shingle_join.parity(np.array(sorted(s), np.uint64)) for s in (a, b)))
        assert least <= len(a ^ b)
        out = 9 * least > len(a) + len(b)
        assert not (out and similar(a, b))
        dissimilar += not similar(a, b)
        ruled_out += out
    assert ruled_out > 0.5 * dissimilar > 100


def test_groups_propose_what_bits_allow():
    rng = np.random.default_rng(7)
    base = rng.integers(2**64, size=300, dtype=np.uint64)
    sets = [np.unique(np.append(rng.choice(base, int(rng.integers(120, 300)), replace=False), rng.integers(2**64, size=rng.integers(0, 40), dtype=np.uint64))) for _ in range(80)]
    n, bits, component = np.array([len(s) for s in sets]), [shingle_join.parity(s) for s in sets], rng.integers(3, size=80) * (rng.random(80) > 0.5)
    want = {
        (a, b) for b in range(80) for a in range(b)
        if component[a] != component[b] and 9 * shingle_join.apart(bits[a], bits[b]) <= n[a] + n[b] and 5 * min(n[a], n[b]) >= 4 * max(n[a], n[b])
    }
    group = shingle_join._Group(np.arange(80), n, component, bits)
    told = lambda closest: [x for u, v in group.pairs(closest) for x in zip(u.tolist(), v.tolist(), strict=True)]
    assert set(told(None)) == want and len(want) > 10
    bulk = np.bincount(component).argmax()
    assert set(told(2)) <= want and {x for p in want for x in p if component[x] != bulk} <= {x for p in told(2) for x in p} and len(told(2)) <= 3 * 2 * 80


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(5)
    frequent = np.sort(rng.integers(2**32, size=40).astype(np.uint64))
    rank = rng.integers(5, size=40)
    for _ in range(2000):
        n = int(rng.integers(1, 60))
        a = set(rng.choice(frequent, rng.integers(0, min(n, 40) + 1), replace=False).tolist()) | set(rng.integers(2**32, size=n).tolist())
        b = {x for x in a if rng.random() > 0.12} | set(rng.integers(2**32, size=rng.integers(0, 4)).tolist())
        if b and similar(a, b):
            first = [set(shingle_join.prefix(np.array(sorted(s), np.uint64), frequent, rank).tolist()) for s in (a, b)]
            assert first[0] & first[1]


def test_no_documents(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").filter(F.lit(False))
    assert corpus_pipeline.drop_near_duplicates(spark, docs, "").count() == 0


def test_pairs_at_the_edge_among_closer_dissimilar_copies(spark):
    """Two documents of similarity 0.80, each with eight truncated copies at 0.797 that are closer by their bits: found with three proposals by each shingle, and with all."""
    rng, docs, pairs = random.Random(4), [], []
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(500)]
        a, b = (base + [f"g{g}{c}{i}" for i in range(61)] for c in "ab")
        pairs.append((len(docs), len(docs) + 1))
        docs += [a, b]
        for k in range(8):
            for own in (a, b):
                cut = rng.randint(0, 430)
                docs.append(own[:cut] + own[cut + 106 + k % 3 :])
    sets = [shingles(" ".join(t)) for t in docs]
    assert all(similar(sets[a], sets[b]) for a, b in pairs) and not similar(sets[0], sets[2]) and not similar(sets[1], sets[3])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    for closest in (shingle_join.CLOSEST, None):
        component = {r["doc_id"]: r["component_id"] for r in shingle_join.near_duplicates(df, closest=closest).collect()}
        assert all(component[a] == component[b] for a, b in pairs)
