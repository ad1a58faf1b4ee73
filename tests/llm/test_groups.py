"""Operators that compare rows, each against brute force, and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from stridemill.llm import components, mixing, queries, secret_scan, simhash, suffix_dedup, threshold_topk, toxicity, warc_derivatives

ODD = [None, "", " ", "a", "one two", "One  two", "x" * 250_000, "word " * 40_000, "é" * 300, "日本" * 100, "퟿\U0001f600" * 80]


def frame(spark, rows, extra=True):
    if extra:
        return spark.createDataFrame([(*r, "x", 1, [2], "y") for r in rows], "doc_id long, text string, id string, node int, spans array<int>, wide string")
    return spark.createDataFrame(rows, "doc_id long, text string")


def copies(seed, n=60):
    """Texts with exact and edited copies and shared passages."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3 or not texts:
            own = [rng.choice(words) for _ in range(rng.randint(1, 400))]
        else:
            own = rng.choice(texts).split() or ["z"]
            for _ in range(0 if kind < 0.5 else rng.randint(1, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
        text = " ".join(own)
        texts.append(f"{text} {passage}" if kind > 0.8 else text)
    return texts


# SimHash


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}
    for a, b in linked:
        old, new = max(root[a], root[b]), min(root[a], root[b])
        if old != new:
            root = {n: new if r == old else r for n, r in root.items()}
    return root


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(1)
    for radius in (1, 2, 3, 4):
        masks = [m % 2**64 for m in simhash.masks(radius)]
        assert len(masks) == 2 ** (radius + 1) - 1 and all(m.bit_count() == 32 for m in masks)
        for _ in range(3000):
            differ = sum(1 << k for k in rng.sample(range(64), radius))
            assert any(not differ & m for m in masks)


def test_fingerprints():
    for text in [*(t or "" for t in ODD if t is None or len(t) < 1000), *copies(1, 20), "A\x0bB\x85C Ä ä", "word " * 2000]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_near_duplicates_against_all_pairs(spark):
    texts = [*ODD, *copies(2), *copies(3)]
    rows = [(7 * k % 1000, t) for k, t in enumerate(texts)] + [(None, "no id"), (7, "")]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows) - 1
    fp = [(i, simhash.fingerprint(t or "")) for i, t in rows if i is not None]
    links = [(a, b) for k, (a, x) in enumerate(fp) for b, y in fp[:k] if (x ^ y).bit_count() <= 4]
    want = plain_components({i for i, _ in fp}, links)
    assert {(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got} == {(i, x, want[i]) for i, x in fp}
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_large_buckets_link_as_small_ones_do():
    rng = np.random.default_rng(3)
    fp = rng.integers(2**10, size=300).astype(np.uint64) << np.uint64(20)
    node = np.arange(300)
    u, v = simhash._bucket_edges(np.array([0]), np.array([300]), fp, node, 1)
    pairs = [(a, b) for a in range(300) for b in range(a) if int(fp[a] ^ fp[b]).bit_count() <= 1]
    want = plain_components(range(300), pairs)
    assert plain_components(range(300), zip(u.tolist(), v.tolist(), strict=True)) == want


def test_word_fingerprints_find_edited_copies_and_leave_others(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(5000)]
    texts = []
    for _ in range(20):
        own = [rng.choice(words) for _ in range(300)]
        texts.append(" ".join(own))
        own[rng.randrange(300)] = "changed"
        texts.append(" ".join(own))
    docs = frame(spark, [*enumerate(texts), (None, "kept"), (3, texts[3])])
    kept = simhash.without_duplicates(docs, radius=5, shingle=5, exact=True)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {*range(0, 40, 2), None} <= set(ids) and len(ids) == len(set(ids)) == 21


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(5, k) for k in range(200, 260)] + [(9, 9), (259, 300), (300, 259)]
    got = {(r[0], r[1]) for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(k, 100) for k in range(101, 141)} | {(k, 5) for k in range(200, 260)} | {(300, 5)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# Suffix dedup


def plain_dedup(texts, width=100):
    seen, out = set(), {}
    for i, t in texts:
        raw = (t or "").encode()
        cover = np.zeros(len(raw) + 2, np.int8)
        for p in range(len(raw) - width + 1):
            s = raw[p : p + width]
            if s in seen:
                cover[p + 1 : p + 1 + width] = 1
            seen.add(s)
        kept = bytes(b for b, c in zip(raw, cover[1:-1], strict=True) if not c)
        out[i] = (len(raw), int(cover.sum()), int((np.diff(cover) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_against_brute_force(spark):
    texts = [*copies(5), "ab" * 400, "a" * 99, "a" * 100, "a" * 101, "ba" * 300, "日本語" * 60, "日本語" * 61, None, "", "q" * 30_000]
    random.Random(1).shuffle(texts)
    rows = list(enumerate(texts))
    docs = frame(spark, rows + [(None, "z" * 200)]).repartition(6)
    want = plain_dedup(rows)
    for most in (20_000, 3, 0):  # none, some and all of the border runs are crowded
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.deduplicate(docs, most=most).collect()}
        assert got == want
    assert suffix_dedup.deduplicate(docs.limit(0)).count() == 0


def test_suffix_dedup_never_goes_by_a_polynomial_hash(spark):
    """Two texts without a common string of 100 bytes that polynomials modulo 2 ** 64 can't tell apart, whatever their base."""
    rng = random.Random(11)
    gram = "the same thirty-two byte string!"
    marks = [f"{k:05d}" + "".join(rng.choice("bcdefg") for _ in range(31)) for k in range(1024)]
    texts = ["".join(f"{gram}{m}{'xy'[(k.bit_count() + flip) % 2]}" for k, m in enumerate(marks)) for flip in (0, 1)]
    a, b = (suffix_dedup.PrefixHash(np.frombuffer(t.encode(), np.uint8)) for t in texts)
    size = len(texts[0])
    assert a(np.array([0]), size) == b(np.array([0]), size)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.deduplicate(frame(spark, list(enumerate(texts)))).collect()}
    assert got == plain_dedup(list(enumerate(texts))) and all(v[1] == 0 for v in got.values())


def test_suffix_dedup_of_long_periods(spark):
    """Rules and paddings of a megabyte: all but the first is a repeat, and none is sorted."""
    ten = [f"head {k} of ten {'-' * (1_000_000 + 13 * k)} tail {k}" for k in range(10)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.deduplicate(frame(spark, list(enumerate(ten)))).collect()}
    assert got == plain_dedup(list(enumerate(ten)))
    small = [f"{k} {'-=' * (150 + k)} {'abc' * 90}{k}" for k in range(6)] + ["=" * 301, "--" * 99, "x" + "=-" * 120]
    rows = list(enumerate(small))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.deduplicate(frame(spark, rows)).collect()}
    assert got == plain_dedup(rows)


def test_one_line_with_varying_surroundings_is_dealt_out(spark):
    """No step gives a task one row for each document, though all share a line."""
    rng = random.Random(12)
    line = "a line of well over one hundred bytes that every document has somewhere between surroundings that nothing else has, " * 2
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    texts = [word(rng.randint(80, 160)) + line + word(rng.randint(80, 160)) for _ in range(400)]
    rows = list(enumerate(texts))
    docs = frame(spark, rows).repartition(8)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.deduplicate(docs, most=500).collect()}
    assert got == plain_dedup(rows)
    made = docs.select("doc_id", "text").mapInArrow(suffix_dedup._run_batches(100), suffix_dedup._RUN_SCHEMA)
    most = made.groupBy("deal").count().agg(F.max("count")).first()[0]
    assert most <= 2 * 8  # a row and a mark from each batch


def test_suffix_dedup_of_repeated_rows(spark):
    long, other = "row " * 60, "another text " * 20
    rows = [(1, long), (1, long), (2, long), (3, other), (3, long)]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.deduplicate(frame(spark, rows)).collect())
    digest = {t: hashlib.sha256(t.encode()).hexdigest() for t in (long, other)}
    third = min((long, other), key=digest.get)
    want = plain_dedup([(1, long), (2, long), (3, third)])
    again = [(3, len(t), want[3][1] if t == third else 0) for t in (long, other)]
    assert got == sorted([(1, *want[1][:2])] * 2 + [(2, *want[2][:2])] + again)


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefgh "])
def test_chunks_and_batches_do_not_matter(alphabet, monkeypatch):
    rng = random.Random(6)
    data = "".join(rng.choice(alphabet) for _ in range(3000)).encode()
    bounds = np.array([0, 500, 550, 1700, 3000])

    def windows(chunk):
        monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
        out = {}
        for text, lo, n, key, _ in suffix_dedup.runs(np.frombuffer(data, np.uint8), bounds, 100):
            for t, a, m, k in zip(text.tolist(), lo.tolist(), np.abs(n).tolist(), key.tolist(), strict=True):
                out |= {(t, p): k for p in range(a, a + m)}
        return out

    assert windows(700) == windows(10_000)
    assert set(windows(700)) == {(t, p) for t in range(4) for p in range(bounds[t + 1] - bounds[t] - 99)}


def test_suffix_sort_is_a_sort():
    rng = np.random.default_rng(7)
    data = rng.integers(97, 100, size=4000).astype(np.uint8)
    start = rng.permutation(3800)[:700]
    group = np.sort(rng.integers(5, size=700))
    order = suffix_dedup.suffix_sort(data, suffix_dedup.PrefixHash(data), start, group, 100)
    key = lambda k: (group[k], data[start[k] : start[k] + 100].tobytes())
    assert [key(k) for k in order] == sorted(key(k) for k in range(700))


# Top-k


def test_top_k_against_all_scores(spark):
    rng = np.random.default_rng(8)
    rows = [(int(k), [float(x) for x in rng.normal(size=6)]) for k in range(300)]
    rows += [(300 + k, [1.0, 1.0, 0.0, 0.0, 0.0, 0.0]) for k in range(60)]  # ties
    rows += [(400, [1.0, 2.0]), (450, [0.5, -2.0]), (500, None), (501, []), (502, [1.0, None] + [0.0] * 4), (503, [math.nan] * 6), (504, [math.inf] * 6), (None, [1.0] * 6), (505, [3e38] * 6), (550, [0.0] * 6)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, id int, score string")
    v = threshold_topk.quantised(table)
    ok = [(i, [math.floor(256 * float(np.float32(c))) for c in x]) for i, x in rows if i is not None and x and all(c is not None and math.isfinite(c) and abs(c) < 1e30 for c in x)]
    assert {(r["id"], tuple(r["x"])) for r in v.collect()} == {(i, tuple(x)) for i, x in ok}
    want = set()
    for i, q in ok:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in ok if j != i and len(x) == len(q))
            want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:5])}
    for block in (16_384, 40):
        got = threshold_topk.top_k(v, v.filter("id % 50 = 0"), 5, block=block, query_block=3)
        assert {tuple(r) for r in got.collect()} == want
    assert threshold_topk.top_k(v.limit(0), v.limit(0), 5).count() == 0
    told = threshold_topk.report(v.filter("size(x) = 6"), v.filter("id % 50 = 0 AND size(x) = 6"), 5).collect()
    assert len(told) == sum(i % 50 == 0 and len(x) == 6 for i, x in ok) and all(0 < r["scored"] <= r["candidates"] == sum(len(x) == 6 for _, x in ok) for r in told)


def test_lists_are_left_early_where_the_bound_allows():
    rng = np.random.default_rng(9)
    x = rng.integers(-50, 50, size=(5000, 3))
    x[:8] += 4000
    block = threshold_topk.Block(np.arange(5000), x)
    read = []
    scores = block.scores
    block.scores = lambda rows, q, products: (read.append(len(rows)), scores(rows, q, products))[1]
    ids, _, scored = block.top_k(-1, np.array([3, 2, 5]), 5)
    assert set(ids.tolist()) <= set(range(8)) and sum(read) == scored < 500


def test_large_components_stay_exact():
    big = 2**61
    block = threshold_topk.Block(np.array([1, 2, 3]), np.array([[big, 1], [big, 2], [5, 5]]))
    ids, score, _ = block.top_k(3, np.array([4, 1]), 2)
    assert ids.tolist() == [2, 1] and list(score) == [4 * big + 2, 4 * big + 1]


# Mixing


def test_rake_meets_the_marginals():
    rng = np.random.default_rng(10)
    tokens = rng.integers(1000, 2000, size=24).astype(float)
    codes = np.stack(np.unravel_index(np.arange(24), (4, 3, 2)))
    goals = [np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4])]
    kept = mixing.rake(tokens, codes, goals, 0.2, 200, 1e-12)
    for code, goal in zip(codes, goals, strict=True):
        assert np.allclose(np.bincount(code, kept) / kept.sum(), goal, atol=1e-8)
    assert (kept <= tokens).all() and abs(kept.sum() - 0.2 * tokens.sum()) < 1e-6
    assert np.allclose(mixing.shares(np.array([6.0, 3.0, 1.0]), ["a", "b", "c"], {"a": 0.2, "d": 0.5}), [0.2, 0.6, 0.2])
    assert np.allclose(mixing.shares(np.array([4.0, 1.0]), ["a", "b"], 0.5), [2 / 3, 1 / 3])


def mixed(spark):
    rng = random.Random(11)
    rows = [(k, rng.choice(["s1", "s1", "s2", None]), rng.choice(["en", "de", None]), rng.choice(["a house", "garden | y", "mountain a b", None, "wallpaper\nwallpaper " * 9]), 3) for k in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, probability int")


def test_driver_and_table_raking_agree(spark):
    rows = mixing.keyed(mixed(spark), mixing.word_topic(F.col("text")))
    targets = {"lang": {"en": 0.6, "xx": 0.1}, "source": 0.5, "topic": 0.7}
    one, small = mixing.cell_probabilities(rows, targets, 0.3, sweeps=4)
    two, large = mixing.cell_probabilities(rows, targets, 0.3, sweeps=4, driver_cells=0)
    assert (small, large) == (True, False)
    key = lambda df: {tuple(r)[:3]: r[3] for r in df.collect()}
    a, b = key(one), key(two)
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    said = lambda df: {tuple(r)[:3]: tuple(r)[4:] for r in df.collect()}
    a, b = said(one), said(two.select(one.columns))
    assert all(np.allclose(a[k], b[k], atol=2e-6) for k in a)


def test_shares_that_tokens_cannot_fill_are_projected():
    goal = mixing.feasible(np.array([0.5, 0.3, 0.2]), np.array([10.0, 60.0, 30.0]), 0.5)
    assert np.allclose(goal, [0.2, 0.48, 0.32])
    assert np.allclose(mixing.feasible(np.array([0.9, 0.1, 0.0]), np.array([10.0, 10.0, 80.0]), 0.5), [0.2, 0.2, 0.0])
    assert np.allclose(mixing.feasible(np.array([0.5, 0.5]), np.array([50.0, 50.0]), 0.9), [0.5, 0.5])


def plain_mix(rows, targets, budget):
    """Raking by dictionaries: (source, lang, topic) -> probability, and (dimension, value) -> share reached."""
    cells = Counter()
    for cell, n in rows:
        cells[cell] += n
    total, kept, goals = sum(cells.values()), {c: budget * n for c, n in cells.items()}, []
    for k, d in enumerate(mixing.DIMENSIONS):
        have = Counter()
        for c, n in cells.items():
            have[c[k]] += n
        target = targets[d]
        if isinstance(target, dict):
            rest = sum(n for v, n in have.items() if v not in target)
            left = max(0.0, 1 - sum(x for v, x in target.items() if v in have))
            goal = {v: target[v] if v in target else left * n / rest for v, n in have.items()}
        else:
            goal = {v: n**target for v, n in have.items()}
        goal = {v: x / sum(goal.values()) for v, x in goal.items()}
        full = set()
        while over := {v for v, x in goal.items() if v not in full and x > have[v] / (budget * total) + 1e-15}:
            full |= over
            scale = (1 - sum(have[v] / (budget * total) for v in full)) / sum(x for v, x in goal.items() if v not in full)
            goal = {v: have[v] / (budget * total) if v in full else x * scale for v, x in goal.items()}
        goals.append(goal)
    for _ in range(100):
        for k, goal in enumerate(goals):
            now = Counter()
            for c, x in kept.items():
                now[c[k]] += x
            kept = {c: min(cells[c], x * (goal[c[k]] * budget * total / now[c[k]] if now[c[k]] > 0 else 1)) for c, x in kept.items()}
    reached = Counter()
    for c, x in kept.items():
        for d, v in zip(mixing.DIMENSIONS, c, strict=True):
            reached[d, v] += x / sum(kept.values())
    return {c: kept[c] / n if n else budget for c, n in cells.items()}, reached, goals


def leading_topic(text):
    count = Counter(w for w in re.findall(r"[^ \t\n\x0b\f\r]+", (text or "").lower()) if len(w) >= mixing.TOPIC_WORD)
    most = [w for w, n in count.items() if n == max(count.values())]
    return f"topic{zlib.crc32(min(most).encode()) % 8}" if most else "none"


def test_mixing_query_against_a_plain_version(spark):
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source", mixing.uniform(F.col("doc_id"), 1).alias("u")).collect()
    cell = {r["doc_id"]: (r["source"] or "(none)", r["lang"] or "(none)", leading_topic(r["text"])) for r in docs}
    n = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs}
    p, reached, goals = plain_mix([(cell[i], n[i]) for i in cell], queries.MIX_TARGETS, queries.MIX_BUDGET)
    got = {r["doc_id"]: r for r in queries.op2_mixing(spark, data).collect()}
    assert got.keys() == cell.keys()
    for r in docs:
        own, i = got[r["doc_id"]], r["doc_id"]
        assert (own["source"], own["lang"], own["topic"]) == cell[i] and own["n_tokens"] == n[i]
        assert abs(own["probability"] - p[cell[i]]) < 2e-5 and own["selected"] == (r["u"] < own["probability"])
        for k, (d, v) in enumerate(zip(mixing.DIMENSIONS, cell[i], strict=True)):
            assert abs(own[f"{d}_reached"] - reached[d, v]) < 1e-4 and abs(own[f"{d}_goal"] - goals[k][v]) < 1e-5
            assert abs(own[f"{d}_reached"] - own[f"{d}_goal"]) < 0.005 and abs(own[f"{d}_target"] - own[f"{d}_goal"]) < 0.02
    odd = [None, "", "a bc", "Garden garden meadow", "meadow meadow garden", "garden", "zebras apples zebras apples", "x" * 100_000, "éèàùüß " * 3]
    told = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, text string").select("k", mixing.word_topic(F.col("text")).alias("topic"))
    assert {r["k"]: r["topic"] for r in told.collect()} == {k: leading_topic(t) for k, t in enumerate(odd)}


def test_mixing_keeps_columns_of_any_name(spark):
    docs = mixed(spark).withColumn("__mix_p", F.lit("own")).withColumn("__mix_source", F.lit(7))
    got = mixing.sample(docs, mixing.word_topic(F.col("text")), {}, 0.5)
    assert got.columns == docs.columns and got.filter("__mix_p = 'own' AND __mix_source = 7").count() == got.count() > 0


def test_sample_is_decided_by_id_and_probability(spark):
    docs = mixed(spark)
    topic = mixing.word_topic(F.col("text"))
    targets = {"lang": {"en": 0.6}, "source": 0.5}
    every = mixing.probabilities(docs, topic, targets, 0.4).collect()
    assert len(every) == 3000 and all(0 <= r["probability"] <= 1 for r in every)
    chosen = mixing.sample(docs, topic, targets, 0.4)
    assert chosen.columns == docs.columns
    assert {r["doc_id"] for r in chosen.collect()} == {r["doc_id"] for r in every if r["selected"]}
    tokens = sum(r["n_tokens"] for r in every)
    assert abs(sum(r["n_tokens"] for r in every if r["selected"]) / tokens - 0.4) < 0.05
    assert abs(sum(r["n_tokens"] * r["probability"] for r in every if r["lang"] == "en") / (0.4 * tokens) - 0.6) < 0.01
    assert mixing.probabilities(docs.limit(0), topic, targets).count() == 0


# WARC


def test_warc_files_round_trip(spark, tmp_path):
    html = '<html lang="en"><head><title>A\n title</title><style>p{}</style></head><body><!-- no --><p>One &amp; <b>two</b></p><script>var x="</p>";</script><a href="/x">link</a><br>3 < 4</body></html>'
    pages = spark.createDataFrame([(1, "http://a/", html, 7), (2, None, None, 7), (3, "http://c/", "é" * 100_000, 7), (3, "http://c/", "é" * 100_000, 7)], "page_id long, url string, html string, block int")
    derived = warc_derivatives.derivatives(warc_derivatives.responses(pages, "2024-01-01T00:00:00Z"))
    rows = {(r["source_id"], r["warc_type"]): r for r in derived.collect()}
    assert derived.count() == 8
    assert rows[1, "conversion"]["block"] == "One & two\nlink\n3 < 4"
    assert "title: A title\r\nlanguage: en\r\n" in rows[1, "metadata"]["block"] and "outlink: /x\r\n" in rows[1, "metadata"]["block"]
    assert rows[1, "metadata"]["source_payload_digest"] == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    assert rows[2, "conversion"]["content_length"] == 0 and rows[2, "metadata"]["target_uri"] == ""
    assert rows[1, "metadata"]["refers_to"] == rows[1, "conversion"]["refers_to"] != rows[1, "metadata"]["record_id"]
    warc_derivatives.write(derived, str(tmp_path / "warc"))
    back = {(r["headers"]["warc-record-id"], bytes(r["block"]).decode()) for r in warc_derivatives.read(spark, str(tmp_path / "warc/*.gz")).collect()}
    assert back == {(r["record_id"], r["block"]) for r in rows.values()}
    assert warc_derivatives.derivatives(warc_derivatives.responses(pages.limit(0), "x")).count() == 0


# Oracles and the pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_oracle(spark, name):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, data).toArrow(), con.sql(queries.ORACLE_SQL[name]).to_arrow_table()
    columns = sorted(want.column_names)
    assert columns == sorted(got.column_names)
    assert sorted(zip(*(got.column(c).to_pylist() for c in columns), strict=True)) == sorted(zip(*(want.column(c).to_pylist() for c in columns), strict=True))


def test_pipeline_stages_decide_as_their_operators_do(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    texts = []
    for k in range(240):
        own = [word() for _ in range(rng.randint(20, 120))]
        if k % 6 == 0:
            own[3] = "scumbag"
        if k % 10 == 1:
            own[5] = "password=hunter2hunter2"
        texts.append(" ".join(own))
    texts += texts[7:12] + [None, ""]
    rows = [(k, t, rng.choice(["en", "de", None]), rng.choice(["s", "t"]), None if t is None else len(t), 1.0) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {}
    current = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, current, str(tmp_path)).write.parquet(str(tmp_path / name))
        current = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"]: r for r in current.collect()}
        if name != "packing":
            assert current.columns == docs.columns
    lexicon = toxicity.learn(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    assert set(kept["toxicity"]) == {k for k, t in enumerate(texts) if lexicon.scores(np.array([lexicon.features(t or "")]))[0] < 0.7}
    assert not any(k % 6 == 0 for k in kept["toxicity"] if k < 240)
    assert set(kept["near_duplicates"]) == set(kept["toxicity"]) - {240 + k for k in range(5)} - {246}
    assert all(r["text"] == (None if texts[k] is None else secret_scan.redact(texts[k])) for k, r in kept["secrets"].items())
    assert set(kept["secrets"]) == set(kept["near_duplicates"]) and not any("hunter2" in (r["text"] or "") for r in kept["secrets"].values())
    assert set(kept["mixing"]) <= set(kept["secrets"]) and set(kept["packing"]) == set(kept["mixing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == current.count()


def test_pipeline_edges(spark, tmp_path):
    """Nulls in every column, repeated ids and rows, ties, clashing names; and no documents at all."""
    long = "word " * 30_000
    rows = [(None, None, None, None, None), (None, "no id", "en", "s", 5), (1, None, None, None, 0), (2, "", "en", None, 0), (3, long, None, "s", len(long)), (4, long, "de", "s", 1)]
    rows += [(5, "one text of this id, password=hunter2hunter2", "en", "s", None), (5, "another text of this id", "en", "s", None), (6, "same row", "en", "s", 8), (6, "same row", "en", "s", 8)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, own, labels in (("some", rows, [(1, 1, 1), (2, 0, 0), (None, 1, 1), (3, None, None)]), ("none", [], []), ("unlabelled", rows, [])):
        docs = spark.createDataFrame([(*r, "extra", 1, 2.0) for r in own], f"{schema}, __mix_p string, node int, score double")
        (tmp_path / name).mkdir()
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        current = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for stage, function in corpus_pipeline.STAGES[:4]:
            function(spark, current, str(tmp_path / name)).write.parquet(str(tmp_path / name / stage))
            current = spark.read.parquet(str(tmp_path / name / stage))
            assert current.columns == docs.columns
            if stage == "near_duplicates" and own:
                kept = [(r["doc_id"], r["text"]) for r in current.collect()]
                both = [(5, "one text of this id, password=hunter2hunter2"), (5, "another text of this id")]  # an id in common makes no duplicates
                assert sorted(kept, key=repr) == sorted([(None, None), (None, "no id"), (1, None), (3, long), *both, (6, "same row")], key=repr)
        made = corpus_pipeline.run(spark, str(tmp_path / name))
        assert made.columns[:3] == ["doc_id", "start", "length"] and (own or made.count() == 0)


def test_recall_of_near_duplicates_by_similarity(spark):
    """Against all pairs of sf0.1 with similarity 0.8 or more: every band is found whole, and nothing below is linked on its own."""
    from stridemill.llm import shingle_join

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    component = {r["doc_id"]: r["component_id"] for r in shingle_join.near_duplicates(docs).collect()}
    sets = {}
    for r in docs.collect():
        sets.setdefault(shingle_join.shingle_set(r["text"] or "", 5).tobytes(), r["doc_id"])
    nodes = [(i, np.frombuffer(b, np.uint64)) for b, i in sets.items()]
    meets = {}
    for k, (_, s) in enumerate(nodes):
        for h in s[: len(s) // 5 + 1].tolist():  # the smallest hashes are a prefix in the order of hashes
            meets.setdefault(h, []).append(k)
    pairs = {(a, b) for ks in meets.values() for b in ks for a in ks if a < b}
    found, roots = {}, {i: i for i, _ in nodes}
    for a, b in pairs:
        (i, x), (j, y) = nodes[a], nodes[b]
        if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
            common = len(np.intersect1d(x, y, assume_unique=True))
            similarity = common / max(1, len(x) + len(y) - common)
            if similarity >= 0.8:
                found.setdefault(int(similarity * 20), []).append(component[i] == component[j])
                low, high = sorted((roots[i], roots[j]))
                roots = {k: low if r == high else r for k, r in roots.items()} if low != high else roots
    assert sum(map(len, found.values())) > 40 and all(all(x) for x in found.values())
    assert all(component[i] == r for i, r in roots.items())
