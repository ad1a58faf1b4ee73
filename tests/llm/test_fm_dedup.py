import hashlib
import random

import duckdb
import numpy as np
import pytest

from stridemill.llm import fm_dedup, queries

DATA = "/root/testdata/sf0.001"


def plain(rows, window):
    """Every window of every document, one by one."""
    words = [(doc, text.encode().split() if text else []) for doc, text in rows]
    first = {}
    for doc, own in words:
        if doc is not None:
            for i in range(len(own) - window + 1):
                key = tuple(own[i : i + window])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, own in words:
        gone = [False] * len(own)
        if doc is not None:
            for i in range(len(own) - window + 1):
                if first[tuple(own[i : i + window])] < doc:
                    gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(own, gone, strict=True) if not g)
        out.append((doc, len(own), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    text = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    shared, out = [text(rng.randint(10, 90)) for _ in range(8)], []
    for doc in range(120):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4)):
            parts += [rng.choice(shared), text(rng.randint(0, 30))]
        if doc and rng.random() < 0.2:  # a near copy
            words = rng.choice(out)[1].split() or ["x"]
            words[rng.randrange(len(words))] = "edit"
            parts = [" ".join(words)]
        out.append((doc, " ".join(parts)))
    # nulls, empty, periods, repeated ids and rows, unusual white space
    out += [(200, None), (201, ""), (202, "a " * 500), (203, "a " * 700), (150, "b c " * 400), (204, "b c " * 300)]
    out += [(None, out[3][1]), (None, shared[0]), (7, out[9][1]), (7, out[9][1]), (5, out[5][1]), (205, "\x1f x y \n\t " * 80), (206, "\x1f x y\n" * 60)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("window", "how"), [(20, {}), (50, {}), (20, {"most": 300}), (20, {"shard": 500}), (20, {"most": 0}), (5, {}), (1, {})])
def test_equals_a_plain_version(spark, rows, window, how):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, dig int")
    got = fm_dedup.deduplicate(df.repartition(5), window, **how)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, window)


def test_an_empty_table(spark):
    assert fm_dedup.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_very_long_text(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(9)}" for _ in range(60_000)]
    rows = [(1, " ".join(words[30_000:30_500])), (2, " ".join(words)), (3, " ".join(words[:40_000]))]
    got = fm_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == plain(rows, 50)


def test_index_against_plain_counting():
    rng = np.random.default_rng(3)
    passages = [rng.integers(0, 6, rng.integers(3, 40)).astype(np.uint64) for _ in range(60)]
    docs = rng.integers(0, 1000, 60)
    first = fm_dedup.FMIndex(passages, docs, 3).first_of(passages)
    have = {}
    for doc, p in zip(docs.tolist(), passages, strict=True):
        for i in range(len(p) - 2):
            key = tuple(p[i : i + 3])
            have[key] = min(have.get(key, doc), doc)
    assert first.tolist() == [have[tuple(p[i : i + 3])] for p in passages for i in range(len(p) - 2)]


def test_rank_of_compressed_bits():
    rng = np.random.default_rng(4)
    bits = np.concatenate([np.zeros(200, bool), np.ones(333, bool), rng.random(500) < 0.5, np.ones(64, bool)])
    made = fm_dedup.Bits(bits)
    places = np.arange(len(bits) + 1)
    assert made.rank(places).tolist() == np.append(0, np.cumsum(bits)).tolist()
    assert len(made.words) < len(bits) // 64


def test_the_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op11_fm_dedup"])
    got = queries.op11_fm_dedup(spark, DATA).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
