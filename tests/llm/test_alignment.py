import collections
import hashlib

import public_tokenizers
import pytest

from stridemill.llm import alignment, queries

A = (alignment.ByteLevel, public_tokenizers.path("byte_bpe_50k.json"))
B = (alignment.Sentence, public_tokenizers.path("piece_bpe_32k.model"))


def plain(texts):
    """Token by token, every link counted on its own."""
    a_side, b_side = (kind(path) for kind, path in (A, B))
    found, docs = [], collections.Counter()
    for text in texts:
        a = a_side.lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.lib.encode(text) if text else []
        made = {b"".join(side.bytes[k] for k in ids) for side, ids in ((a_side, a), (b_side, b))}
        if not text or made != {(" " + text).encode()}:
            found.append(([], [], [], collections.Counter()))
            continue
        groups, links, i, j, end_a, end_b, own_a, own_b = [], collections.Counter(), 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if end_a <= end_b and i < len(a):
                own_a.append(a[i])
                end_a += len(a_side.bytes[a[i]])
                i += 1
            else:
                own_b.append(b[j])
                end_b += len(b_side.bytes[b[j]])
                j += 1
            if end_a == end_b and own_a and own_b:
                groups.append((own_a, own_b))
                links.update((x, y) for x in own_a for y in own_b)
                own_a, own_b = [], []
        found.append((a, b, groups, links))
        docs.update(links.keys())
    best = collections.Counter()
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    out = []
    for a, b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n_best = sum(n for p, n in links.items() if docs[p] == best[p[0]])
        out.append((len(a), len(b), len(groups), sum(links.values()), n_best, sum(n * docs[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


TEXTS = [
    None, "", " ", "a", "a  b", " lead", "trail ", "\n", "x\n\ny z\n", "▁odd ▁", "日本語 テスト 😀 ok", "<|endoftext|> hi", "<s> </s> <0x41>", "word " * 3000, "a" * 50_000,
    " nb sp x", "é é ﬁ", "tab\tsep \t z", "don't can't 12345 67,8", "word " * 3000, "\x00 nul", "x" * 10 + " " * 50 + "y",
]


@pytest.mark.parametrize("frequent", [1 << 20, 30, 0])
def test_equals_a_plain_version(spark, frequent):
    rows = [(k if k != 3 else None, t) for k, t in enumerate(TEXTS)] + [(13, TEXTS[13]), (4, "another text of the same id")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, pair int")
    got = alignment.align(df, A, B, frequent=frequent)
    want = [(i, *r) for (i, _), r in zip(rows, plain([t for _, t in rows]), strict=True)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_small_blocks_and_links_in_lots(spark, monkeypatch):
    monkeypatch.setattr(alignment, "LINKS", 50)
    a, b = [1, 1, 2, 3] * 5, [7, 8, 8] * 5
    import numpy as np

    arrays = (np.array(x) for x in (a, b, [20, 0][:1], [15], [0]))
    key, weight = alignment.links(*arrays, (10, 10))
    want = collections.Counter(x * 10 + y for x in a for y in b)
    assert dict(zip(key.tolist(), weight.tolist(), strict=True)) == want


def test_the_query_on_whole_documents(spark):
    path = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, plain([r.text for r in rows]), strict=True)]
    assert sorted(map(tuple, queries.op12_alignment(spark, path).collect())) == sorted(want)


def test_an_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
