"""What a packing worker takes at once and keeps is bounded, however many texts a task has."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from stridemill.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts(n: int) -> list[str]:
    rng = random.Random(3)
    return [" ".join(f"{rng.choice(('stone', 'river', 'night'))}{rng.randrange(10**6)}" for _ in range(250)) for _ in range(n)]


def test_rows_come_to_workers_by_bytes(spark, monkeypatch):
    """Each batch is one piece row here, its bytes the length."""

    def sizes(stream):
        for batch in stream:
            n = pa.array([batch.nbytes], pa.int64())
            yield pa.RecordBatch.from_arrays([n] * 7 + [pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary())], [*names, "source", "ids"])

    names = list(packing._NAMES)
    monkeypatch.setattr(packing, "_pack", lambda *_: sizes)
    docs = spark.range(9000).selectExpr("id AS doc_id", "repeat('word ', 200) AS text").coalesce(1)
    got = [r["length"] for r in packing.pack(docs, PATH, end=2).collect()]
    assert sum(got) > 9_000_000 and max(got) < 3_000_000


def test_slices_and_kept_pieces_are_bounded(monkeypatch):
    """All texts come as one batch; ids are still those of the library."""
    mine, taken, kept = texts(2500), [], []
    encoded = packing.encoded

    def spied(column, *how):
        out = encoded(column, *how)
        taken.append(sum(len(t) for t in column.to_pylist()))
        kept.append(len(packing.encoder(PATH).index))
        return out

    monkeypatch.setattr(packing, "encoded", spied)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(mine))), "text": mine})
    run = packing.lean(packing._pack(PATH, 2, 4096, 16, 16), packing._forget)
    rows = [r for b in run(iter([batch])) for r in b.to_pylist()]
    assert sum(taken) == sum(map(len, mine)) > 6_000_000 and max(taken) <= 2_100_000
    assert max(kept) > 50_000 and sum(kept) > 0 and not packing.encoder(PATH).index and not packing.encoder(PATH).cores
    lib = Tokenizer.from_file(PATH)
    n = np.array([len(lib.encode(t, add_special_tokens=False).ids) + 1 for t in mine[::50]])
    total = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert [total[k] for k in range(0, len(mine), 50)] == n.tolist() and sum(r["length"] for r in rows) == sum(total.values())


def test_pieces_are_forgotten_beyond_the_bound():
    known = packing.Pieces(PATH, blanks=False, kept=1000)
    lib = Tokenizer.from_file(PATH)
    for t in texts(12):
        _, ids = known.encode(pa.array([t]), True)
        assert ids.tolist() == lib.encode(t, add_special_tokens=False).ids and len(known.index) <= 1000
