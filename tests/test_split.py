import pytest

from stridemill.errors import InvalidParameter
from stridemill.functions import split


@pytest.mark.parametrize(("n", "workers", "want"), [(10, 3, [(0, 4), (4, 7), (7, 10)]), (12, 3, [(0, 4), (4, 8), (8, 12)]), (0, 2, [(0, 0), (0, 0)]), (1, 2, [(0, 1), (1, 1)])])
def test_literal_splits(n, workers, want):
    assert [(r.start, r.stop) for r in (split.balanced_range(n, workers, k) for k in range(workers))] == want


def test_every_small_split_covers_its_range_evenly():
    for workers in range(1, 40):
        for n in range(0, 90):
            blocks = [split.balanced_range(n, workers, k) for k in range(workers)]
            assert [i for b in blocks for i in b] == list(range(n))
            sizes = [len(b) for b in blocks]
            assert max(sizes) - min(sizes) <= 1
            assert (min(sizes), max(sizes)) == (split.smallest_block(n, workers), split.largest_block(n, workers))
            assert [split.owner(i, n, workers) for i in range(n)] == [k for k, b in enumerate(blocks) for _ in b]


def test_no_workers_is_an_error():
    for call in (lambda: split.balanced_range(3, 0, 0), lambda: split.owner(0, 1, 0), lambda: split.largest_block(1, -1)):
        with pytest.raises(InvalidParameter, match="at least one worker"):
            call()


def test_permutations_visit_each_place_once():
    for length in range(0, 64):
        for seed in range(64):
            assert sorted(split.permuted(5, length, seed)) == list(range(5, 5 + length))
    assert split.coprime_stride(17, 3) == 7
    assert split.coprime_stride(1, 9) == 0


def test_columns_agree_with_integers(spark):
    from pyspark.sql import functions as F

    i = F.col("id")
    for n, workers in ((0, 3), (1, 2), (5, 8), (10, 3), (24, 8), (255, 7)):
        got = spark.range(n).select(split.owner_col(i, n, workers)).collect()
        assert [r[0] for r in got] == [split.owner(k, n, workers) for k in range(n)]
        got = spark.range(workers).select(split.block_first_col(i, n, workers), split.block_count_col(i, n, workers)).collect()
        assert [tuple(r) for r in got] == [(b.start, len(b)) for b in (split.balanced_range(n, workers, k) for k in range(workers))]
    got = spark.range(17).select(split.permuted_col(i, 5, 17, 3)).collect()
    assert [r[0] for r in got] == split.permuted(5, 17, 3)
    got = spark.range(100).select(split.to_global(split.to_local(i, 7), split.to_shard(i, 7), 7)).collect()
    assert [r[0] for r in got] == list(range(100))
    big = 2**53 + 1
    assert spark.range(big, big + 1).select(split.to_local(i, 2)).first()[0] == big // 2


def test_small_helpers(spark):
    from pyspark.sql import functions as F

    assert split.saturating_add(2**63 - 2, 5) == 2**63 - 1
    assert [x for x in range(-1, 9) if split.is_power_of_two(x)] == [1, 2, 4, 8]
    got = spark.range(1).select(split.saturating_add_col(F.lit(2**63 - 2), F.lit(5)), split.is_power_of_two_col(F.lit(64))).first()
    assert tuple(got) == (2**63 - 1, True)
