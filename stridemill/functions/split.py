"""Index arithmetic: the balanced split, its inverse, co-prime permutations and round-robin placement.

Every rule comes twice: on Python integers, and on columns (names ending in ``_col``), where it stays inside generated code.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidParameter


def _workers(workers: int) -> int:
    if workers <= 0:
        raise InvalidParameter("at least one worker is needed")
    return workers


def balanced_range(n: int, workers: int, k: int) -> range:
    """Block ``k`` of ``n`` tasks over ``workers``: contiguous, and block sizes differ by one at most."""
    q, r = divmod(n, _workers(workers))
    first = q * k + min(k, r)
    return range(first, first + q + (k < r))


def smallest_block(n: int, workers: int) -> int:
    return n // _workers(workers)


def largest_block(n: int, workers: int) -> int:
    return -(-n // _workers(workers))


def owner(i: int, n: int, workers: int) -> int:
    """The block that task ``i`` lies in."""
    q, r = divmod(n, _workers(workers))
    head = r * (q + 1)
    return i // (q + 1) if i < head else r + (i - head) // max(q, 1)


def owner_col(i: Column, n: int, workers: int) -> Column:
    q, r = divmod(n, _workers(workers))
    head = r * (q + 1)
    i = i.cast("long")
    low = _div(i, q + 1)
    if r == 0:
        return _div(i, max(q, 1))
    return F.when(i < head, low).otherwise(_div(i - head, max(q, 1)) + r).cast("long")


def _div(a: Column, b: int) -> Column:
    """Whole division of non-negative longs, exact where a division of doubles wouldn't be."""
    return F.call_function("div", a, F.lit(b).cast("long"))


def block_first_col(k: Column, n: int, workers: int) -> Column:
    q, r = divmod(n, _workers(workers))
    return (k * q + F.least(k, F.lit(r))).cast("long")


def block_count_col(k: Column, n: int, workers: int) -> Column:
    q, r = divmod(n, _workers(workers))
    return (F.lit(q) + (k < r).cast("long")).cast("long")


def coprime_stride(length: int, seed: int) -> int:
    """The first odd number from ``2 * seed + 1`` on that is co-prime with ``length``, modulo it; 0 where there's one place at most."""
    return next(s for s in itertools.count(2 * seed + 1, 2) if math.gcd(s, length) == 1) % length if length > 1 else 0


def permuted(start: int, length: int, seed: int) -> list[int]:
    """``range(start, start + length)`` in the order of the co-prime stride."""
    stride = coprime_stride(length, seed)
    return [start + (k * stride) % length for k in range(length)]


def permuted_col(k: Column, start: int, length: int, seed: int) -> Column:
    return (F.pmod(k * coprime_stride(length, seed), F.lit(max(length, 1))) + start).cast("long")


def to_shard(g: Column, shards: int) -> Column:
    return F.pmod(g.cast("long"), F.lit(_workers(shards)).cast("long"))


def to_local(g: Column, shards: int) -> Column:
    return _div(g.cast("long"), _workers(shards))


def to_global(local: Column, shard: Column, shards: int) -> Column:
    return (local * _workers(shards) + shard).cast("long")


def local_worker_col(worker: Column, workers: int, shards: int) -> Column:
    """A worker's number within its shard."""
    return worker - block_first_col(owner_col(worker, workers, shards), workers, shards)


def saturating_add(a: int, b: int, bits: int = 63) -> int:
    return min(a + b, 2**bits - 1)


def saturating_add_col(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_add(a, b), F.lit(2**63 - 1))


def is_power_of_two(x: int) -> bool:
    return x > 0 and x & (x - 1) == 0


def is_power_of_two_col(x: Column) -> Column:
    return (x > 0) & (x.bitwiseAND(x - 1) == 0)
