"""Which blocks a reader would fetch ahead, and what a cache of them would hold: simulations over access logs."""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf


def next_fixed(last: Column, n: Column) -> Column:
    """The n indexes after the last one accessed."""
    return F.when(n > 0, F.sequence(last + 1, last + n)).otherwise(F.array().cast("array<long>"))


def recent(history: list[int], memory: int) -> list[int]:
    """The latest accesses (latest first) that a reader remembers; repeating the latest one counts once."""
    return [x for i, x in enumerate(history) if not i or x != history[i - 1]][:memory]


def _grow(share: float, most: int) -> int:
    """1 for a share of 0 up to `most` for 1, exponentially."""
    return math.floor(2 ** (min(1.0, share) * math.log2(most)) + 0.5)


def adaptive(history: list[int], most: int, memory: int = 3) -> list[int]:
    """Indexes to fetch next after the accesses `history` (latest first): `most` after a first access or in sequential
    reading, exponentially fewer the shorter the latest sequential run is, none when no two accesses follow one another."""
    seen = recent(history, memory)
    if not seen or most <= 0:
        return []
    follows = [a == b + 1 for a, b in zip(seen, seen[1:])]
    if follows and not any(follows):
        return []
    run = len(follows) if all(follows) else follows.index(False)
    n = _grow((run + 1) / len(seen) if run else 0.0, most) if follows else most
    return [seen[0] + 1 + i for i in range(n)]


def interleaved(lists: Iterable[list[int]]) -> list[int]:
    """The first of each list, then the second of each, and so on."""
    lists = list(lists)
    return [x[i] for i in range(max(map(len, lists), default=0)) for x in lists if i < len(x)]


def multi_stream(history: list[int], most: int, memory: int = 3, streams: int = 16) -> list[int]:
    """Like `adaptive` for several sequential readers at once. Each run of neighbouring indexes among the remembered
    accesses goes on by itself, by as much as its members were accessed in ascending order; runs take turns, and what is
    remembered is left out."""
    seen = recent(history, memory * streams)
    if not seen or most <= 0:
        return []
    if len(seen) == 1:
        return [seen[0] + 1 + i for i in range(most)]
    full, order, grown = len(seen) >= memory * streams, sorted(seen), []
    start = 0
    for i in range(1, len(order) + 1):
        if i < len(order) and order[i] == order[i - 1] + 1:
            continue
        at, length = 0, 0
        for x in reversed(order[start:i]):  # going back in time, downwards
            if x not in seen[at:]:
                break
            at, length = seen.index(x, at), length + 1
        top, start = order[i - 1], i
        if full and length == 1:
            continue
        share = 0.0 if length <= 1 else length / memory if full else 1.0
        grown.append([top + 1 + k for k in range(_grow(share, most))])
    return [x for x in interleaved(grown) if x not in seen][:most]


def _udf(f):
    return arrow_udf(lambda history, most: pa.array([f(list(h or []), m) for h, m in zip(history.to_pylist(), most.to_pylist())], pa.list_(pa.int64())), T.ArrayType(T.LongType()))


adaptive_udf, multi_stream_udf = _udf(adaptive), _udf(multi_stream)


class LeastRecentlyUsed:
    """A cache with counts of hits, misses and entries that were thrown out unused."""

    def __init__(self, capacity: int):
        self.capacity, self.held, self.hits, self.misses, self.unused = capacity, OrderedDict(), 0, 0, 0

    def get(self, key):
        if key in self.held:
            self.hits += 1
            value, _ = self.held.pop(key)
            self.held[key] = value, True
            return value
        self.misses += 1
        return None

    def put(self, key, value=None) -> None:
        self.held.pop(key, None)
        while self.capacity and len(self.held) >= self.capacity:
            _, (_, used) = self.held.popitem(last=False)
            self.unused += not used
        if self.capacity:
            self.held[key] = value, False


def simulate(accesses: Iterable[int], capacity: int) -> dict[str, int]:
    cache = LeastRecentlyUsed(capacity)
    for x in accesses:
        if cache.get(x) is None:
            cache.put(x, True)
    return {"hits": cache.hits, "misses": cache.misses, "unused": cache.unused}
