"""Exact top-k by an index of postings in impact order.

In a block each candidate stands in the postings list of its leading dimension, the one of its largest component, and
lists are ordered by that component and cut into segments of SEGMENT candidates. A segment's impact on a query is the
most that a member can score: by the segment's greatest and least component of each dimension. For many queries at
once segments are processed in the order of descending impact, in STEPS steps; a segment scores all its members for the
queries that it is due for by one matrix product. The k-th best score so far is a bar that no result can be under: before
a segment is processed, queries whose bar is above its impact are left out, and a query ends when no segment reaches it.
Components are whole numbers, so single precision is exact for sums below 2^24 and double precision below 2^53.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelake.llm.blocks import block_search, vectors

SEGMENT, STEPS = 512, 4
MANY = 4096  #: queries that walk together
SINGLE, EXACT = float(1 << 24), float(1 << 53)  #: sums of whole numbers below these are exact in single, double precision


class Best:
    """The k best (score, id) of each of m queries so far, the best first."""

    def __init__(self, m: int, k: int):
        self.k, self.scores, self.ids = k, np.full((m, k), -np.inf), np.zeros((m, k), np.int64)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of the queries `at`: those that come before a query's last one take their places."""
        last = self.scores[at, -1]
        some = np.flatnonzero((scores > last) | ((scores == last) & (ids < self.ids[at, -1])))
        if not len(some):
            return
        had = np.unique(at[some])
        at = np.r_[at[some], np.repeat(had, self.k)]
        scores, ids = np.r_[scores[some].astype(np.float64), self.scores[had].ravel()], np.r_[ids[some], self.ids[had].ravel()]
        order = np.lexsort((ids, -scores, at))
        at, scores, ids = at[order], scores[order], ids[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        kept = rank < self.k
        self.scores[at[kept], rank[kept]], self.ids[at[kept], rank[kept]] = scores[kept], ids[kept]


class ImpactIndex:
    """Postings of vectors of whole numbers, (n, dims)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.size = np.maximum(x.max(axis=0).astype(np.float64), -x.min(axis=0).astype(np.float64))
        lead = np.maximum(x, -x.astype(np.promote_types(x.dtype, np.int32))).argmax(axis=1)
        order = np.lexsort((ids, -x[np.arange(len(x)), lead].astype(np.float64), lead))
        self.ids, self.x = ids[order], x[order]
        self.begin = np.arange(0, len(ids), SEGMENT)
        self.high, self.low = np.maximum.reduceat(self.x, self.begin), np.minimum.reduceat(self.x, self.begin)
        self.least = np.sort(ids)
        self.cast: dict[type, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.products = 0  #: queries times candidates scored, but for those beyond double precision

    def search(self, q: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k highest integer inner products but for rows with the id `own`; ties to smaller ids."""
        _, ids, scores = self.search_many(q[None], k, None if own is None else np.array([own]))
        return ids, scores

    def search_many(self, q: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, ids, scores): `search` for each row of q, but for rows with its id in `own`."""
        reach, out = np.abs(q.astype(np.float64)) @ self.size, []
        for kind, some in ((np.float32, reach < SINGLE), (np.float64, (reach >= SINGLE) & (reach < EXACT))):
            every = np.flatnonzero(some)
            for at in (every[i : i + MANY] for i in range(0, len(every), MANY)):
                best = self._walk(q[at].astype(kind), k, None if own is None else own[at])
                found, rank = np.nonzero(best.scores > -np.inf)
                out.append((at[found], best.ids[found, rank], best.scores[found, rank].astype(np.int64)))
        for i in np.flatnonzero(reach >= EXACT):
            ids, scores = self._whole(q[i], k, np.arange(len(self.ids)) if own is None else np.flatnonzero(self.ids != own[i]))
            out.append((np.full(len(ids), i), ids, scores))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    def _walk(self, q: np.ndarray, k: int, own: np.ndarray | None) -> Best:
        kind, m = q.dtype.type, len(q)
        if kind not in self.cast:
            self.cast[kind] = tuple(x.astype(kind) for x in (self.x, self.high, self.low))
        x, high, low = self.cast[kind]
        impact = high @ np.maximum(q, 0).T + low @ np.minimum(q, 0).T  # by segment and query
        # so many rows at most are the query's own, and don't count for a bar
        more = 0 if own is None else int((np.searchsorted(self.least, own, "right") - np.searchsorted(self.least, own)).max())
        best, above, bar = Best(m, k), np.full(m, np.inf, kind), np.full(m, -np.inf, kind)
        for step in range(STEPS + 1):
            if step == 0:
                down = impact.max(axis=0)
            elif step == STEPS:
                down = bar.copy()
            else:
                with np.errstate(invalid="ignore"):
                    down = np.where(above > bar, np.maximum(bar, above - (above - bar) / kind(STEPS + 1 - step)), bar)
            due = (impact < above) & (impact >= down)
            for s in np.flatnonzero(due.any(axis=1)).tolist():
                at = np.flatnonzero(due[s] & (impact[s] >= bar))
                if not len(at):
                    continue
                a, b = self.begin[s], min(self.begin[s] + SEGMENT, len(x))
                got = q[at] @ x[a:b].T
                self.products += got.size
                least = bar[at]
                if (new := np.flatnonzero(least == -np.inf)).size and b - a > k + more:
                    least[new] = np.partition(got[new], b - a - k - more, axis=1)[:, b - a - k - more]
                hit = np.flatnonzero(got.max(axis=1) >= least)
                who, row = np.nonzero(got[hit] >= least[hit, None])
                who, row = hit[who], row + a
                if own is not None:
                    other = np.flatnonzero(self.ids[row] != own[at[who]])
                    who, row = who[other], row[other]
                best.add(at[who], got[who, row - a], self.ids[row])
                bar[at] = best.scores[at, -1]
            above = np.minimum(above, down)
        return best

    def _whole(self, q: np.ndarray, k: int, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights = [int(w) for w in q]
        scores = [sum(int(a) * b for a, b in zip(self.x[i], weights)) for i in other]
        best = sorted(range(len(other)), key=lambda i: (-scores[i], self.ids[other[i]]))[:k]
        if any(not -(1 << 63) <= scores[i] < 1 << 63 for i in best):
            raise OverflowError("a score doesn't fit a long")
        return self.ids[other[best]], np.array([scores[i] for i in best], np.int64)


def impact_top_k(table: DataFrame, modulus: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products of floor(scale * x), all if fewer.

    Queries are the rows whose vec_id is divisible by `modulus`; where rows repeat such a vec_id, the least of their vectors is
    asked, once. Ties go to the smaller vec_id. Vectors that are null, empty or hold null or non-finite components take no part,
    nor do rows with a null vec_id; rows that repeat a vec_id are candidates each, but not of the query of that id. Scores
    are exact at any size; one that doesn't fit a long raises an error. Other columns are not read; an empty table gives no rows.
    """
    def whole(x):
        y = x * scale
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole numbers

    return block_search(vectors(table).select("vec_id", F.transform("v", whole).alias("v")), modulus, k, "long", ImpactIndex)
