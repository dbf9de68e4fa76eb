"""Approximate nearest neighbours by collision counting over single projections.

A block's candidates are cut into bands of norms within a factor of BAND, each with an index of its own, so that one long
row doesn't level the others. In a band maximum inner product becomes nearness by one more coordinate (the band's largest
norm makes all vectors equally long). A band is left out only if by its largest norm it can't reach the k-th score found. Each of PROJECTIONS random projections of a band is a sorted array. A query's window in each
array is centred on the query's own projection and widened by virtual rehashing: radius R becomes RATIO * R, and only what is new in the window is
counted. Candidates that collide in at least a threshold of the arrays are verified by their true inner product. A
row at distance s collides in a projection if a normal number is under R / s, so at radius R rows nearer than about
R / REACH have passed the threshold: the widening ends when the k-th nearest that was verified is as near as that.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from bytelake.llm.blocks import block_search, top, vectors

STRIPE, K = 16_384, 20
PROJECTIONS, THRESHOLD, RADIUS, RATIO = 65, 0.7, 0.3, 1.05
REACH = 1.13  #: a collision has probability THRESHOLD at 1.04; projections in whole orthogonal bases leave less to chance than others would
BAND = 1.1  #: largest norm of a band over its least
SCOUTS = 8  #: a block's first queries begin at RADIUS; the others one step before the least radius that those ended at


def inner(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added from the first component to the last."""
    out = np.zeros(len(rows))
    for column, weight in zip(np.ascontiguousarray(rows.T), q):
        out += column * weight
    return out


def orthogonal(n: int, dims: int, seed: int) -> np.ndarray:
    """n random directions of the length of normal vectors, orthogonal within each run of `dims` of them, so that few say much."""
    rng = np.random.default_rng(seed)
    runs = [np.linalg.qr(rng.normal(size=(dims, dims)))[0].T * np.sqrt(dims) for _ in range(-(-n // dims))]
    return np.concatenate(runs)[:n]


class CollisionIndex:
    """Sorted projections of a block of vectors; `norm`: at least the length of each."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, norm: float, seed: int = 11):
        self.ids, self.v = ids, v
        self.norm = max(norm, float(np.sqrt((v * v).sum(axis=1)).max()))
        more = np.sqrt(np.maximum(0, 1 - (v * v).sum(axis=1) / self.norm**2))
        self.axes = orthogonal(PROJECTIONS, v.shape[1] + 1, seed)
        p = self.axes @ np.c_[v / self.norm, more].T
        self.order = np.argsort(p, axis=1, kind="stable")
        self.sorted = np.take_along_axis(p, self.order, axis=1)
        self.ended: list[float] = []
        self.verified = self.asked = 0  #: rows verified; rows that could have been

    def search(self, q: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, inner products) of the best k found but for rows with the id `own`."""
        n, need = len(self.ids), int(np.ceil(THRESHOLD * PROJECTIONS))
        other = np.ones(n, bool) if own is None else self.ids != own
        length = max(np.sqrt(q @ q), 1e-300)
        centre = self.axes @ np.r_[q / length, 0.0]
        counts, radius = np.zeros(n, np.int64), RADIUS if len(self.ended) < SCOUTS else max(RADIUS, min(self.ended) / RATIO)
        low = high = np.array([np.searchsorted(s, c) for s, c in zip(self.sorted, centre)])
        rough, known = np.full(n, -np.inf), np.zeros(n, bool)
        while True:
            a, b = np.array([s.searchsorted((c - radius, c + radius)) for s, c in zip(self.sorted, centre.tolist())]).T
            if (low == high).all() and 2 * (b - a).sum() > n * PROJECTIONS:  # most collide at once: count those that don't
                rest = np.concatenate([x for o, a0, b0 in zip(self.order, a, b) for x in (o[:a0], o[b0:])])
                counts = PROJECTIONS - np.bincount(rest, minlength=n)
            else:
                new = np.concatenate([x for o, a0, l0, h0, b0 in zip(self.order, a, low, high, b) for x in (o[a0:l0], o[h0:b0])])
                counts += np.bincount(new, minlength=n)
            low, high = a, b
            new = np.flatnonzero((counts >= need) & other & ~known)
            known[new], rough[new] = True, self.v[new] @ q
            if (a == 0).all() and (b == n).all():
                break
            if known.sum() >= k:
                kth = np.partition(rough, n - k)[-k]
                if 2 - 2 * kth / (self.norm * length) <= (radius / REACH) ** 2:
                    break
            radius *= RATIO
        found = np.flatnonzero(known)
        self.verified, self.asked = self.verified + len(found), self.asked + n
        if len(self.ended) < SCOUTS:
            self.ended.append(radius)
        rough = rough[found]
        if len(found) > 4 * k:  # sums in another order differ by less than this, so none of the best is lost
            bar = np.partition(rough, len(rough) - k)[-k] - 1e-9 * max(1.0, self.norm) * max(1.0, np.sqrt(q @ q))
            found = found[rough >= bar]
        scores = inner(self.v[found], q)
        best = top(self.ids[found], scores, k)
        return self.ids[found][best], scores[best]


class BandedIndex:
    """An index for each band of norms; the rows of bands that would be verified whole anyway are one band without an index."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int = K):
        norms = np.sqrt((v * v).sum(axis=1))
        order = np.argsort(-norms, kind="stable")
        self.bands, few, at = [], [], 0
        while at < len(order):
            end = len(order) - int(np.searchsorted(norms[order][::-1], norms[order[at]] / BAND))
            rows, at = np.sort(order[at : max(end, at + 1)]), max(end, at + 1)
            if len(rows) <= 8 * k:
                few.append(rows)
            else:
                self.bands.append((float(norms[rows].max()), CollisionIndex(ids[rows], v[rows], float(norms[rows].max()))))
        rows = np.sort(np.concatenate(few)) if few else np.zeros(0, np.int64)
        self.ids, self.v = ids[rows], v[rows]

    def search(self, q: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, inner products) of the best k found but for rows with the id `own`."""
        other = np.ones(len(self.ids), bool) if own is None else self.ids != own
        ids, scores = self.ids[other], inner(self.v[other], q)
        length = np.sqrt(q @ q)
        for norm, index in self.bands:
            if len(ids) >= k and np.partition(scores, len(scores) - k)[-k] > norm * length * (1 + 1e-9):
                break
            more = index.search(q, k, own)
            ids, scores = np.concatenate([ids, more[0]]), np.concatenate([scores, more[1]])
            best = top(ids, scores, k)
            ids, scores = ids[best], scores[best]
        best = top(ids, scores, k)
        return ids[best], scores[best]


def collision_neighbours(table: DataFrame, modulus: int = 20, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found by largest inner product (all candidates if fewer).

    Queries are the rows whose vec_id is divisible by `modulus`; where rows repeat such a vec_id, the least of their vectors is
    asked, once. Every valid row is indexed. score is the inner product
    of the original vectors in double precision; ties go to the smaller vec_id. Vectors that are null, empty, zero or
    hold null or non-finite components take no part, nor do rows with a null vec_id; rows that repeat a vec_id are candidates each,
    but not of the query of that id. Other columns are not read; an empty table gives no rows.
    """
    whole = vectors(table).where("exists(v, x -> x <> 0)")
    return block_search(whole, modulus, k, "double", lambda ids, v: BandedIndex(ids, v, k), STRIPE)
