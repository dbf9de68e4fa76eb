"""SimHash near-duplicates, with candidates from fuzzy hashing by the binary Golay code.

The Golay code (23, 12) is perfect: each 23-bit word has one codeword within distance 3. Fingerprints are cut into
segments, segments are decoded to the indices of nearby codewords, and pigeonholes over segments say which keys two
near fingerprints must (or most likely do) share. Candidates are joined by key and verified.

Links of 2 bits or fewer (`simhash_groups`): a 64-bit fingerprint has segments of 23, 23 and 18 bits. Two words at distance
2 or less have a word between them that lies within distance 1 of both, so the sets {decode(z) : |z - x| <= 1}, of 1
or 6 codeword indices, meet. Of 2 errors or fewer over three segments, either the first or the second segment has
none, or both have one and the third has none; so three kinds of key (first exact, second fuzzy; second exact, first
fuzzy; third exact, first fuzzy), about 16 a fingerprint, find every link. Buckets of any size are compared in blocks
of a bounded number of fingerprints, and a block gives the edges of a spanning forest, not its pairs.

Near copies (`near_copy_groups`) at a Jaccard similarity of word shingles: such texts differ in a seventh of their
bits, more than hard decoding bears. So a fingerprint has SEGMENTS segments of sums, not only signs; each segment is
decoded by its margins to the FEW codewords that fit best (all 4096 are scored), and of each of TRIPLES triples of
segments the KEYS likeliest combinations of three indices are keys of 36 bits. Candidates that share one and whose
signs are near enough are verified on their whole sets of shingles, unless a bound on what the sets differ in (`marks`) already says
that they aren't similar enough. By simulation a pair at similarity 0.8 (0.85, 0.9) shares a
key with probability 0.99 (0.999, 1).
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from bytelake.llm.components import components
from bytelake.llm.shared import bounded_batches, cut, fresh_dir, partitions

POLY = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a generator of the code
BLOCK = 1024  #: fingerprints of a bucket that a block holds, about; blocks of larger buckets are compared two by two

WIDTH, SIMILARITY = 5, 0.8  #: words a shingle; the least Jaccard similarity of a link
SEGMENTS, FEW, KEYS = 24, 6, 12
TRIPLES = [(i, 8 + (i + s) % 8, 16 + (i + 2 * s) % 8) for s in range(2) for i in range(8)]  #: two of them share one segment at most
SIGNS = 8  #: longs of signs that are kept of each text
APART = 119  #: of the 64 * SIGNS signs, those that a pair may differ in (77 are expected at similarity 0.8, deviation 8.1)
APART_64 = 25  #: of the first 64 signs (9.7 are expected, deviation 2.9)
MARKS = 8  #: longs of parities that are kept of each text
FEW_EDGES = 1 << 20  #: links that one task connects
STARS = 2  #: rounds that link buckets to one member, at most; after the first only buckets of over CROWD members
CROWD = 16
HELD = 1 << 21  #: keys that a task sorts at once
PIECE = 1 << 20  #: bytes of a text that are split into words at once
_BLANK = re.compile(rb"[ \t-\r]")


# Fingerprints of 64 bits.


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned SimHash of a whole text; null, empty and all-blank texts give 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    ones, n = np.zeros(64, np.int64), 0
    hashes = map(lambda g: xxh64_intdigest(g, 42), grams)
    while True:  # a long text goes through in pieces
        h = np.fromiter(islice(hashes, 1 << 15), "<u8")
        if not len(h):
            break
        ones += bit_counts(h[:, None])
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@lru_cache(1)
def _spread() -> np.ndarray:
    """For each byte value, a long whose bytes are its bits, the lowest first."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many rows of (n, k) longs have each of their 64 k bits; a byte counts up to 255 rows at a time."""
    raw, out = np.ascontiguousarray(h, "<u8").view(np.uint8).reshape(len(h), -1), np.zeros(64 * h.shape[1], np.int64)
    for at in range(0, len(raw), 255):
        out += _spread()[raw[at : at + 255]].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# The Golay code.


@lru_cache(1)
def _errors() -> np.ndarray:
    """The error pattern of each of the 2048 syndromes."""
    bits = [1 << i for i in range(23)]
    words = [0, *bits, *(a ^ b for i, a in enumerate(bits) for b in bits[:i]), *(a ^ b ^ c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j])]
    out = np.zeros(2048, np.uint32)
    out[_syndrome(np.array(words, np.uint32))] = words
    return out


def _syndrome(x: np.ndarray) -> np.ndarray:
    r = x.astype(np.uint32).copy()
    for k in range(22, 10, -1):
        r ^= np.where(r >> np.uint32(k) & np.uint32(1), np.uint32(POLY << (k - 11)), np.uint32(0))
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word (the code is systematic: its upper bits)."""
    x = x.astype(np.uint32)
    return (x ^ _errors()[_syndrome(x)]) >> np.uint32(11)


def fuzzy(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the distinct codeword indices of each word's ball of radius 1."""
    x = x.astype(np.uint32)
    balls = np.concatenate([x[:, None], x[:, None] ^ (np.uint32(1) << np.arange(23, dtype=np.uint32))], axis=1)
    found = np.sort(decode(balls), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    row, col = np.nonzero(new)
    return row, found[row, col]


@lru_cache(1)
def _codewords() -> np.ndarray:
    """(23, 4096): the signs of the bits of each codeword, by its index."""
    upper = np.arange(4096, dtype=np.uint32) << np.uint32(11)
    words = upper ^ _syndrome(upper)
    return (2.0 * (words[None, :] >> np.arange(23, dtype=np.uint32)[:, None] & np.uint32(1)) - 1).astype(np.float32)


def nearest(sums: np.ndarray, few: int = FEW) -> tuple[np.ndarray, np.ndarray]:
    """(indices, scores), the best first: the `few` codewords that fit best to each row of 23 sums; ties to lower indices."""
    score = sums.astype(np.float32) @ _codewords()
    tops = score.reshape(len(score), 256, 16).max(axis=2)  # the best `few` lie in the `few` runs with the best tops
    runs = np.sort(np.argpartition(-tops, few - 1, axis=1)[:, :few], axis=1)
    index = (runs[:, :, None] * 16 + np.arange(16)).reshape(len(score), -1)
    own = np.take_along_axis(score, index, axis=1)
    best = np.argsort(-own, axis=1, kind="stable")[:, :few]
    return np.take_along_axis(index, best, axis=1), np.take_along_axis(own, best, axis=1)


# Links of two bits.


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): all keys of each fingerprint."""
    u = fp.view(np.uint64)
    a, b, c = u & np.uint64(0x7FFFFF), u >> np.uint64(23) & np.uint64(0x7FFFFF), u >> np.uint64(46)
    (ra, ka), (rb, kb) = fuzzy(a), fuzzy(b)
    sets = [(rb, a[rb], kb), (ra, b[ra], ka), (ra, c[ra], ka)]
    return np.concatenate([r for r, _, _ in sets]), np.concatenate([(np.uint64(kind) << np.uint64(40) | exact << np.uint64(12) | k.astype(np.uint64)) for kind, (_, exact, k) in enumerate(sets)]).view(np.int64)


def forest(group: np.ndarray, fp: np.ndarray, most: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): edges of a spanning forest of the links of `most` bits or fewer between rows of equal, adjacent groups."""
    n, fp = len(fp), fp.view(np.uint64)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, n])
    left = np.repeat(first + size, size) - np.arange(n)  # rows of the group from here on
    root, live, step = np.arange(n), np.arange(n), 1
    while len(live := live[left[live] > step]):
        i = live[np.bitwise_count(fp[live] ^ fp[live + step]) <= most]
        j = i + step
        while len(i):
            a, b = root[i], root[j]
            open_ = a != b
            i, j, low, high = i[open_], j[open_], np.minimum(a, b)[open_], np.maximum(a, b)[open_]
            np.minimum.at(root, high, low)
            while not np.array_equal(up := root[root], root):
                root = up
        step += 1
    own = np.flatnonzero(root != np.arange(n))
    return own, root[own]


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): edges over distinct fingerprints (column fp) whose components are those of all links of 2 bits or fewer.

    A bucket of n fingerprints is dealt by a hash to about n / `block` blocks; every two blocks, and each with itself, meet in a
    group of a bounded size, where distances are verified and the edges of a spanning forest come out. So
    no task holds a bucket, whatever its size, and as many rows come out as go in.
    """

    def run(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 20_000):
                part = fp[at : at + 20_000]
                row, key = keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], ["key", "fp"])

    keyed = distinct.select("fp").mapInArrow(run, "key long, fp long")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")  # a join, unlike a window, may split a bucket of any size
    sized = cut(keyed.join(shared, "key").select("key", "fp", F.ceil(F.col("n") / block).alias("blocks")))
    dealt = sized.withColumn("own", F.pmod(F.xxhash64("fp"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")

    def compare(batches):
        for cols in whole_groups(batches, ["key", "low", "high"], "fp"):
            i, j = forest(cols[0], cols[1])
            yield pa.RecordBatch.from_arrays([pa.array(cols[1][i]), pa.array(cols[1][j])], ["a", "b"])

    return met.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(compare, "a long, b long").distinct()


def whole_groups(batches, by: list[str], value: str, rows: int = 50_000):
    """(group number, values) of some `rows` rows of batches in the order of `by`, never splitting a group."""
    held: list = []
    for b in batches:
        held.append([b.column(c).to_numpy(zero_copy_only=False) for c in (*by, value)])
        if sum(len(h[0]) for h in held) < rows:
            continue
        cols = [np.concatenate(x) for x in zip(*held)]
        new = _new(cols[: len(by)])
        at = int(new[-1])
        held = [[c[at:] for c in cols]]
        if at:
            yield _numbered(cols, new, at)
    if held:
        cols = [np.concatenate(x) for x in zip(*held)]
        if len(cols[0]):
            yield _numbered(cols, _new(cols[: len(by)]), len(cols[0]))


def _new(cols: list[np.ndarray]) -> np.ndarray:
    """The first rows of groups."""
    return np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)])


def _numbered(cols: list[np.ndarray], new: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.zeros(end, np.int64)
    at[new[new < end]] = 1
    return np.cumsum(at), cols[-1][:end]


def simhash_groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents link when their fingerprints differ in 2 bits or fewer; component_id is the least doc_id that is
    reached. Null, empty and blank texts have fingerprint zero and link like others. Repeated rows stay repeated;
    a null doc_id links its group but is never its least id (null if there is no other). Columns other than
    doc_id and text are not read. An empty table gives no rows.
    """
    fps = cut(fingerprints(docs, width))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(classes)).withColumnRenamed("node", "fp")
    rooted = cut(classes.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies.


_C = np.random.default_rng(11).integers(0, 1 << 63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word of a whole text; long texts are split a piece at a time."""
    data, at, out = (text or "").encode().lower(), 0, []
    while at < len(data):
        m = _BLANK.search(data, at + PIECE) if at + PIECE < len(data) else None
        end = m.end() if m else len(data)
        words = data[at:end].split()
        out.append(np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a whole text's shingles; a shorter text is one shingle, a blank one too."""
    w = word_hashes(text)
    k = min(width, len(w))
    if not k:
        return np.zeros(1, np.uint64)
    n = len(w) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total += w[i : i + n] * _C[i]
    return np.unique(_mix(total))


def sums(found: np.ndarray) -> np.ndarray:
    """The SimHash of a set before its signs are taken: for each bit, the hashes that have it less those that don't."""
    longs, out = -(-23 * SEGMENTS // 64), 0
    for at in range(0, len(found), 255 << 6):
        part = found[at : at + (255 << 6), None]
        out = out + bit_counts(_mix(part * _C[32 : 32 + longs] + np.arange(1, longs + 1, dtype=np.uint64)))
    return 2 * out - len(found)


def marks(found: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * MARKS bins of hashes: whether the set has an odd number in it. Two sets differ in at least as many
    hashes as bits, as a bin in which they differ by none has the same parity."""
    bins = (found % np.uint64(64 * MARKS)).astype(np.int64)
    return np.packbits(np.bincount(bins, minlength=64 * MARKS) & 1 == 1).view("<i8")


def may_be_similar(similarity: float) -> str:
    """SQL over a.n, a.marks, b.n, b.marks: false only for sets of a smaller Jaccard similarity. Sets that differ in s of their x + y
    hashes share (x + y - s) / 2, so they are as similar if s * (1 + similarity) <= (x + y) * (1 - similarity)."""
    apart = " + ".join(f"bit_count(a.marks[{i}] ^ b.marks[{i}])" for i in range(MARKS))
    return f"({apart}) * cast({1 + similarity} as double) <= (a.n + b.n) * cast({1 - similarity} as double) + 1e-6"


@lru_cache(1)
def _ranks() -> np.ndarray:
    """Ranks (0: best) in three lists that a sum among the KEYS largest may come from: no more than KEYS - 1 others are as large."""
    r = np.stack(np.meshgrid(*[np.arange(FEW)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    return r[(r + 1).prod(axis=1) <= KEYS]


def fuzzy_keys(margins: np.ndarray) -> np.ndarray:
    """(rows, len(TRIPLES) * KEYS): the keys of 40 bits of rows of sums: the triple, and three codeword indices."""
    n = len(margins)
    index, score = nearest(margins[:, : 23 * SEGMENTS].reshape(-1, 23))
    index, score, ranks = index.reshape(n, SEGMENTS, FEW).astype(np.uint64), score.reshape(n, SEGMENTS, FEW), _ranks()
    out = np.zeros((n, len(TRIPLES), KEYS), np.uint64)
    for t, segments in enumerate(TRIPLES):
        total = sum(score[:, s][:, ranks[:, k]] for k, s in enumerate(segments))
        best = ranks[np.argsort(-total, axis=1, kind="stable")[:, :KEYS]]
        for k, s in enumerate(segments):
            out[:, t] |= np.take_along_axis(index[:, s], best[:, :, k], axis=1) << np.uint64(12 * k)
        out[:, t] |= np.uint64(t << 36)
    return out.reshape(n, -1)


SKETCH = "doc_id long, d long, n long, signs array<long>, marks array<long>, keys binary"


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, d, n, signs, marks, keys): a digest of each text's set, its size, the first signs of its SimHash as longs, its parities, its
    keys of 5 bytes."""
    columns = ["doc_id", "d", "n", "signs", "marks", "keys"]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                d, n, margins, parities = [], [], [], []
                for text in part.column("text"):
                    found = shingles(text.as_py(), width)
                    d.append(xxh64_intdigest(found.tobytes(), 3))
                    n.append(len(found))
                    margins.append(sums(found))
                    parities.append(marks(found))
                margins = np.array(margins)
                signs = np.packbits(margins[:, : 64 * SIGNS] > 0, axis=1).view("<i8")
                own = fuzzy_keys(margins)
                packed = own.astype("<u8").view(np.uint8).reshape(*own.shape, 8)[:, :, :5]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(d, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(list(signs), pa.list_(pa.int64())), pa.array(parities, pa.list_(pa.int64())), pa.array([x.tobytes() for x in packed], pa.binary())], columns)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, SKETCH)


_ENTRY = np.dtype([("key", "u1", 5), ("d", "<i8")])


def _blobs(at: np.ndarray, key: np.ndarray, d: np.ndarray, parts: int) -> pa.Array:
    """For each part, the entries of the rows that are dealt to it; rows in the order of the parts."""
    rows = np.empty(len(key), _ENTRY)
    rows["key"], rows["d"] = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5], d
    ends = (np.searchsorted(at, np.arange(parts + 1)) * _ENTRY.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), parts, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])


def _entries(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(raw, _ENTRY)
    key = np.zeros((len(rows), 8), np.uint8)
    key[:, :5] = rows["key"]
    return key.view("<u8").ravel().astype(np.uint64), rows["d"].astype(np.int64)


def _distinct(key: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, digests, whether the key has other digests) of distinct pairs in the order of the keys."""
    order = np.lexsort((d, key))
    key, d = key[order], d[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (d[1:] != d[:-1])]
    key, d = key[new], d[new]
    like = np.r_[False, key[1:] == key[:-1], False]
    return key, d, like[1:] | like[:-1]


def members(sketched: DataFrame) -> DataFrame:
    """(key, d): the keys that sets of more than one digest share, with these digests, once each.

    A task sorts its keys, gives out those that it finds shared, and sends one digest for each key on, packed by part. So
    a key that many rows have meets itself first within tasks, and no part gets more than a row for each key and flush."""
    parts = 4 * partitions(sketched.sparkSession)

    def deal(batches):
        held: list = []
        for b in batches:
            raw = np.frombuffer(b"".join(x.as_py() for x in b.column("keys")), np.uint8).reshape(-1, 5)
            key = np.zeros((len(raw), 8), np.uint8)
            key[:, :5] = raw
            held.append((key.view("<u8").ravel().astype(np.uint64), np.repeat(b.column("d").to_numpy(zero_copy_only=False), len(TRIPLES) * KEYS)))
            if sum(len(k) for k, _ in held) >= HELD:
                yield flush(held)
                held = []
        if held:
            yield flush(held)

    def flush(held):
        key, d, like = _distinct(*(np.concatenate(x) for x in zip(*held)))
        at = (_mix(key + np.uint64(77)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        key, d, like, at = key[order], d[order], like[order], at[order]
        one = np.r_[True, key[1:] != key[:-1]]  # equal keys are still adjacent
        return pa.RecordBatch.from_arrays([pa.array(np.arange(parts)), _blobs(at[one], key[one], d[one], parts), _blobs(at[like], key[like], d[like], parts)], ["part", "one", "like"])

    def meet(batches):
        own, held = None, []
        for b in batches:
            for part, one, like in zip(b.column("part").to_pylist(), b.column("one"), b.column("like")):
                if part != own and held:
                    yield found(held)
                    held = []
                own = part
                held.append((one.as_py(), like.as_py()))
        if held:
            yield found(held)

    def found(held):
        key, d, like = _distinct(*_entries(b"".join(x for x, _ in held)))
        more, at = _entries(b"".join(x for _, x in held))
        return pa.RecordBatch.from_arrays([pa.array(np.r_[key[like], more].view(np.int64)), pa.array(np.r_[d[like], at])], ["key", "d"])

    dealt = sketched.select("d", "keys").mapInArrow(deal, "part long, one binary, like binary")
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "key long, d long").distinct()


def sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(d, hashes): the digest of each text's set and the set itself."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                found = [shingles(t.as_py(), width).tobytes() for t in b.column("text").slice(at, 64)]
                d = np.array([xxh64_intdigest(x, 3) for x in found], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(d.view(np.int64)), pa.array(found, pa.binary())], ["d", "hashes"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "d long, hashes binary")


def verified(pairs: DataFrame, hashes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of digests whose sets are as similar as that."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = hashes.toDF("a", "x"), hashes.toDF("b", "y")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_copy_groups(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, d) of every row, and (d, root) of the digests that share a key: rows are near copies of each other where roots
    (the digests themselves where there is none) are equal.

    Buckets are first linked to one member each, large ones some rounds with other members; then all pairs that share a bucket and
    aren't connected yet are verified, so that a large group costs a few comparisons a member and no candidate is left out."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sketches(docs, width).write.parquet(at := fresh_dir(spark, "sketches"))
    own = spark.read.schema(SKETCH).parquet(at)
    met = cut(members(own))
    needed = cut(met.select("d").distinct())
    classes = own.join(needed, "d", "left_semi").groupBy("d").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("signs").alias("signs"), F.first("marks").alias("marks"))
    facts = cut(classes.select("d", "n", "signs", "marks"))
    keyed = cut(met.join(met.groupBy("key").agg(F.count("*").alias("m")), "key").select("key", "m", "d"))  # a text has many rows here: nothing else goes along
    ids = classes.select(F.col("least").alias("_id")).where("_id is not null").distinct()
    texts = docs.join(ids, docs["doc_id"] == ids["_id"], "left_semi").select("text").unionByName(docs.where("doc_id is null").select("text"))
    hashes = cut(sets(texts, width).join(needed, "d", "left_semi").dropDuplicates(["d"]))
    roots, found = needed.select("d", F.col("d").alias("root")), None
    apart = " + ".join(f"bit_count(a.signs[{i}] ^ b.signs[{i}])" for i in range(SIGNS))
    near = f"least(a.n, b.n) >= {similarity} * greatest(a.n, b.n) - 1e-9 and {apart} <= {APART} and {may_be_similar(similarity)}"

    def likely(pairs: DataFrame) -> DataFrame:
        """Distinct pairs whose sizes, signs and marks allow the similarity."""
        once = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        both = once.join(facts.alias("a"), F.col("x") == F.col("a.d")).join(facts.alias("b"), F.col("y") == F.col("b.d"))
        return cut(both.where(near).select(F.col("x").alias("a"), F.col("y").alias("b")))

    def linked(pairs: DataFrame) -> DataFrame:
        nonlocal found
        new = verified(pairs, hashes, similarity)
        found = cut(new if found is None else found.unionByName(new))
        at = components(found, few=FEW_EDGES).withColumnRenamed("node", "d")
        return cut(needed.join(at, "d", "left").select("d", F.coalesce("root", "d").alias("root")))

    for i in range(STARS):
        rows = (keyed.where(F.col("m") > CROWD) if i else keyed).join(roots, "d")
        centre = rows.groupBy("key").agg(F.min_by(F.struct("d", "root"), F.xxhash64("d", F.lit(i))).alias("c"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        met_once = rows.alias("a").join(centre.select("key", "c.*").alias("b"), "key").where("a.root <> b.root")
        pairs = likely(met_once.select(F.col("a.d").alias("x"), F.col("b.d").alias("y")))
        if pairs.isEmpty():
            break
        roots = linked(pairs)
    rows = keyed.join(roots, "d")
    open_ = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    left = cut(rows.join(open_, "key", "left_semi").join(facts.select("d", "n", F.col("signs")[0].alias("sign"), "marks"), "d").select("key", "d", "root", "n", "sign", "marks"))
    near_enough = f"least(a.n, b.n) >= {similarity} * greatest(a.n, b.n) - 1e-9 and bit_count(a.sign ^ b.sign) <= {APART_64} and {may_be_similar(similarity)}"
    met_all = left.alias("a").join(left.alias("b"), "key").where(f"a.d < b.d and a.root <> b.root and {near_enough}")
    pairs = likely(met_all.select(F.col("a.d").alias("x"), F.col("b.d").alias("y")))
    if not pairs.isEmpty():
        roots = linked(pairs)
    return own.select("doc_id", "d"), roots


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` without the documents of each group of near copies but that of the least doc_id; same columns.

    Texts link when the Jaccard similarity of their sets of `width`-word shingles (lower-cased ASCII, split at ASCII
    white space) is `similarity` or more; groups are what links connect. A shorter text is one shingle; null, empty
    and blank texts are copies of each other. Texts are read whole, of any length. Rows with a null doc_id link their
    group and are kept: they cannot be told from one another. Rows that repeat a kept doc_id are kept. An empty table
    gives no rows; columns may have any names.
    """
    own, roots = near_copy_groups(docs, width, similarity)
    least = own.groupBy("d").agg(F.min("doc_id").alias("least"))
    keep = least.join(roots, "d", "left").groupBy(F.coalesce("root", "d")).agg(F.min("least").alias(KEEP)).where(F.col(KEEP).isNotNull()).select(KEEP).distinct()
    return docs.join(keep, docs["doc_id"] == keep[KEEP], "left_semi").unionByName(docs.where("doc_id is null"))


KEEP = "__simhash_keep"
