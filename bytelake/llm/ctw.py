"""Context-tree weighting over bytes, trained on a corpus and applied to whole texts, beside a word unigram base.

A byte is eight binary decisions, each with a context tree of its own over the preceding bytes. A node of depth d
holds how often each bit followed its context; its Krichevsky-Trofimov estimate and its children are mixed with the
weights of context-tree weighting, so a prediction is a mixture over all depths 0..DEPTH. 0xFF, which no UTF-8 text
holds, ends every text and stands before it, so the model is a distribution over whole texts.

Nothing here grows on the driver but the nodes of depth 0 and 1 (256 contexts of 255 nodes). Blocks of documents give
their distinct grams (contexts with next byte) and words; Spark sums these; grams with the same three last context
bytes are weighted together, from the deepest nodes up to depth 3, and sums of these go up to the 65,536 contexts of depth 2 and
on to depth 1; then each group gets the mixtures of the depths above it, a row for each next byte before its grams, and
each block gets back the values of its own grams and words by a join. (A block's distinct grams are found twice, once
to be summed and once for that join: kept between, they would take more disk than the time is worth.)
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelake.llm.shared import bounded_batches, cut, fresh_dir, remainder

DEPTH = 5  #: bytes of context; a gram has DEPTH + 1 bytes, 7 at most
BLOCK_ROWS, BLOCK_BYTES = 8192, 32 << 20  #: rows of a file that make a block, at most; bytes that they have on average, at most
USUAL = 1 << 16  #: bytes; whenever texts are twice as long as this, half as many rows make a block
NEAR = 3  #: context bytes that grams of a group share
END, WORD = 0xFF, -(1 << 63)
PIECE = 1 << 18  #: bytes whose grams are held at once
FREE = -1  #: no key: a word's is WORD at least and stays below -1 by its making
OPEN, MOST = 4, 1_500_000  #: blocks that a task has open, distinct grams and words of one before it is given out


_RNG = np.random.default_rng(0x5EED)
_VALUE = _RNG.integers(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(9, 14), END]] = True
_BASE = 0x9E3779B97F4A7C15
END_KEY = WORD  #: the key of the end, counted as a word


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_INVERSE = pow(_BASE, -1, 1 << 64)


def segments(texts, piece: int = PIECE):
    """(number of the text, bytes with their context in front, whether the text ends here), long texts cut after white space."""
    pad = b"\xff" * 8
    for i, text in enumerate(texts):
        data, at = (text or "").encode(), 0
        while len(data) - at > piece and (m := re.compile(rb"[ \t-\r]").search(data, at + piece)) and m.end() < len(data):
            yield i, (pad + data[max(0, at - 8) : at])[-8:] + data[at : m.end()], False
            at = m.end()
        yield i, (pad + data[max(0, at - 8) : at])[-8:] + data[at:] + b"\xff", True


def buffers(texts, depth: int, piece: int = PIECE):
    """(number, gram keys, first key of each segment, words, first word of each segment) of some `piece` bytes of segments at a time.

    A gram's key has the nearest context byte highest, then the farther ones, then the byte itself. A word's key is
    negative: 63 bits of a polynomial over random byte values. An ended text has the key of the end as its last word."""
    held, size = [], 0
    for s in segments(texts, piece):
        held.append(s)
        size += len(s[1])
        if size >= piece:
            yield _keys(held, depth)
            held, size = [], 0
    if held:
        yield _keys(held, depth)


def _keys(held: list, depth: int):
    raw = np.frombuffer(b"".join(s for _, s, _ in held), np.uint8)
    lengths = np.array([len(s) for _, s, _ in held])
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    body = np.ones(len(raw), bool)
    body[(starts[:, None] + np.arange(8)).ravel()] = False
    n = len(raw) - 8
    wide, key = raw.astype(np.int64), np.zeros(n, np.int64)
    for back in range(1, depth + 1):
        key <<= 8
        key |= wide[8 - back : 8 - back + n]
    key <<= 8
    key |= wide[8:]
    key = key[body[8:]]
    first_key = np.r_[0, np.cumsum(lengths - 8)[:-1]]
    white = _BLANK[raw] | ~body
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1  # the first byte is never in a word
    begin, end = edge[::2], edge[1::2] if len(edge) % 2 == 0 else np.r_[edge[1::2], len(raw)]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * _powers(_BASE, len(raw)), out=total[1:])
    h = (total[end] - total[begin]) * _powers(_INVERSE, len(raw))[begin]
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(32)) >> np.uint64(1)
    words = np.clip(h.astype(np.int64), 1, (1 << 63) - 2) + WORD
    ends = np.array([e for _, _, e in held])
    at = np.searchsorted(begin, starts[ends] + lengths[ends])
    first_word = np.searchsorted(begin, starts) + np.r_[0, np.cumsum(ends)[:-1]]
    return np.array([i for i, _, _ in held]), key, first_key, np.insert(words, at, END_KEY), first_word


def _sum(parts: list) -> list:
    """Merge (keys, counts) pairs to one of distinct sorted keys."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return [(keys[first], np.add.reduceat(counts, first) if len(first) else counts)]


def _count(batches, depth: int):
    """From (block, text, learn) to (block, key, n): distinct keys of each block, n as far as learnt from."""

    def rows(block, at):
        at.flush(depth)
        for keys, n in _sum(at.parts) if at.parts else []:
            for i in range(0, len(keys), 100_000):
                k = keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block)), pa.array(k), pa.array(n[i : i + 100_000])], ["block", "key", "n"])

    blocks: dict[int, _Block] = {}  # a few at once, as texts of other lengths lie between those of a block
    for b in batches:
        for block, text, learn in zip(*(b.column(c) for c in ("block", "text", "learn"))):
            block, text, learn = block.as_py(), text.as_py(), learn.as_py()
            at = blocks.get(block)
            if at is None:
                if len(blocks) >= OPEN:
                    yield from rows(first := next(iter(blocks)), blocks.pop(first))
                at = blocks[block] = _Block()
            at.texts[learn].append(text)
            at.size += len(text or "") + 1
            if at.size > PIECE:
                at.flush(depth)
            if at.rows > MOST:
                yield from rows(block, blocks.pop(block))
    for block, at in blocks.items():
        yield from rows(block, at)


class _Block:
    """The distinct keys so far of one block."""

    def __init__(self):
        self.parts, self.texts, self.size, self.rows = [], {True: [], False: []}, 0, 0

    def flush(self, depth: int) -> None:
        for learn, texts in self.texts.items():
            for _, grams, _, words, _ in buffers(texts, depth):
                k = np.concatenate([grams, words])
                k.sort()
                first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                self.parts.append((k[first], np.diff(np.r_[first, len(k)]) * learn))
            texts.clear()
        self.size = 0
        if sum(len(k) for k, _ in self.parts) > MOST:
            self.parts = _sum(self.parts)
            self.rows = len(self.parts[0][0])


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5, by Stirling's series after a shift by 8."""
    y = x + 8
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - 2 * 0.5723649429247001


def weigh(labels: list[np.ndarray], n: np.ndarray, bit: np.ndarray, below: np.ndarray | None = None):
    """One bit position of nested contexts: labels[j] says which node of level j each row belongs to, outermost first.

    `below`: log weighted probabilities under the nodes of the last level, by label, where that isn't a leaf.
    Returns for each level (node of each row, log weighted probability, own share, estimate of the row's bit)."""
    out, under = [], None
    for j in range(len(labels) - 1, -1, -1):
        node, inv = np.unique(labels[j], return_inverse=True)
        n1 = np.bincount(inv, n * bit, len(node))
        n0 = np.bincount(inv, n * (1 - bit), len(node))
        own = log_kt(n0, n1)
        if under is not None:  # sum of the children, by one row of each
            child, wp = under
            at = np.zeros(len(wp), np.int64)
            at[child] = inv
            kids = np.bincount(at, wp, len(node))
        else:
            kids = below
        wp = own if kids is None else np.logaddexp(own, kids) - np.log(2)
        share = np.ones(len(node)) if kids is None else np.exp(own - np.log(2) - wp)
        out.append((inv, wp, share[inv], (np.where(bit, n1[inv], n0[inv]) + 0.5) / (n0 + n1 + 1)[inv]))
        under = inv, wp
    return out[::-1]


def _levels(key: np.ndarray, depth: int):
    """For each of 8 bit positions: labels of depths NEAR..depth, bit, node of the symbol tree (heap index)."""
    symbol = key & 255
    for i in range(8):
        prefix = symbol >> (8 - i)
        yield [(key >> (8 * (depth + 1 - d))) << 8 | prefix for d in range(NEAR, depth + 1)], symbol >> (7 - i) & 1, (1 << i) | prefix


def group_roots(key: np.ndarray, n: np.ndarray, depth: int) -> pa.RecordBatch:
    """For grams of whole groups: (two, heap, wp), the log weighted probability of each group's nodes of depth NEAR, summed over the
    groups with the same two last context bytes."""
    two, n, parts = key >> (8 * (depth - 1)), n.astype(float), []
    for labels, bit, heap in _levels(key, depth):
        inv, wp, _, _ = weigh(labels, n, bit)[0]
        at = np.zeros(len(wp), np.int64)
        at[inv] = two << 8 | heap
        node, inv = np.unique(at, return_inverse=True)
        parts.append((node, np.bincount(inv, wp, len(node))))
    node, wp = (np.concatenate(x) for x in zip(*parts))
    return pa.RecordBatch.from_arrays([pa.array(node >> 8), pa.array(node & 255), pa.array(wp)], ["two", "heap", "wp"])


class Seconds:
    """The nodes of depth 2 of one context of two bytes: counts of their next bytes, and what lies below."""

    def __init__(self, counts: np.ndarray, below: np.ndarray):
        """counts of 256 next bytes, -1 for those that don't occur; below: by heap node, the sum of the log weighted probabilities of the children."""
        self.symbols = symbol = np.flatnonzero(counts >= 0)
        n = counts[symbol].astype(float)
        self.wp, self.share, self.estimate = np.zeros(256), np.ones(256), np.full(256, 0.5)  # by heap node; the estimate of a one
        for i in range(8):
            heap, bit = (1 << i) | symbol >> (8 - i), symbol >> (7 - i) & 1
            node, inv = np.unique(heap, return_inverse=True)
            n1, n0 = np.bincount(inv, n * bit, len(node)), np.bincount(inv, n * (1 - bit), len(node))
            own = log_kt(n0, n1)
            self.wp[node] = np.logaddexp(own, below[node]) - np.log(2)
            self.share[node] = np.exp(own - np.log(2) - self.wp[node])
            self.estimate[node] = (n1 + 0.5) / (n0 + n1 + 1)


def _seconds(batches, answer):
    """answer(two, Seconds) for each context from rows (two, at, n, wp) in the order of `two`: n of next byte `at`, or wp below node `at`."""
    held: list = []

    def done():
        at, n, wp = (np.concatenate(x) for x in zip(*(h[1:] for h in held)))
        counts, below, some = np.full(256, -1), np.zeros(256), n >= 0
        counts[at[some]], below[at[~some]] = n[some], wp[~some]
        return answer(held[0][0], Seconds(counts, below))

    for b in batches:
        two, *cols = (b.column(c).to_numpy(zero_copy_only=False) for c in ("two", "at", "n", "wp"))
        for a, e in zip(cuts := np.flatnonzero(np.r_[True, two[1:] != two[:-1]]), [*cuts[1:], len(two)]):
            if held and held[0][0] != two[a]:
                yield done()
                held = []
            held.append((int(two[a]), *(c[a:e] for c in cols)))
    if held:
        yield done()


def predictions(key: np.ndarray, n: np.ndarray, depth: int, heads: np.ndarray, upper: np.ndarray) -> pa.RecordBatch:
    """(key, value): log10 of the mixed probability of each gram's last byte after its context. heads: ascending, group and next byte
    of each row of `upper`: for each of its 8 bits, what the depths above give it, then the weights that are left."""
    over = 8 * (depth + 1 - NEAR)
    at = np.searchsorted(heads, key >> over << 8 | key & 255)
    n, total = n.astype(float), np.zeros(len(key))
    for i, (labels, bit, _) in enumerate(_levels(key, depth)):
        p, left = upper[at, i], upper[at, 8 + i]
        for _, _, share, estimate in weigh(labels, n, bit):
            p, left = p + left * share * estimate, left * (1 - share)
        total += np.log10(p)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(total)], ["key", "value"])


def _whole_groups(batches, depth: int, rows: int = 100_000):
    """Arrays (key, n, upper) of some `rows` rows from batches in the order of their groups, never splitting a group of NEAR context
    bytes; upper is a list, null but in rows with n < 0 that stand before their group."""
    held: list = []

    def whole():
        key, n = (np.concatenate([h[k] for h in held]) for k in range(2))
        return key, n, [u for h in held for u in h[2]]

    for b in batches:
        held.append((b.column("key").to_numpy(), b.column("n").to_numpy(), b.column("upper").to_pylist()))
        if sum(len(h[0]) for h in held) >= rows:
            key, n, upper = whole()
            near = key >> (8 * (depth + 1 - NEAR))
            at = int(np.searchsorted(near, near[-1]))
            held = [(key[at:], n[at:], upper[at:])]
            if at:
                yield key[:at], n[:at], upper[:at]
    if held:
        yield whole()


def _predicted(batches, depth: int):
    over = 8 * (depth + 1 - NEAR)
    for key, n, upper in _whole_groups(batches, depth):
        head = n < 0
        table = np.array([np.frombuffer(u) for u in upper if u is not None]).reshape(-1, 16)
        yield predictions(key[~head], n[~head], depth, key[head] >> over << 8 | key[head] & 255, table)


def upper_levels(order1: np.ndarray, wp2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From counts (256 contexts x 256 bytes) and the log weighted probabilities below (256 x 256 heap nodes), for each
    node of depth 1: what depths 0 and 1 give a one, a zero, and the weight that is left for the deeper ones."""
    done1, done0, rest = (np.zeros((256, 256)) for _ in range(3))
    c1, symbol = (x.ravel() for x in np.indices((256, 256)))
    n = order1.ravel().astype(float)
    for i in range(8):
        prefix = symbol >> (8 - i)
        heap, bit = (1 << i) | prefix, symbol >> (7 - i) & 1
        labels = [prefix, c1 << 8 | prefix]
        node = np.unique(labels[1])
        out = weigh(labels, n, bit, wp2[node >> 8, (1 << i) | (node & 255)])
        for b, into in ((1, done1), (0, done0)):
            p, left = 0.0, np.ones(len(n))
            for _, _, share, estimate in out:
                p, left = p + left * share * np.where(bit == b, estimate, 1 - estimate), left * (1 - share)
            into[c1, heap], rest[c1, heap] = p, left
    return done1, done0, rest


def blocked(docs: DataFrame) -> DataFrame:
    """(doc_id, text, held_out, learn, block). Blocks follow a file's rows, as many as have BLOCK_BYTES by the mean length of all texts, BLOCK_ROWS
    at most, and fewer of texts over USUAL bytes; a single longer text is a block. A frame that isn't read from files alone is
    written to the shared folder first."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    except Exception:  # no file source below
        docs.write.parquet(at := fresh_dir(docs.sparkSession, "ctw"))
        placed = docs.sparkSession.read.parquet(at).select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    mean = docs.agg(F.avg(F.octet_length(F.coalesce("text", F.lit(""))))).first()[0] or 0
    rows = int(min(BLOCK_ROWS, max(64, BLOCK_BYTES // max(1, mean))))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.octet_length(F.coalesce("text", F.lit(""))), F.lit(1)) / USUAL))).cast("long")
    block = F.xxhash64("_path", level, F.floor(F.col("_row") / F.greatest(F.lit(1), F.floor(rows / F.pow(F.lit(2), level)))))
    held = remainder(F.col("doc_id"), 7) == 2
    return placed.select("doc_id", "text", held.alias("held_out"), (~held).alias("learn"), block.alias("block"))


class Table:
    """Values by key: open addressing in numpy arrays, probed for many keys at once. A key may be given more than once, with one value."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys) // 3 + 1).bit_length())
        self.keys, self.values = np.full(1 << self.bits, FREE, np.int64), np.zeros(1 << self.bits)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == FREE]
            self.keys[slot[free]] = keys[free]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        self.values[slot] = values

    def _slot(self, keys):
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        miss = np.flatnonzero(self.keys[slot] != keys)
        while len(miss):
            slot[miss] = (slot[miss] + 1) & ((1 << self.bits) - 1)
            if (self.keys[slot[miss]] == FREE).any():
                raise KeyError("a gram of this block has no value")
            miss = miss[self.keys[slot[miss]] != keys[miss]]
        return self.values[slot]


def _score(docs: pa.Table, found: pa.Table, depth: int, n_all: int, distinct: int) -> pa.Table:
    keys, values = found.column("key").to_numpy(), found.column("value").to_numpy()
    grams = keys >= 0
    table, counts = Table(keys[grams], values[grams]), Table(keys[~grams], values[~grams])
    n = docs.num_rows
    del keys, values, grams, found
    base, score, tokens, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    size = np.fromiter((len((t.as_py() or "").encode()) for t in docs.column("text")), np.int64, n)
    for i, grams, first, words, first_word in buffers((t.as_py() for t in docs.column("text")), depth):
        np.add.at(score, i, np.add.reduceat(np.r_[table.get(grams), 0.0], first) * (np.diff(np.r_[first, len(grams)]) > 0))
        c, some = counts.get(words), np.diff(np.r_[first_word, len(words)])
        for into, each in ((base, np.log10((c + 1) / (n_all + distinct + 1))), (known, (c > 0).astype(np.int64))):
            np.add.at(into, i, np.add.reduceat(np.r_[each, 0].astype(each.dtype), first_word) * (some > 0))
        np.add.at(tokens, i, some)
    cols = [docs.column("doc_id"), docs.column("held_out"), tokens, known, np.full(n, n_all), base, score, size, -score * 3.321928094887362 / (size + 1)]
    return pa.table(dict(zip(NAMES, cols)), schema=ARROW)


NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
ARROW = pa.schema([(n, {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])


def ctw_scores(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per document: see SCHEMA. Learns from documents whose crc32(doc_id) mod 7 isn't 2, scores all.

    Null and empty texts are an end alone. A null doc_id is learnt from. Repeated rows count and are scored each.
    With nothing to learn from, every estimate is a half and every word unknown; an empty table gives no rows.
    Extra columns are not read. Words are counted by 63-bit hashes.
    """
    if not 3 <= depth <= 6:
        raise ValueError("depth must be 3 to 6")
    bounded_batches(docs.sparkSession)
    spark, placed = docs.sparkSession, blocked(docs)
    counted = placed.select("block", "text", "learn").mapInArrow(lambda b: _count(b, depth), "block long, key long, n long")
    near, over = F.shiftright("key", 8 * (depth + 1 - NEAR)), 8 * (depth + 1 - NEAR)
    totals = cut(counted.groupBy("key").agg(F.sum("n").alias("n")).repartition(near).sortWithinPartitions("key"))
    words, tree = totals.where("key < 0"), totals.where("key >= 0")
    n_all, distinct = (x or 0 for x in words.agg(F.sum("n"), F.count_if(F.col("n") > 0)).first())
    blank = F.lit(None).cast("binary")
    roots = tree.withColumn("upper", blank).mapInArrow(lambda bs: (group_roots(k, n, depth) for k, n, _ in _whole_groups(bs, depth)), "two long, heap long, wp double")
    below = roots.groupBy("two", "heap").agg(F.sum("wp").alias("wp")).select("two", F.col("heap").alias("at"), F.lit(-1).cast("long").alias("n"), "wp")
    counts = tree.groupBy(F.shiftright("key", 8 * (depth - 1)).alias("two"), F.col("key").bitwiseAND(255).alias("at")).agg(F.sum("n").alias("n"))
    seconds = cut(counts.select("two", "at", "n", F.lit(0.0).alias("wp")).unionByName(below))  # 511 rows for each of 65,536 contexts at most
    of_two = seconds.repartition("two").sortWithinPartitions("two")

    def order1_row(two: int, own: Seconds) -> pa.RecordBatch:
        heap = np.flatnonzero(own.wp)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(heap), two >> 8)), pa.array(heap), pa.array(own.wp[heap])], ["c1", "heap", "wp"])

    order1, wp2 = np.zeros((256, 256)), np.zeros((256, 256))
    for c, s, n in seconds.where("n >= 0").groupBy(F.shiftright("two", 8).alias("c"), "at").agg(F.sum("n")).collect():  # 65,536 rows at most
        order1[c, s] = n
    for c, h, w in of_two.mapInArrow(lambda bs: _seconds(bs, order1_row), "c1 long, heap long, wp double").groupBy("c1", "heap").agg(F.sum("wp")).collect():
        wp2[c, h] = w
    upper = spark.sparkContext.broadcast(upper_levels(order1, wp2))  # 1.6 MB, whatever the corpus

    def mixed(two: int, own: Seconds) -> pa.RecordBatch:
        symbol, position = own.symbols[:, None], np.arange(8)
        heap, bit = (1 << position) | symbol >> (8 - position), symbol >> (7 - position) & 1
        done1, done0, rest = (u[two >> 8][heap] for u in upper.value)
        given = np.where(bit, done1 + rest * own.share[heap] * own.estimate[heap], done0 + rest * own.share[heap] * (1 - own.estimate[heap]))
        rows = np.concatenate([given, rest * (1 - own.share[heap])], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), two)), pa.array(own.symbols), pa.array([r.tobytes() for r in rows], pa.binary())], ["two", "symbol", "upper"])

    mixtures = of_two.mapInArrow(lambda bs: _seconds(bs, mixed), "two long, symbol long, upper binary")
    groups = tree.groupBy(near.alias("near"), F.col("key").bitwiseAND(255).alias("symbol")).agg(F.lit(-1).cast("long").alias("n"))
    heads = groups.withColumn("two", F.shiftright("near", 8 * (NEAR - 2))).join(mixtures, ["two", "symbol"]).select((F.shiftleft("near", over) + F.col("symbol")).alias("key"), "n", "upper")
    led = tree.withColumn("upper", blank).unionByName(heads).repartition(near).sortWithinPartitions(near, F.col("n") >= 0, "key")
    values = led.mapInArrow(lambda bs: _predicted(bs, depth), "key long, value double")
    values = values.unionByName(words.select("key", F.col("n").cast("double").alias("value")))
    found = counted.select("block", "key").join(values, "key").select("block", "key", "value")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        return _score(left, right, depth, n_all, distinct)

    return placed.select("block", "doc_id", "held_out", "text").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(score, SCHEMA)
