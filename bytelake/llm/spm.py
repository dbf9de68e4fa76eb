"""SentencePiece encoding and decoding by batched Viterbi in numpy.

Words of equal length advance together, one end position at a time: hashes of all their substrings that end there
probe the sorted keys of the pieces of that size, hits are compared by their characters, and the best score, its piece
and its back pointer are kept for every word at once. For a Unigram model a path's score is the sum of its pieces' scores. What
merging gives for a BPE model is no best sum, but it is a path: pieces a, b may follow each other exactly if merging the text of both gives a, b
again, and exactly one path keeps to that at all its steps (a merge that crossed one of its borders first would cross it in the
text of these two pieces alone as well). So for a BPE model a step scores 0, or minus infinity where its two pieces
don't fit; whether they do is found by undoing their merges, the latest first, and asking each time whether the two
symbols at the border would have merged before. Of equal ranks the first pair merges first.

A sentence is cut into words before each run of word-boundary marks and around line ends; no piece of the models that are
accepted lies across such a cut. A long word goes through in stretches of ends, so that it needs some 30 bytes a character.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelake.llm.ragged import NONE, Merges
from bytelake.llm.shared import bounded_batches

MARK = "▁"
WORDS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
CACHE = 12_000_000  #: words, characters and pieces that a task keeps; then it starts over
STEP = 100_000  #: characters that advance together, about: of words of a length, or of a stretch of one
PAIRS = 21  #: bits of the number of pairs of pieces that are remembered
BASE = np.uint64(0x9E3779B97F4A7C15)
BYTE, UNKNOWN, NORMAL, UNUSED = 6, 2, 1, 5


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out, shift, at = out | (b & 127) << shift, shift + 7, at + 1
        if b < 128:
            return out, at


def fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        elif tag & 7 == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[tag & 7]
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class Model:
    """A .model file: pieces, scores, and how texts become sentences."""

    def __init__(self, file: str):
        with open(file, "rb") as f:
            top = list(fields(f.read()))
        self.pieces, self.scores, self.kinds = [], [], []
        for number, value in top:
            if number == 1:
                p = dict(fields(value))
                self.pieces.append(p[1].decode())
                self.scores.append(float(np.frombuffer(p.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(p.get(3, NORMAL))
        trainer, normal = (dict(fields(next((v for n, v in top if n == k), b""))) for k in (2, 3))
        self.bpe = trainer.get(3, 1) == 2
        self.byte_fallback = bool(trainer.get(35, 0))
        self.prefix, self.squeeze, self.mark = (bool(normal.get(k, 1)) for k in (3, 4, 5))
        if normal.get(2) or not self.mark or not self.byte_fallback:
            raise ValueError("only models without a normalization map, with white space marks and byte fallback, are read")
        self.unknown = self.kinds.index(UNKNOWN)
        usual = [i for i, k in enumerate(self.kinds) if k == NORMAL]
        if any(re.search(f"[^{MARK}]{MARK}|.\n|\n.", self.pieces[i], re.S) for i in usual):
            raise ValueError("a piece lies across words")
        if any(k == 4 for k in self.kinds):
            raise ValueError("user-defined pieces aren't read")
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.id = {self.pieces[i]: i for i in usual}
        self.floor = min(self.scores[i] for i in usual) - 10.0
        self.longest = max(map(len, self.id))
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by size: sorted keys, ids, characters
        for size in sorted(set(map(len, self.id))):
            own = [p for p in self.id if len(p) == size]
            points = np.frombuffer("".join(own).encode("utf-32-le"), "<u4").reshape(-1, size)
            keys = _hashes(points, size)[:, 0]
            order = np.argsort(keys)
            if (keys[order][1:] == keys[order][:-1]).any():
                raise ValueError("two pieces share a hash")
            self.sizes[size] = keys[order], np.array([self.id[p] for p in own])[order], points[order]
        self.values = np.array(self.scores)
        self.of_char = -1 - np.arange(0x110000)  # the piece of a character, or a negative number that names it
        for piece, i in self.id.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        self.text_of = [p if k == NORMAL else "" for p, k in zip(self.pieces, self.kinds)]
        self.is_byte = np.zeros(len(self.pieces), bool)
        self.is_byte[list(self.bytes.values())] = True
        self.byte_of = {i: b for b, i in self.bytes.items()}
        if self.bpe:
            left, right, rank, result = [], [], [], []
            for piece, i in self.id.items():
                for k in range(1, len(piece)):
                    a, b = self.id.get(piece[:k]), self.id.get(piece[k:])
                    if a is not None and b is not None:
                        left.append(a), right.append(b), rank.append(-self.scores[i]), result.append(i)
            self._merging(left, right, np.array(rank).astype(np.int64), result)
        self.known: dict[tuple[bool, ...], _Known] = {}

    def _merging(self, left, right, rank, result) -> None:
        """What BPE needs: the merges; for each piece the two that its last merge joins, and the rank of that (-1: it is a character)."""
        self.merges, n = Merges(left, right, rank, result), len(self.pieces)
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        pairs, self.reached = {(a, b): (r, c) for a, b, r, c in zip(left, right, rank.tolist(), result)}, np.ones(n, bool)
        for piece, i in self.id.items():  # merging a piece's own text, one pair at a time: the least rank, of equal ones the first
            row, last = [self.of_char[ord(c)] for c in piece], None
            while found := [(*pairs[two], k) for k, two in enumerate(zip(row, row[1:])) if two in pairs]:
                r, c, k = min(found, key=lambda f: (f[0], f[2]))
                last = row[k], row[k + 1], r
                row[k : k + 2] = [c]
            self.reached[i] = row == [i]
            if last and row == [i]:
                self.left[i], self.right[i], self.rank[i] = last
        self.pair_keys, self.pair_fits = np.full(1 << PAIRS, -1, np.int64), np.zeros(1 << PAIRS, bool)

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of each two pieces gives them back. Pairs are remembered, one for each of their hashes."""
        key = a << 32 | b
        slot = (key.view(np.uint64) * BASE >> np.uint64(64 - PAIRS)).astype(np.int64)
        new = np.flatnonzero(self.pair_keys[slot] != key)
        out = self.pair_fits[slot]
        if len(new):
            out[new] = self._fit(a[new], b[new])
            self.pair_keys[slot[new]], self.pair_fits[slot[new]] = key[new], out[new]  # of equal slots the last stays, in both
        return out

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b, out, live, limit = a.copy(), b.copy(), np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), NONE)
        while len(live):
            crossed = self.merges.find(a[live], b[live])[0] < limit[live]
            out[live[crossed]] = False
            live = live[~crossed]
            x, y = self.rank[a[live]], self.rank[b[live]]
            some = (x >= 0) | (y >= 0)
            live, x, y = live[some], x[some], y[some]
            later = x > y  # of equal ranks the left one merges first
            limit[live] = np.where(later, x, y + 1)
            a[live], b[live] = np.where(later, self.right[a[live]], a[live]), np.where(later, b[live], self.left[b[live]])
        return out

    def normal(self, text: str) -> str:
        """The sentence of a text: white space marks, and one in front if the model asks for it."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.prefix else "") + text.replace(" ", MARK)

    def encode(self, texts: list[str], sums: bool | None = None) -> list[np.ndarray]:
        """The piece ids of each text: for BPE models the path of pieces that fit, for Unigram ones (or where asked: `sums`) that of the best sum."""
        return self.encode_ways(texts, (not self.bpe if sums is None else sums,))[0]

    def encode_ways(self, texts: list[str], ways: tuple[bool, ...]) -> list[list[np.ndarray]]:
        """For each way (True: by sums), the piece ids of each text; the texts are split and their pieces looked up once."""
        out: list[list[np.ndarray]] = [[] for _ in ways]
        for at in range(0, len(texts), 256):
            split = [WORDS.findall(self.normal(t)) for t in texts[at : at + 256]]
            if ways not in self.known or self.known[ways].size() > CACHE:
                self.known[ways] = _Known(len(ways))
            known, words = self.known[ways], list(chain.from_iterable(split))
            new = sorted(set(words).difference(known.index), key=len)
            runs = [self._viterbi(w, ways) for w in self._batches(new)]
            known.add(new, [[r[k] for r in runs] for k in range(len(ways))])
            ends = np.cumsum([len(w) for w in split])
            for got, (ids, n) in zip(out, known.get(words)):
                got += np.split(ids, np.r_[0, np.cumsum(n)][ends][:-1])
        return out

    @staticmethod
    def _batches(words: list[str]):
        """Runs of words of equal lengths, of some STEP characters together."""
        sizes, at = np.fromiter(map(len, words), np.int64, len(words)), 0
        while at < len(words):
            end = min(int(np.searchsorted(sizes, sizes[at], "right")), at + max(1, STEP // int(sizes[at])))
            yield words[at:end]
            at = end

    def _bytes(self, ids: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each of n rows has); a negative id, an unknown character, becomes its bytes."""
        if (ids < 0).any():
            many = np.ones(len(ids), np.int64)
            odd = {int(c): [self.bytes[b] for b in chr(-1 - c).encode()] for c in np.unique(ids[ids < 0])}
            for c, own in odd.items():
                many[ids == c] = len(own)
            start = np.cumsum(many) - many
            wide, row = np.repeat(ids, many), np.repeat(row, many)
            for c, own in odd.items():
                at = start[ids == c]
                for k, b in enumerate(own):
                    wide[at + k] = b
            ids = wide
        return ids, np.bincount(row, minlength=n)

    def _found(self, x: np.ndarray, low: int, high: int, most: int) -> np.ndarray:
        """(high - low, most, n): by end (the first is low + 1) and size - 1, the piece of each word there; -1 for none. A character that
        is no piece is named by a negative number."""
        n = len(x)
        first = max(0, low - most + 1)
        part = x[:, first:high]
        out = np.full((high - low, most, n), -1, np.int32)
        out[:, 0] = self.of_char[part[:, low - first :]].T
        for size, (keys, ids, points) in self.sizes.items():
            if size == 1 or size > most or size > part.shape[1]:
                continue
            h = _hashes(part, size)
            at = np.minimum(np.searchsorted(keys, h.ravel()), len(keys) - 1)
            row, begin = np.divmod(np.flatnonzero(keys[at] == h.ravel()), h.shape[1])
            at, end = at[row * h.shape[1] + begin], first + begin + size
            same = end > low
            for k in range(size):
                same &= part[row, begin + k] == points[at, k]
            out[end[same] - low - 1, size - 1, row[same]] = ids[at[same]]
        return out

    def _viterbi(self, words: list[str], ways: tuple[bool, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each way, the pieces of words of one length, end to end, and how many each word has."""
        n, length = len(words), len(words[0])
        x = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(n, length)
        most, every = min(self.longest, length), np.arange(n)
        kept = [(np.zeros((length + 1, n)), np.full((length + 1, n), -1, np.int32), np.zeros((length + 1, n), np.uint8)) for _ in ways]
        stretch = max(1, STEP // n)
        for low in range(0, length, stretch):
            found = self._found(x, low, min(length, low + stretch), most)
            for sums, (best, last, back) in zip(ways, kept):
                if sums:
                    gain = np.where(found >= 0, self.values[np.maximum(found, 0)], -np.inf)
                    gain[:, 0] = np.where(found[:, 0] >= 0, gain[:, 0], self.floor)
                for end in range(low + 1, low + len(found) + 1):
                    sizes, own = min(most, end), found[end - low - 1]
                    if sums:
                        score = best[end - sizes : end][::-1] + gain[end - low - 1, :sizes]
                    else:
                        score = np.full((sizes, n), -np.inf)
                        score[0] = np.where(own[0] < 0, 0.0, -np.inf)  # what is no piece never merges
                        size, row = np.nonzero(own[:sizes] >= 0)
                        a, b = last[end - 1 - size, row].astype(np.int64), own[size, row].astype(np.int64)
                        ok = self.reached[b]
                        ask = np.flatnonzero(ok & (a >= 0) & (size + 1 < end))
                        ok[ask] = self.fits(a[ask], b[ask])
                        score[size[ok], row[ok]] = 0.0
                    pick = sizes - 1 - score[::-1].argmax(axis=0)  # of equal ones the longest piece
                    best[end], last[end], back[end] = score[pick, every], own[pick, every], pick + 1
        out = []
        for best, last, back in kept:
            if not np.isfinite(best[length]).all():
                raise ValueError("a word has no path")
            rows, ends, ids, live, end = [], [], [], every, np.full(n, length)
            while len(live):
                e = end[live]
                rows.append(live), ends.append(e), ids.append(last[e, live])
                end[live] = e - back[e, live]
                live = live[end[live] > 0]
            rows, ends, ids = (np.concatenate(v) for v in (rows, ends, ids))
            order = np.argsort(rows * (length + 1) + ends, kind="stable")
            out.append(self._bytes(ids[order].astype(np.int64), rows[order], n))
        return out

    def decode(self, ids) -> str:
        """The text of piece ids; bytes that are no UTF-8 become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        kind = self.is_byte[ids]
        cuts = [0, *(np.flatnonzero(kind[1:] != kind[:-1]) + 1).tolist(), len(ids)]
        flat, out = ids.tolist(), []
        for a, b in zip(cuts, cuts[1:]):
            out.append(bytes(map(self.byte_of.__getitem__, flat[a:b])).decode(errors="replace") if a < b and kind[a] else "".join(map(self.text_of.__getitem__, flat[a:b])))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


class _Known:
    """Words with their pieces, end to end in one array for each way of splitting."""

    def __init__(self, ways: int):
        self.index: dict[str, int] = {}
        self.chars = 0
        self.kept = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(ways)]  # ids, counts, starts

    def size(self) -> int:
        return len(self.index) + self.chars + sum(len(ids) for ids, _, _ in self.kept)

    def add(self, words: list[str], found: list[list[tuple[np.ndarray, np.ndarray]]]) -> None:
        """found: for each way, (ids, how many each word has) of consecutive runs of the words."""
        if not words:
            return
        self.chars += sum(map(len, words))
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words))))
        for k, (runs, (ids, n, start)) in enumerate(zip(found, self.kept)):
            more = np.concatenate([c for _, c in runs])
            self.kept[k] = np.concatenate([ids, *(i.astype(np.int32) for i, _ in runs)]), np.concatenate([n, more]), np.concatenate([start, len(ids) + np.cumsum(more) - more])

    def get(self, words: list[str]):
        """For each way: the pieces of all words, how many each has."""
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        for ids, counts, start in self.kept:
            n = counts[at]
            before = np.cumsum(n) - n
            yield ids[np.repeat(start[at] - before, n) + np.arange(n.sum())].astype(np.int64), n


def _hashes(points: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` characters of each row."""
    many = points.shape[1] - size + 1
    h = np.zeros((len(points), many), np.uint64)
    for k in range(size):
        h = h * BASE + points[:, k : k + many] + np.uint64(1)
    return h


@lru_cache(2)
def model(file: str) -> Model:
    return Model(file)


def encode_documents(docs: DataFrame, file: str, keep_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_pieces, ids_digest (XXH64 of the ids as little-endian int32, hex), round_trip
    (decoding gives the sentence back), n_unigram, unigram_digest, unigram_score, and ids where `keep_ids`.

    n_pieces, ids and ids_digest are the model's own encoding, as its library gives it: for a BPE model the Viterbi path
    whose pieces fit. The unigram columns are the path with the best sum of the model's scores, as
    the library gives it for the same pieces as a Unigram model. Null and empty texts have no pieces. Texts are read
    whole, words of any length; repeated rows are encoded each; other columns are not read; an empty table gives no rows.
    """
    schema = "doc_id long, n_pieces long, ids_digest string, round_trip boolean, n_unigram long, unigram_digest string, unigram_score double" + ", ids array<int>" * keep_ids

    def run(batches):
        m = model(file)
        scores = np.array(m.scores)
        scores[list(m.bytes.values())] = 0.0
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [t or "" for t in part.column("text").to_pylist()]
                own, best = m.encode_ways(texts, (not m.bpe, True))
                want = [m.normal(t).replace(MARK, " ")[m.prefix :] for t in texts]
                trip = [m.decode(x) == w for x, w in zip(own, want)]
                digest = [pa.array([xxhash.xxh64_hexdigest(x.astype("<i4").tobytes()) for x in ids]) for ids in (own, best)]
                size = [pa.array([len(x) for x in ids], pa.int64()) for ids in (own, best)]
                cols = [part.column("doc_id"), size[0], digest[0], pa.array(trip), size[1], digest[1], pa.array([float(scores[x].sum()) for x in best])]
                if keep_ids:
                    cols.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in schema.split(", ")])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
