"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are windows of 2, 3 and 4 bytes of the text, white space and other ASCII that is no letter made one blank. Each
hashes to a row of an embedding table; the mean of a text's rows goes through a linear softmax. Training is
stochastic gradient descent in numpy on a bounded sample of labelled rows, in one task, so the driver gets no texts; a temperature and a
rejection threshold are fitted on a part of the sample that was held back. Embedding and softmax being linear, prediction sums one number per subword
and language.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytelake.llm.shared import bounded_batches, remainder

SAMPLE = 6000  #: documents that are learnt from, at most; of each language the least by a hash of their id, so random ones
LANGUAGES, RARE = 500, 4  #: languages that are learnt, at most, the most frequent; one part in RARE of the sample is dealt to all of them alike
SAMPLE_BYTES = 20_000  #: of longer labelled rows the sample has PIECES pieces spread over the whole text, of so many bytes together at most (prediction reads all texts whole)
PIECES = 8
BUCKETS, DIM, EPOCHS, RATE, BATCH = 1 << 14, 16, 12, 4.0, 32
REJECTED = 0.001  #: share of rightly classified held-back documents that rejection may cost, at most
CALIBRATED = 30  #: with fewer rightly classified held-back documents nothing is rejected by score or by unseen subwords
DEVIATIONS = 3.1  #: a normal tail of REJECTED, where too few documents are held back to show it
SEEN_BITS = 22  #: subwords of the training rows are remembered by a hash of so many bits
LETTER = regex.compile(r"\p{L}")
_MAP = np.full(256, 32, np.uint8)
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)


def windows(data: bytes) -> np.ndarray:
    """A hash of SEEN_BITS bits of every window; its upper bits are the window's bucket."""
    x = _MAP[np.frombuffer(data, np.uint8)]
    if len(x):
        x = x[np.r_[True, (x[1:] != 32) | (x[:-1] != 32)]]
    x = np.concatenate([[32], x, [32]]).astype(np.uint32)
    two = x[:-1] << np.uint32(8) | x[1:]
    three = two[:-1] << np.uint32(8) | x[2:]
    four = three[:-1] << np.uint32(8) | x[3:]
    keys = np.concatenate([two * np.uint32(7) + np.uint32(1), three * np.uint32(3), four])
    return keys * np.uint32(2654435761) >> np.uint32(32 - SEEN_BITS)


def subwords(data: bytes) -> np.ndarray:
    """The bucket of every window."""
    return windows(data) >> np.uint32(SEEN_BITS - BUCKETS.bit_length() + 1)


@dataclass
class Model:
    """logits[bucket, language]: what each subword adds; a text's logits are their mean over the temperature."""

    langs: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = -math.inf  #: the least log-odds of the best language, before rounding to a probability, of a text that is accepted
    seen: np.ndarray | None = None  #: one bit a subword hash
    unseen: float = 1.0  #: the largest share of subwords that training didn't see in a text that is accepted

    def unseen_share(self, data: bytes) -> float:
        if self.seen is None:
            return 0.0
        new, n = 0, 0
        for at in range(0, len(data), 1 << 20):
            w = windows(data[max(0, at - 3) : at + (1 << 20)])
            new += int((self.seen[w >> np.uint32(3)] >> (w & np.uint32(7)).astype(np.uint8) & 1 == 0).sum())
            n += len(w)
        return new / max(n, 1)

    def logits_of(self, data: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for at in range(0, len(data), 1 << 20):  # windows overlap by 3 bytes
            found = np.bincount(subwords(data[max(0, at - 3) : at + (1 << 20)]), minlength=BUCKETS)
            total += found @ self.logits
            n += found.sum()
        return (total / max(n, 1) + self.bias) / self.temperature

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected); `und` with score 0 for a text that is null or has no letter."""
        if text is None or not LETTER.search(text) or not self.langs:
            return "und", 0.0, True
        data = text.encode()
        z = self.logits_of(data)
        best, odds = int(z.argmax()), float(margins(z[None])[0])
        return self.langs[best], 1 / (1 + math.exp(-odds)), bool(odds < self.threshold or self.unseen_share(data) > self.unseen)


def margins(z: np.ndarray) -> np.ndarray:
    """The log-odds of the largest logit of each row, against all others together; infinite if there are none."""
    z = np.sort(z, axis=1)
    if z.shape[1] < 2:
        return np.full(len(z), np.inf)
    return z[:, -1] - z[:, -2] - np.log(np.exp(z[:, :-1] - z[:, -2:-1]).sum(axis=1))


def seen(texts) -> np.ndarray:
    """A bit for each subword hash that the texts hold."""
    found = np.zeros(1 << SEEN_BITS, bool)
    for text in texts:
        found[windows(text.encode())] = True
    return np.packbits(found, bitorder="little")


class Batch:
    """Some rows' buckets and shares, kept sparse: `dense` makes the matrix that one step needs."""

    def __init__(self, feats: list):
        found, held = np.concatenate([f[0] for f in feats]), np.zeros(BUCKETS, bool)
        held[found] = True
        self.ids = np.flatnonzero(held)
        self.col, self.row = (np.cumsum(held) - 1)[found], np.repeat(np.arange(len(feats)), [len(f[0]) for f in feats])
        self.share, self.y = np.concatenate([f[1] for f in feats]), np.array([f[2] for f in feats])

    def dense(self) -> np.ndarray:
        out = np.zeros((len(self.y), len(self.ids)), np.float32)
        out[self.row, self.col] = self.share
        return out


def gradients(table, weight, bias, ids, shares, y):
    """The summed cross-entropy's gradients by the rows `ids` of the table, by the weights and by the bias."""
    mean = shares @ table[ids]
    z = mean @ weight + bias
    g = np.exp(z - z.max(axis=1, keepdims=True))
    g /= g.sum(axis=1, keepdims=True)
    g[np.arange(len(y)), y] -= 1
    return shares.T @ (g @ weight.T), mean.T @ g, g.sum(axis=0)


def step(table, weight, bias, ids, shares, y, rate: float) -> None:
    """One step of gradient descent on a batch, in place."""
    by_table, by_weight, by_bias = gradients(table, weight, bias, ids, shares, y)
    table[ids] -= rate * by_table
    weight -= 0.05 * rate * by_weight
    bias -= 0.01 * rate * by_bias


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model of (text, lang) rows. A tenth of them is held back for the temperature and the threshold."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    feats = []
    for text, lang in rows:
        ids, n = np.unique(subwords(text.encode()).astype(np.uint16), return_counts=True)
        feats.append((ids, (n / n.sum()).astype(np.float32), langs.index(lang)))
    order = rng.permutation(len(feats))
    back, learn = order[: len(feats) // 10], order[len(feats) // 10 :]
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weight, bias = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    batches = [learn[at : at + BATCH] for at in range(0, len(learn), BATCH)]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for k in rng.permutation(len(batches)):
            b = Batch([feats[i] for i in batches[k]])  # made anew each time: all of them at once take some times the room of the rows
            step(table, weight, bias, b.ids, b.dense(), b.y, rate)
    model = Model(langs, (table @ weight).astype(np.float64), bias.astype(np.float64))
    held = [(model.logits[ids].T @ n + model.bias, y) for ids, n, y in (feats[i] for i in back)]
    if held:
        z, y = np.array([a for a, _ in held]), np.array([b for _, b in held])

        def loss(t):
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

        model.temperature = min((0.25 * 1.25**k for k in range(-20, 20)), key=loss)
        s = z / model.temperature
        right = s.argmax(axis=1) == y
        if right.sum() >= CALIBRATED:  # the margin and the unseen share that all but REJECTED of the right ones keep to
            margin = np.sort(margins(s[right]))
            if np.isfinite(margin).all():
                model.threshold = float(min(margin[math.floor(REJECTED * len(margin))], margin.mean() - DEVIATIONS * margin.std()))
            model.seen = seen(rows[i][0] for i in learn)
            share = np.sort([model.unseen_share(rows[i][0].encode()) for i, ok in zip(back, right) if ok])[::-1]
            model.unseen = float(max(share[math.floor(REJECTED * len(share))], share.mean() + DEVIATIONS * share.std()))
    return model


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from text and lang of a bounded sample of the documents whose crc32(doc_id) mod 4 isn't 2.

    The sample is stratified: of `sample` rows one part in RARE goes to the languages alike, the rest by their counts, so a rare
    language is learnt like others; of more than LANGUAGES languages the rarest are not. A language's count sets the share of
    hashes that is drawn, so what all tasks together send stays near `sample` rows on any number of partitions. One task, which
    so gets `sample` rows of SAMPLE_BYTES at most, trains on them and returns the model."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("lang is not null").where(remainder(F.col("doc_id"), 4) != 2).withColumn("h", F.xxhash64("doc_id"))
    rows = rows.where(F.col("text").isNotNull() & (F.col("text") != ""))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return train([])
    total = sum(counts.values())
    quota = {lang: min(n, sample // RARE // len(counts) + (sample - sample // RARE) * n // total) for lang, n in counts.items()}
    told = lambda values: F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[F.col("lang")]
    most = {lang: (1 << 62) - 1 if q == counts[lang] else int(min(1.0, 1.3 * (q + 10) / counts[lang]) * ((1 << 62) - 1)) for lang, q in quota.items()}
    rows = rows.where(F.shiftrightunsigned("h", 2) <= told(most))
    size = SAMPLE_BYTES // 4 // PIECES - 1  # characters of at most 4 bytes, and a line end each
    pieces = [F.substring("text", F.floor((F.length("text") - size) * i / (PIECES - 1)).cast("int") + 1, F.lit(size)) for i in range(PIECES)]
    rows = rows.withColumn("text", F.when(F.octet_length("text") <= SAMPLE_BYTES, F.col("text")).otherwise(F.concat_ws("\n", *pieces)))
    drawn = rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= told(quota))

    def learn(batches):
        own = [row for b in batches for row in zip(b.column("text").to_pylist(), b.column("lang").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(own))], pa.binary())], ["model"])

    found = drawn.select("h", "lang", "text").repartition(1).sortWithinPartitions("h", "lang", "text").mapInArrow(learn, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else train([])


def language(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1), rejected.

    `und` with score 0 where the text is null or has no letter, or nothing could be learnt. Rejected: `und`, or a
    calibrated score under the model's threshold, or more subwords that training didn't see than the model accepts. Texts are read whole; repeated rows are predicted each; a null
    doc_id isn't held out; other columns are not read; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    model = model or fit(docs)

    def run(batches):
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([x for x, _, _ in found], pa.string()), pa.array([x for _, x, _ in found], pa.float64()), pa.array([x for _, _, x in found], pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of `docs`, all columns, whose text isn't rejected (see `language`; null, empty and letterless texts are).

    Texts are read whole, of any length; equal texts fare alike, whatever their ids; rows that repeat or lack a doc_id are
    kept or not by their own text; columns may have any names; an empty table gives no rows."""
    bounded_batches(docs.sparkSession)
    model = model or fit(docs)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([not model.predict(t.as_py())[2] for t in b.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
