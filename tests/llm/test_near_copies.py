"""The pipeline's near-copy stage against all pairs."""

import random

import numpy as np
import xxhash

import corpus_pipeline
from bytelake.llm import simhash
from tests.llm.test_documents import ODD, frame, near_groups


def edited(r, text, share):
    return " ".join(f"w{r.randrange(9999)}" if r.random() < share else w for w in text.split())


def test_near_copies_of_ordinary_texts(spark):
    r = random.Random(3)
    base = [" ".join(f"w{r.randrange(9999)}" for _ in range(r.randrange(60, 300))) for _ in range(60)]
    texts = base + [edited(r, t, s) for t in base for s in (0.005, 0.01, 0.02, 0.04, 0.08)] + ODD
    texts += [edited(r, base[0], 0.015) for _ in range(150)]  # a bucket of over BIG members, whose centre isn't near to all
    root, linked = near_groups(texts)
    assert linked > 500
    assert {x["d"] for x in simhash.near_copy_groups(frame(spark, ["a b", "c d"]))[0].collect()} == {int(np.uint64(xxhash.xxh64_intdigest(simhash.shingles(t).tobytes(), 3)).astype(np.int64)) for t in ("a b", "c d")}
    rows = frame(spark, texts, [1000 - i for i in range(len(texts))])
    keep = {max(i for i in range(len(texts)) if root[i] == k) for k in set(root)}
    got = corpus_pipeline.near_duplicates(spark, rows, "")
    assert got.columns == rows.columns and {x["doc_id"] for x in got.collect()} == {1000 - i for i in keep}
    assert simhash.drop_near_duplicates(frame(spark, [])).count() == 0
    assert simhash.drop_near_duplicates(frame(spark, ["a", "a", "A", "b"], [None, None, 4, 5])).count() == 4


def test_soft_decoding():
    r = np.random.default_rng(4)
    sums = r.integers(-300, 300, (500, 23))
    index, score = simhash.nearest(sums)
    every = sums @ simhash._codewords()
    assert np.array_equal(np.take_along_axis(every, index, 1), score) and np.array_equal(score, -np.sort(-every, axis=1)[:, : simhash.FEW])
    assert np.array_equal(simhash.nearest((2 * (np.arange(4096)[:, None] & 0) + simhash._codewords().T).astype(int))[0][:, 0], np.arange(4096))
    hard = simhash.decode(((sums > 0) << np.arange(23)).sum(axis=1))
    flat = simhash.nearest(np.where(sums > 0, 1, -1))[0]
    assert np.array_equal(hard, flat[:, 0])


def test_keys_are_the_best_sums():
    r = np.random.default_rng(5)
    rows = r.normal(size=(20, 23 * simhash.SEGMENTS)).astype(np.float32)
    got = simhash.fuzzy_keys(rows).reshape(20, len(simhash.TRIPLES), simhash.KEYS)
    index, score = (x.reshape(20, simhash.SEGMENTS, -1) for x in simhash.nearest(rows.reshape(-1, 23)))
    for i in range(20):
        for t, (a, b, c) in enumerate(simhash.TRIPLES):
            every = sorted(((float(score[i, a, x] + score[i, b, y] + score[i, c, z])), int(index[i, a, x] | index[i, b, y] << 12 | index[i, c, z] << 24 | t << 36)) for x in range(6) for y in range(6) for z in range(6))
            assert {k for _, k in every[-simhash.KEYS :]} == set(got[i, t].tolist())


def test_sums_and_pieces(monkeypatch):
    text = " ".join(f"w{i * i % 977}" for i in range(30_000))
    whole = simhash.shingles(text)
    monkeypatch.setattr(simhash, "PIECE", 1000)
    assert np.array_equal(whole, simhash.shingles(text))
    longs = -(-23 * simhash.SEGMENTS // 64)
    h = simhash._mix(whole[:, None] * simhash._C[32 : 32 + longs] + np.arange(1, longs + 1, dtype=np.uint64))
    bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").astype(int)
    assert np.array_equal((2 * bits - 1).sum(axis=0), simhash.sums(whole))
