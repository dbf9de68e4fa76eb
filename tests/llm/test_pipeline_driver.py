"""What the pipeline's stages leave to the driver: no training, few tasks, few pairs."""

import os
import random

import numpy as np

from bytelake.llm import langid, simhash
from bytelake.llm.components import components
from tests.llm.test_documents import frame


def test_the_driver_does_not_train(spark, monkeypatch):
    rows = [(i, f"{w} {i} " * 20, lang) for i in range(400) for w, lang in [(("the house", "en"), ("das haus", "de"))[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def here(rows):
        assert os.getpid() != driver, "training in the driver"
        return real(rows)

    real, driver = langid.train, os.getpid()
    monkeypatch.setattr(langid, "train", here)
    model = langid.fit(docs)
    assert model.langs == ["de", "en"] and [model.predict(t)[0] for t in ("the house", "das haus")] == ["en", "de"]
    monkeypatch.undo()
    assert langid.fit(docs.where("doc_id < 0")).langs == []


def test_batches_are_dense_as_by_unique():
    r = np.random.default_rng(2)
    feats = [(np.unique(r.integers(0, langid.BUCKETS, 300).astype(np.uint16)), None, 1) for _ in range(32)]
    feats = [(ids, r.random(len(ids)).astype(np.float32), y) for ids, _, y in feats]
    b, every = langid.Batch(feats), np.unique(np.concatenate([f[0] for f in feats]))
    full = np.zeros((32, langid.BUCKETS), np.float32)
    for k, (ids, share, _) in enumerate(feats):
        full[k, ids] = share
    assert np.array_equal(b.ids, every) and np.array_equal(b.dense(), full[:, every])


def test_few_edges_in_one_task(spark):
    r = random.Random(5)
    pairs = [(r.randrange(-400, 400), r.randrange(-400, 400)) for _ in range(350)] + [(i, i + 1) for i in range(1000, 1300)] + [(7, 7), (None, 3), (5, None)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    rounds = sorted(map(tuple, components(edges).collect()))
    assert len(rounds) > 600 and rounds == sorted(map(tuple, components(edges, few=10_000).collect()))
    assert rounds == sorted(map(tuple, components(edges, few=5).collect())) and not components(edges.limit(0), few=5).count()


def test_marks_never_lose_a_pair(spark):
    r, rows, similar = np.random.default_rng(6), [], []
    for n in (1, 2, 9, 40, 300, 3000):
        for share in (0, 0.05, 0.1, 0.12, 0.2, 0.4, 1):
            x = r.integers(0, 1 << 63, n).astype(np.uint64)
            y = np.unique(np.concatenate([x[round(n * share) :], r.integers(0, 1 << 63, round(n * share)).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            assert sum(map(int.bit_count, map(int, (simhash.marks(x) ^ simhash.marks(y)).view(np.uint64)))) <= len(np.setxor1d(x, y))
            similar.append(both >= 0.8 * (len(np.unique(x)) + len(y) - both))
            rows.append((len(rows), len(np.unique(x)), simhash.marks(x).tolist(), len(y), simhash.marks(y).tolist()))
    df = spark.createDataFrame(rows, "id long, an long, am array<long>, bn long, bm array<long>")
    df = df.selectExpr("id", "struct(an as n, am as marks) as a", "struct(bn as n, bm as marks) as b")
    kept = {x["id"] for x in df.where(simhash.may_be_similar(0.8)).collect()}
    assert {i for i, ok in enumerate(similar) if ok} <= kept and len(kept) < len(rows) - 10


def test_tasks_of_the_near_copy_stage(spark):
    """A chain of near copies needs star rounds of all partitions, or one task."""
    r, words, texts = random.Random(8), [f"w{i}" for i in range(200)], []
    for _ in range(40):
        words = words[3:] + [f"x{r.randrange(9999)}" for _ in range(3)]
        texts.append(" ".join(words))
    sc, docs = spark.sparkContext, frame(spark, texts)
    sc.setJobGroup("near", "")
    spark.conf.set(coalesce := "spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert [x["doc_id"] for x in simhash.drop_near_duplicates(docs).collect()] == [0]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset(coalesce)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("near") for s in tracker.getJobInfo(j).stageIds}
    ran = [i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s))]
    print("tasks", sum(ran))
    assert 0 < sum(ran) < 600
