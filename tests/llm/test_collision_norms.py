"""Recall of op8_collision_ann where vectors aren't equally long."""

import numpy as np
import pytest

from bytelake.llm import collision
from tests.llm.test_vectors_and_warc import table


@pytest.mark.parametrize("kind", ["outlier", "spread"])
def test_recall_with_unequal_norms(spark, sf_dir, kind):
    v = np.array([r[0] for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/embeddings.parquet").orderBy("vec_id").select("embedding").collect()], float)
    if kind == "outlier":
        v[777] *= 6
    else:
        v *= np.exp(np.random.default_rng(5).normal(0, 0.3, (len(v), 1)))
    v = v.astype(np.float32).astype(float)
    got = {}
    for r in collision.collision_neighbours(table(spark, v.tolist())).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = []
    for a in range(0, len(v), 20):
        s = v @ v[a]
        s[a] = -np.inf
        recall.append(len(got[a] & set(np.argsort(-s, kind="stable")[:20].tolist())) / 20)
    print("recall", kind, np.mean(recall), min(recall))
    assert np.mean(recall) >= 0.9
