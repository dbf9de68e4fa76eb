"""Junk and unseen scripts are rejected, clean held-out documents aren't; long rows are learnt from."""

import random

from bytelake.llm import langid
from bytelake.llm.shared import remainder
from tests.llm.test_documents import frame, prose


def test_junk_is_rejected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet")
    model, r = langid.fit(docs), random.Random(1)
    held = docs.where(remainder(langid.F.col("doc_id"), 4) == 2).where("lang is not null and text <> ''").limit(1000).collect()
    assert sum(not model.predict(x["text"])[2] for x in held) >= 0.98 * len(held)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшщыэюя", "的一是不了人我在有他这中大来上国", "0123456789abcdef"):
        junk = [" ".join("".join(r.choice(letters) for _ in range(r.randrange(3, 12))) for _ in range(60)) for _ in range(100)]
        share = sum(model.predict(t)[2] for t in junk) / len(junk)
        print("rejected", letters[:3], share)
        assert share > 0.9


def test_long_rows_are_learnt_from(spark):
    texts = [prose(i, 4500) for i in range(12)] + [" ".join("zug baum haus weg".split()[(i + j) % 4] for j in range(6000)) for i in range(12)]
    rows = frame(spark, texts).withColumn("lang", langid.F.when(langid.F.col("doc_id") < 12, "en").otherwise("de"))
    assert min(map(len, texts)) > langid.SAMPLE_BYTES and langid.fit(rows).langs == ["de", "en"]
    assert {r["doc_id"]: r["lang_pred"] for r in langid.language(rows).collect()} == {i: "en" if i < 12 else "de" for i in range(24)}
