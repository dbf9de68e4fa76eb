"""Vector searches against brute force; WARC packages against zipfile and hashlib."""

import base64
import hashlib
import io
import zipfile

import numpy as np
import pytest

from bytelake.llm import blocks, collision, impact, warczip


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "clash") for i, v in zip(ids or range(len(vectors)), vectors)], "vec_id long, embedding array<float>, score int, rank string")


def valid(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def odd_vectors(n=300, dims=8, seed=0):
    r = np.random.default_rng(seed)
    v = [list(map(float, np.float32(x))) for x in r.normal(0, 0.3, (n, dims))]
    v[7], v[8], v[9], v[15], v[11] = None, [], [float("nan")] * dims, [None] * dims, v[12]
    v[25], v[13] = list(v[14]), [0.0] * dims
    return v


@pytest.mark.parametrize("stripe,batch", [(8192, 2048), (37, 2)])
def test_impact_is_exact(spark, stripe, batch, monkeypatch):
    search = blocks.block_search
    monkeypatch.setattr(impact, "block_search", lambda *a: search(*a, stripe, batch))
    v = odd_vectors()
    got = impact.impact_top_k(table(spark, v), 25, 5).collect()
    q = {i: np.floor(256 * np.array(x)) for i, x in enumerate(v) if valid(x)}
    want = []
    for a in q:
        if a % 25 == 0:
            best = sorted((-int(q[a] @ q[b]), b) for b in q if b != a)[:5]
            want += [(a, k + 1, b, -s) for k, (s, b) in enumerate(best)]
    assert sorted(map(tuple, got)) == want
    assert impact.impact_top_k(table(spark, [])).count() == 0
    assert sorted(map(tuple, impact.impact_top_k(table(spark, [[1.0], [2.0], [2.0]])).collect())) == [(0, 1, 1, 256 * 512), (0, 2, 2, 256 * 512)]


def test_impact_on_ties_and_signs():
    r = np.random.default_rng(4)
    for x in (r.integers(-3, 3, (500, 5)), -np.abs(r.integers(0, 90, (400, 6))), np.zeros((50, 4)), r.integers(-200, 200, (900, 64))):
        x = x.astype(float)
        index = impact.ImpactIndex(np.arange(len(x)), x)
        for a in range(0, len(x), 29):
            ids, scores = index.search(x[a], 5, a)
            want = sorted((-int(x[a] @ x[b]), b) for b in range(len(x)) if b != a)[:5]
            assert [(-s, i) for i, s in zip(ids.tolist(), scores.tolist())] == want


def test_impact_beyond_doubles():
    x = np.array([[1e7, 1.0], [2e7, 3.0], [-3e7, 2.0], [2e7, 4.0]]) * 256
    ids, scores = impact.ImpactIndex(np.arange(4), x).search(np.array([1e5, 1.0]) * 256, 3, 0)
    assert list(zip(ids.tolist(), scores.tolist())) == sorted(((i, int(x[i][0]) * 25_600_000 + int(x[i][1]) * 256) for i in (1, 2, 3)), key=lambda t: -t[1])
    with pytest.raises(OverflowError):
        impact.ImpactIndex(np.arange(4), x).search(x[0] * 1e4, 1)


def test_repeated_query_ids(spark):
    """Of rows that repeat a query's vec_id the least vector is asked."""
    df = table(spark, [[1.0, 0.0], [0.0, 1.0], [1.0, 0.5], [0.5, 1.0]], [100, 100, 1, 2])
    assert [tuple(r) for r in impact.impact_top_k(df).collect()] == [(100, 1, 2, 65536), (100, 2, 1, 32768)]
    assert [r["vec_id"] for r in collision.collision_neighbours(df).collect()] == [2, 1]


@pytest.mark.parametrize("stripe", [16_384, 700])
def test_collision_recall(spark, sf_dir, stripe, monkeypatch):
    monkeypatch.setattr(collision, "STRIPE", stripe)
    df = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    got = {}
    for r in collision.collision_neighbours(df).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = (r["rank"], r["score"])
    ids = np.array(sorted(rows))
    m = np.stack([rows[i] for i in ids])
    recall = []
    for a in ids[ids % 20 == 0].tolist():
        s = m @ rows[a]
        s[ids == a] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]].tolist()
        recall.append(len(set(want) & set(got[a])) / 20)
        assert sorted(k for k, _ in got[a].values()) == list(range(1, 21))
        assert all(abs(x - rows[a] @ rows[b]) < 1e-12 for b, (_, x) in got[a].items())
    assert np.mean(recall) >= 0.9


def test_collision_odd_rows(spark):
    v = odd_vectors(40)
    got = collision.collision_neighbours(table(spark, v), 20, 20).collect()
    q = {i: np.array(x) for i, x in enumerate(v) if valid(x) and any(x)}
    want = [(a, b) for a in (0, 20) for b in sorted((b for b in q if b != a), key=lambda b: (-float(collision.inner(q[b][None], q[a])[0]), b))[:20]]
    assert [(r["query_id"], r["vec_id"]) for r in sorted(got, key=lambda r: (r["query_id"], r["rank"]))] == want
    assert collision.collision_neighbours(table(spark, [])).count() == 0


def package(members, zip64):
    out = io.BytesIO()
    p = warczip.Package(out, zip64)
    for name, data in members.items():
        p.add(name, data)
    p.close()
    return out.getvalue()


@pytest.mark.parametrize("zip64", [False, True])
def test_package_is_a_zip(zip64):
    members = {"archive/a.warc": b"x" * 1000, "indexes/a.cdxj": b"", "é.txt": bytes(range(256))}
    raw = package(members, zip64)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == members
    found = warczip.directory(io.BytesIO(raw), len(raw))
    assert {n: raw[at : at + size] for n, _, at, size, _ in found} == members
    with pytest.raises(ValueError):
        warczip.directory(io.BytesIO(raw[:-3]), len(raw) - 3)


def test_reads_what_zipfile_wrote():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"a comment PK\5\6 with a mark"
        for name, data in (("a", b"1234"), ("b/c", b"")):
            with z.open(name, "w", force_zip64=True) as f:
                f.write(data)
    raw = out.getvalue()
    assert [(n, raw[at : at + size]) for n, _, at, size, _ in warczip.directory(io.BytesIO(raw), len(raw))] == [("a", b"1234"), ("b/c", b"")]


def test_warc_round_trip(spark):
    html = ["<p>a</p>", None, "", "é" * 40, "<p>a</p>", "WARC/1.1\r\n\r\n", "x" * 100_000, "<p>a</p>"]
    rows = [(10 - i, f"http://x/{i}\r\nInjected: y" if i else None, h, "clash") for i, h in enumerate(html)] + [(None, "u", "<p>a</p>", "c"), (3, "u", "<p>a</p>", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, d string")
    for zip64 in (False, True):
        got = warczip.warc_round_trip(df).collect()
        assert len(got) == len(rows)
        for r in got:
            h = next((b or "").encode() for a, _, b, _ in rows if a == r["page_id"])
            assert (r["payload_bytes"], r["payload_digest"]) == (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode())
            least = min(a for a, _, b, _ in rows if a is not None and (b or "").encode() == h)
            want = ("response", None) if r["page_id"] == least else ("revisit", least)
            assert (r["record_type"], r["refers_to"]) == want and (r["payload"] == h if want[1] is None else r["payload"] is None)
    assert warczip.warc_round_trip(df.limit(0)).count() == 0


def test_plain_members_are_read(spark, tmp_path):
    payload = b"<p>plain</p>"
    r = warczip.record("response", "http://x", payload, {"WARC-Page-ID": "7"})
    index = b'{"offset": 0, "length": %d, "page": 7}\n' % len(r)
    (tmp_path / "a.zip").write_bytes(package({"archive/data-00000.warc": r, "indexes/data-00000.cdxj": index}, False))
    got = warczip.read_records(warczip.locate(spark.createDataFrame([(f"file://{tmp_path}/a.zip",)], "path string"))).collect()
    assert [(x["page_id"], bytes(x["payload"]), x["record_type"]) for x in got] == [(7, payload, "response")]
    assert warczip.parse(warczip.gzipped(r)) == warczip.parse(r)
