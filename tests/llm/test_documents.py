"""Operators on documents against brute force, the libraries, or round trips."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

from bytelake.llm import bpecount, components, ctw, langid, lenpack, linededup, simhash, spm
from bytelake.llm.ragged import Merges

def near_groups(texts):
    """(a root for each text, number of links): five-word shingles, Jaccard similarity of 0.8 or more, all pairs."""
    words = [(t or "").encode().lower().split() for t in texts]
    found, root, linked = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words], list(range(len(texts))), 0
    for i, x in enumerate(found):
        for j, y in enumerate(found[:i]):
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                linked += 1
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root, linked


WORDS = "the of and rain river stone light house green seven walk under paper cloud field music winter bread horse glass".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", ","]) for _ in range(n))


ODD = [None, "", "   \n\t ", "one", "two words", "\n\n", "ÉÀ straße 日本語 \U0001f600 x\x85y\x1cz", "a" * 5000, "x\r\ny\x0bz", "<|endoftext|> mid <|endoftext|>", "aaaa aaaaa  aaa   ", "՘Ᲊ new letters"]


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", "clash", 0) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, fp string, n long")


def brute_fp(text):
    w = (text or "").encode().lower().split()
    g = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_groups(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_golay_ball_keys_meet():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 23, 4000)
    a, b = r.integers(0, 23, (2, 4000))
    y = x ^ (1 << a) ^ np.where(a != b, 1 << b, 0)
    sets = [[set() for _ in x] for _ in range(2)]
    for own, v in zip(sets, (x, y)):
        for row, k in zip(*simhash.fuzzy(v)):
            own[row].add(int(k))
    assert all(p & q for p, q in zip(*sets))
    assert {len(s) for s in sets[0]} == {1, 6}
    words = np.arange(4096) << 11
    assert len(set(simhash.decode(np.arange(1 << 16)))) <= 4096 and (simhash.decode(words) < 4096).all()


@pytest.mark.parametrize("block", [1024, 7])
def test_links_find_all(spark, block):
    r = random.Random(5)
    fps = [r.getrandbits(64) for _ in range(60)]
    for f in list(fps):
        for _ in range(r.randrange(5)):
            fps.append(f ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    base = r.getrandbits(64)
    fps += [base ^ (1 << i) for i in range(0, 40)] + [base ^ (1 << i) ^ (1 << 63) ^ (1 << 62) ^ (1 << 61) for i in range(10)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in components.components(simhash.links(df, block)).collect()}
    want = brute_groups(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    classes = {}
    for s, w in zip(signed, want):
        classes.setdefault(got.get(s, s), set()).add(w)
    assert all(len(v) == 1 for v in classes.values()) and len(classes) == len(set(want))


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (None, 3), (7, 6)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_groups(spark):
    texts = [prose(i, 400) for i in range(12)]
    texts += [t + " tail" for t in texts[:6]] + [texts[0].upper(), texts[1]] + ODD
    rows = frame(spark, texts, [100 - i for i in range(len(texts))])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(rows).collect()}
    fps = [brute_fp(t) for t in texts]
    group = brute_groups(fps)
    for i, f in enumerate(fps):
        least = min(100 - j for j in range(len(fps)) if group[j] == group[i])
        assert got[100 - i] == (f"{f:016x}", least)
    assert simhash.simhash_groups(frame(spark, [])).count() == 0
    assert {r["component_id"] for r in simhash.simhash_groups(frame(spark, ["a", "a"], [None, None])).collect()} == {None}


def brute_ctw(train, text, depth):
    """The mixture written out: KT estimates by the recursion of the tree, one bit at a time."""
    counts = Counter()
    for t in train:
        data = b"\xff" * depth + t.encode() + b"\xff"
        for i in range(depth, len(data)):
            for b in range(8):
                for d in range(depth + 1):
                    counts[data[i - d : i], 1 << b | data[i] >> (8 - b), data[i] >> (7 - b) & 1] += 1
    children = {}
    for c, node, _ in counts:
        if len(c):
            children.setdefault((c[1:], node), set()).add(c)
    memo = {}

    def kt(c, node):
        n0, n1 = counts[c, node, 0], counts[c, node, 1]
        return float(ctw.log_kt(np.array([float(n0)]), np.array([float(n1)]))[0])

    def pw(c, node):
        if (c, node) not in memo:
            memo[c, node] = kt(c, node) if len(c) == depth else np.logaddexp(kt(c, node), sum(pw(x, node) for x in children.get((c, node), ()))) - np.log(2)
        return memo[c, node]

    total, data = 0.0, b"\xff" * depth + text.encode() + b"\xff"
    for i in range(depth, len(data)):
        for b in range(8):
            node, bit = 1 << b | data[i] >> (8 - b), data[i] >> (7 - b) & 1
            p, left = 0.0, 1.0
            for d in range(depth + 1):
                c = data[i - d : i]
                n = counts[c, node, 0] + counts[c, node, 1]
                share = 1.0 if d == depth else np.exp(kt(c, node) - np.log(2) - pw(c, node))
                p += left * share * (counts[c, node, bit] + 0.5) / (n + 1)
                left *= 1 - share
            total += np.log10(p)
    return total


def test_ctw_matches_the_recursion(spark):
    texts = [prose(i, 30) for i in range(14)] + ODD[:8]
    got = {r["doc_id"]: r for r in ctw.ctw_scores(frame(spark, texts), 4).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    train = [t or "" for i, t in enumerate(texts) if not held[i]]
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"], r["n_known"]) == (held[i], len(tokens(t)), n, sum(c[w] > 0 for w in tokens(t)))
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)))
    for i in (0, 3, 9, 14, 15, 17):
        assert got[i]["score"] == pytest.approx(brute_ctw(train, texts[i] or "", 4), rel=1e-9)
    assert ctw.ctw_scores(frame(spark, [])).count() == 0
    assert ctw.ctw_scores(frame(spark, ["only held"], [4])).count() == 1


def test_ctw_pieces_agree():
    text = prose(1, 3000)
    whole, parts = ([x for x in ctw.buffers([text, None, "a"], 5, p)] for p in (1 << 20, 500))
    assert len(parts) > 5
    for k in (1, 3):
        assert np.array_equal(np.concatenate([x[k] for x in whole]), np.concatenate([x[k] for x in parts]))


def test_ctw_beats_the_base_on_held_out(spark, sf_dir):
    got = ctw.ctw_scores(spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/documents.parquet")).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert got[0] > got[1]


def test_line_dedup(spark):
    long = ["This line is shared and longer than forty characters " + str(i) for i in range(4)]
    texts = []
    for i in range(30):
        own = [prose(i, 12), long[i % 4] if i < 18 else long[i % 4].upper(), "short shared line"]
        texts.append("\n".join(own + (["\t" + long[0] + "  "] if i % 2 else [])))
    texts += ODD
    got = {r["doc_id"]: r for r in linededup.dedup_lines(frame(spark, texts)).collect()}
    key = lambda x: x.encode().strip(b" \t\n\r\x0b\x0c").lower().decode()
    where = {}
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            where.setdefault(key(x), set()).add(i)
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 40 or len(where[key(x)]) < 5 or i == max(where[key(x)])]
        assert ((got[i]["text"] or ""), got[i]["n_lines"], got[i]["n_dropped"]) == ("\n".join(kept), len(lines), len(lines) - len(kept))
    rows = frame(spark, texts).withColumnsRenamed({"key": "_id", "fp": "_lost", "n": "_keep"})
    again = linededup.without_repeated_lines(rows)
    assert again.schema == rows.schema and {r["doc_id"]: r["text"] for r in again.collect()} == {i: r["text"] for i, r in got.items()}
    assert linededup.dedup_lines(frame(spark, [])).count() == 0
    assert linededup.dedup_lines(frame(spark, ["q" * 50] * 6, [None, 1, 2, 3, 4, 5])).where("n_dropped = 1").count() == 5


def runs(spark):
    store = linededup.LineRuns(spark)
    for b in range(5):
        store.add(spark.createDataFrame([(b * 10 + i, h, h) for i in range(3) for h in (1, b)], "doc_id long, h1 long, h2 long"))
    return store


def known(store):
    return {r["h1"]: (r["n_docs"], r["last_doc"]) for rows in store.known() for r in rows.collect()}


def test_runs_compact(spark):
    store = runs(spark)
    assert [len(x) for x in store.keys] == [1, 0, 1] and [len(x) for x in store.changes] == [0, 0, 1]
    assert known(store) == {0: (3, 2), 1: (15, 42), 2: (3, 22), 3: (3, 32), 4: (3, 42)}
    assert sum(spark.table(r).count() for level in store.keys for r in level) == 5
    own = store._write(spark.range(50).selectExpr("id h1", "id h2").groupBy("h1", "h2").agg(linededup.F.count("*").alias("n_docs"), linededup.F.max("h1").alias("last_doc")))
    plan = store.fresh(own)
    assert plan.count() == 45
    tree = plan._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in tree and "Exchange" not in tree  # rows of runs stay where they are
    store._drop([own])
    store.drop()


def test_runs_need_the_anti_join(spark, monkeypatch):
    monkeypatch.setattr(linededup.LineRuns, "fresh", lambda self, own: self.spark.table(own))
    assert known(store := runs(spark))[1] != (15, 42)
    store.drop()


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    both = langid.language(docs).withColumnRenamed("doc_id", "d").join(docs, docs["doc_id"] == langid.F.col("d")).where("held_out and lang is not null").selectExpr("avg(cast(lang_pred = lang as int))", "min(score)", "max(score)").first()
    assert both[0] > 0.95 and 0 <= both[1] <= both[2] <= 1
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.language(frame(spark, ODD + ["12 34 !?"]), model).collect()}
    for i in (0, 1, 2, 5, len(ODD)):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert langid.accepted(docs, model).count() > 0.97 * docs.count()
    assert langid.language(frame(spark, []).withColumn("lang", langid.F.lit(None).cast("string"))).count() == 0


def naive_language(model, text):
    """The prediction written out: every window's hash, its row of logits, their mean, the softmax."""
    data = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in text.encode())
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    data, z, n, new = b" " + data + b" ", np.zeros(len(model.langs)), 0, 0
    for size in (2, 3, 4):
        for i in range(len(data) - size + 1):
            key = int.from_bytes(data[i : i + size], "big")
            h = {2: key * 7 + 1, 3: key * 3, 4: key}[size] * 2654435761 % 2**32 >> 10
            z += model.logits[h >> 8]
            n += 1
            new += model.seen is not None and not model.seen[h >> 3] >> (h & 7) & 1
    z = (z / n + model.bias) / model.temperature
    p = np.exp(z - z.max())
    return model.langs[int(z.argmax())], float(p.max() / p.sum()), new / n


def test_language_against_the_naive_pass(spark):
    texts = [(" ".join(random.Random(i).choice(w) for _ in range(60)), y) for i in range(400) for w, y in ((WORDS, "en"), ([x[::-1] + "ë" for x in WORDS], "xx"))]
    model = langid.train(texts)
    for text in [t for t, _ in texts[:8]] + ["Rain  and\tRIVER", "é", "x", "日本語 テキスト です"]:
        lang, score, new = naive_language(model, text)
        got = model.predict(text)
        assert got[0] == lang and got[1] == pytest.approx(score, abs=1e-9) and model.unseen_share(text.encode()) == pytest.approx(new)
    assert model.predict("日本語 テキスト です")[2] and not model.predict(texts[3][0])[2]
    rows = [(i, t, y) for i, (t, y) in enumerate(texts)] + [(5000 + i, "zq jv kx " * 20, "rare") for i in range(4)] + [(6000, None, None), (None, "of the", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(docs, 100).langs == ["en", "rare", "xx"]  # a rare language isn't lost


def test_language_gradients():
    r = np.random.default_rng(1)
    table, weight, bias = r.normal(size=(9, 3)), r.normal(size=(3, 4)), r.normal(size=4)
    ids, shares, y = np.array([1, 4, 7]), r.dirichlet(np.ones(3), 5), r.integers(0, 4, 5)

    def loss():
        z = shares @ table[ids] @ weight + bias
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(5), y]).sum())

    found = langid.gradients(table, weight, bias, ids, shares, y)
    for array, at, want in [(table, (ids[i], j), found[0][i, j]) for i in range(3) for j in range(3)] + [(weight, (i, j), found[1][i, j]) for i in range(3) for j in range(4)] + [(bias, (j,), found[2][j]) for j in range(4)]:
        old, ends = array[at], []
        for e in (1e-5, -1e-5):
            array[at] = old + e
            ends.append(loss())
        array[at] = old
        assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(want, abs=1e-6)


def test_token_counts_match_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ODD + ["ab" * 4000, "\n" * 700, "= " * 300 + "é" * 999]
    got = {r["doc_id"]: r for r in bpecount.token_counts(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.json")).collect()}
    for i, text in enumerate(rows):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((text or "").encode()), n > 512)


def test_added_tokens_that_look_around_are_refused(tmp_path):
    import json

    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="around"):
        bpecount.Counter(str(tmp_path / "t.json"))


def test_merging_matches_one_at_a_time():
    r = random.Random(3)
    pairs = [(0, 0), (0, 1), (1, 1), (3, 3), (4, 0), (5, 4), (3, 0)]
    m = Merges([a for a, _ in pairs], [b for _, b in pairs], range(len(pairs)), range(3, 3 + len(pairs)))
    seqs = [[r.randrange(3) for _ in range(r.randrange(1, 30))] for _ in range(300)]
    symbols, seq = m.merge(np.array([x for s in seqs for x in s]), np.repeat(np.arange(len(seqs)), list(map(len, seqs))))
    for i, s in enumerate(seqs):
        while hits := [(pairs.index(p), k) for k, p in enumerate(zip(s, s[1:])) if p in pairs]:
            rank, k = min(hits)
            s[k : k + 2] = [3 + rank]
        assert symbols[seq == i].tolist() == s


def test_sentencepiece_matches_the_library(spark, sf_dir, tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    file = public_tokenizers.path("piece_bpe_32k.model")
    rows = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ODD + ["a  b   c    ", "▁▁x", "日本" * 50]
    lib, own = sentencepiece.SentencePieceProcessor(model_file=file), spm.Model(file)
    for text, ids in zip(rows, own.encode([t or "" for t in rows])):
        assert ids.tolist() == lib.encode(text or "")
        assert own.decode(ids) == lib.decode(ids.tolist())
    proto = pb.ModelProto()
    proto.ParseFromString(open(file, "rb").read())
    proto.trainer_spec.model_type = 1  # the same pieces as a Unigram model, with scores like logarithms of shares: the library's Viterbi
    for i, p in enumerate(proto.pieces):
        p.score = -5 - 10 * (i * 0.6180339887498949 % 1) - 0.5 * (p.type == 1 and len(p.piece) == 1)
    (other := tmp_path / "unigram.model").write_bytes(proto.SerializeToString())
    lib, uni = sentencepiece.SentencePieceProcessor(model_file=str(other)), spm.Model(str(other))
    assert not uni.bpe
    total, equal = (lambda ids: sum(uni.scores[i] for i in ids if i not in uni.byte_of)), []
    for text, ids in zip(rows, uni.encode([t or "" for t in rows])):
        want = lib.encode(text or "")
        equal.append(ids.tolist() == want)  # but for ties within the library's rounding: it adds up whole sentences in single precision
        assert equal[-1] or total(want) <= total(ids) + 1e-9 < total(want) + 1e-6 * total(want) ** 2
    assert np.mean(equal) > 0.9
    got = spm.encode_documents(frame(spark, rows), str(other)).collect()
    assert all(r["round_trip"] and r["ids_digest"] == r["unigram_digest"] for r in got)
    got = spm.encode_documents(frame(spark, rows), file).collect()
    assert all(r["round_trip"] for r in got) and {r["doc_id"]: len(r["ids"]) for r in got} == {r["doc_id"]: r["n_pieces"] for r in got}
    digest = lambda ids: xxhash.xxh64_hexdigest(np.array(ids, "<i4").tobytes())
    bpe = sentencepiece.SentencePieceProcessor(model_file=file)
    for r in got:
        text = rows[r["doc_id"]] or ""
        assert (r["n_pieces"], r["ids_digest"]) == (len(bpe.encode(text)), digest(bpe.encode(text)))


def test_pieces_of_unbroken_texts(monkeypatch):
    """Words of any length, in stretches, and of all kinds of characters, against the library."""
    import sentencepiece

    file = public_tokenizers.path("piece_bpe_32k.model")
    lib, own, r = sentencepiece.SentencePieceProcessor(model_file=file), spm.Model(file), random.Random(8)
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4000)), "".join(WORDS) * 30, "ab" * 900 + "c" * 901, "".join(chr(r.randrange(0x4E00, 0x5800)) for _ in range(500)), "aaaaaaa", "x" * 77]
    texts += ["".join(r.choice("aeinrst") for _ in range(r.randrange(1, 40))) for _ in range(4000)]
    want = lib.encode(texts)
    assert [x.tolist() for x in own.encode(texts)] == want
    monkeypatch.setattr(spm, "STEP", 50)
    again = spm.Model(file)
    assert [x.tolist() for x in again.encode(texts[:200])] == want[:200]
    assert not [p for p, i in own.id.items() if not own.reached[i] and lib.encode(p.replace("▁", " "))[-1:] == [i] and len(lib.encode(p.replace("▁", " "))) == 1]


def brute_padding(lengths, counts, buckets):
    from itertools import combinations

    x = sorted(zip(lengths, counts))
    best = None
    for k in range(1, min(buckets, len(x)) + 1):
        for ends in combinations(range(len(x)), k):
            if ends[-1] == len(x) - 1:
                cost = sum(c * x[min(e for e in ends if e >= i)][0] for i, (_, c) in enumerate(x))
                best = cost if best is None else min(best, cost)
    return best


def test_packing(spark):
    r = np.random.default_rng(2)
    lengths, counts = np.array([1, 3, 4, 9, 20, 21, 50, 64]), r.integers(1, 40, 8)
    ends = lenpack.boundaries(lengths, counts, 3)
    assert sum(c * min(e for e in ends if e >= x) for x, c in zip(lengths, counts)) == brute_padding(lengths, counts, 3)
    texts = [prose(i, int(n)) for i, n in enumerate(r.integers(0, 300, 200))] + ODD
    got = lenpack.pack(frame(spark, texts), window=100, buckets=4, budget=1000).collect()
    tokens = {}
    for x in got:
        assert x["n_tokens"] <= x["padded_to"] and x["start"] == 100 * x["seq_no"]
        tokens[x["doc_id"]] = tokens.get(x["doc_id"], 0) + x["n_tokens"]
    assert tokens == {i: sum(max(1, -(-len(w) // 16)) for w in (t or "").encode().split()) for i, t in enumerate(texts)}
    for end in {x["padded_to"] for x in got}:
        places = sorted((x["batch_no"], x["slot"]) for x in got if x["padded_to"] == end)
        many = max(1, 1000 // max(end, 1))
        assert places == [divmod(i, many) for i in range(len(places))]
    hist = Counter(x["n_tokens"] for x in got)
    assert {x["padded_to"] for x in got} == set(lenpack.boundaries(np.array(list(hist)), np.array(list(hist.values())), 4))
    assert lenpack.pack(frame(spark, [])).count() == 0


def test_pipeline(spark, tmp_path):
    """Every stage against brute force on its own input, the language model's predictions taken as they are."""
    import corpus_pipeline as cp

    shared = "A passage that many documents share, longer than forty characters by far"
    rows = [(i, prose(i, 200) + "\n" + shared, "en" if i % 3 else "fr", "s", 1) for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "s", 1) for i in range(5)] + [(200, None, None, "s", 0), (201, "12345", "en", "s", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = {i: t for i, t, *_ in rows if i < 200}
    last = max(want)
    steps = [dict(want)]
    steps.append(want := {i: t if i == last else t.split("\n")[0] for i, t in want.items()})
    ids = sorted(want)
    group, _ = near_groups([want[i] for i in ids])
    steps.append(want := {i: want[i] for k, i in enumerate(ids) if group.index(group[k]) == k})
    assert set(want) == set(range(40))
    for (_, stage), expected in zip(cp.STAGES, steps):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and {r["doc_id"]: r["text"] for r in out.collect()} == expected
        docs = out
    got = cp.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(t.split()) for i, t in want.items()}


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, odd texts, clashing columns, and an empty table."""
    import corpus_pipeline as cp

    names = "doc_id long, text string, lang string, source string, n_chars long, d long, key string, n long, _id long, root long"
    rows = [(i, t, None if i % 2 else "en", None, None, 1, "k", 2, 3, 4) for i, t in enumerate(ODD)] + [(None, prose(1, 30), "en", "s", 1, None, None, None, None, None)] * 2
    rows += [(50, prose(2, 40), "en", "s", 1, 1, "k", 1, 1, 1)] * 2 + [(49, prose(2, 40), "en", "s", 1, 1, "k", 1, 1, 1)]
    docs = spark.createDataFrame(rows, names)
    for _, stage in cp.STAGES[1:3]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        docs = out
    kept = [r["doc_id"] for r in docs.collect()]
    assert kept.count(None) == 2 and 50 not in kept and kept.count(49) == 1 and {0, 3, 4} <= set(kept) and not {1, 2, 5} & set(kept)
    spark.createDataFrame([], names).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
