"""Toxicity, quality and language-model scores."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import language_model as M
from gridloom.llm import quality as Q
from gridloom.llm import toxicity as X

LARGER = "/root/testdata/sf0.1"


def accuracy(spark, rows, label):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    return tuple(np.mean([p for p, y in held if y == v]) for v in (1, 0))


def test_toxicity_held_out(spark):
    hit, wrong = accuracy(spark, X.op1_toxicity(spark, LARGER).collect(), "toxic")
    assert hit > 0.8 and wrong < 0.02


def test_quality_held_out(spark):
    hit, wrong = accuracy(spark, Q.op3_quality(spark, LARGER).collect(), "quality")
    assert hit > 0.98 and wrong < 0.1


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(0)
    data = [(int(i % 2), np.unique(np.append(rng.integers(10, 1000, 30), [3] if i % 2 else [4]))) for i in range(400)]
    w = X.ftrl(data, bits=10, epochs=3)
    assert w[3] > 1 and w[3] > np.abs(w[10:1000]).max() and (w[:-1] != 0).mean() < 0.5


def test_forest_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(2000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    f = Q.boost(x, y, rounds=30, depth=3)
    assert ((Q.traverse(f, x) > 0.5) == y).mean() > 0.97
    assert len(Q.traverse(f, x[:0])) == 0

    def one(row):  # node by node
        margin = float(f["base"])
        for feature, cut, leaf in zip(f["feature"], f["cut"], f["leaf"], strict=True):
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + (row[feature[at]] > cut[at])
            margin += leaf[at - len(feature)]
        return 1 / (1 + math.exp(-margin))

    assert np.allclose([one(r) for r in x[:50]], Q.traverse(f, x[:50]))


def test_messy_scores(spark, messy, no_labels):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)] + [(1, None, None), (None, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    t = X.toxicity(messy, X.fit(messy, labels)).collect()
    q = Q.quality(messy, Q.fit(messy, labels)).collect()
    for rows in (t, q):
        assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in X.toxicity(messy, X.fit(messy, no_labels)).collect()} == {0.0}
    assert {r["score"] for r in Q.quality(messy, Q.fit(messy, no_labels)).collect()} == {1.0}
    kept = Q.accepted(messy, None)
    assert kept.columns == messy.columns and kept.count() == messy.count() and kept.schema == messy.schema


def test_empty_scores(spark, empty, no_labels):
    assert X.toxicity(empty, X.fit(empty, no_labels)).count() == 0
    assert Q.accepted(empty, Q.fit(empty, no_labels)).count() == 0
    assert M.lm_scores(empty, F.lit(True), F.lit(False)).count() == 0


def model(docs, train, deleted):
    """The model from scratch: (tokens, base, score) by document."""
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in docs}

    def counts(ids):
        uni, bi, ctx = Counter(), Counter(), Counter()
        for i in ids:
            before = "begin"
            for w in tokens[i]:
                uni[w] += 1
                bi[before, w] += 1
                ctx[before] += 1
                before = w
        return uni, bi, ctx

    def walk(i, c):
        uni, bi, ctx = c
        total, before = sum(uni.values()), "begin"
        for w in tokens[i]:
            n = ctx[before]
            yield min(int(math.log2(1 + n)), 15), uni[w] / total if total else 0, bi[before, w] / n if n else 0
            before = w

    every = counts(train)
    uni, size = every[0], len(every[0])
    rest = counts(train - deleted)
    seen = np.array([e for i in deleted for e in walk(i, rest)]).reshape(-1, 3)
    p = np.column_stack([np.full(len(seen), 1 / (size + 1)), seen[:, 1:]])

    there = np.column_stack([np.ones((len(seen), 2)), seen[:, 0] > 0])  # no bigram estimate after an unseen word

    def em(mine, w, weight, prior):
        for _ in range(200):
            r = p[mine] * w
            r = r / r.sum(1, keepdims=True) + (1 - there[mine]) * w / (there[mine] * w).sum(1, keepdims=True)
            w = r.sum(0) + weight * prior
            w = w / w.sum()
        return w

    shared = em(slice(None), np.full(3, 1 / 3), 1e-3, np.ones(3)) if len(p) else np.full(3, 1 / 3)
    mix = [em(seen[:, 0] == k, shared, 10, shared) if (seen[:, 0] == k).any() else shared for k in range(16)]
    mix[0] = mix[0] * [1, 1, 0] / mix[0][:2].sum()
    total = sum(uni.values())
    out = {}
    for i, own in tokens.items():
        base = sum(math.log10((uni[w] + 0.5) / (total + 0.5 * (size + 1))) for w in own)
        score = sum(math.log10(mix[k][0] / (size + 1) + mix[k][1] * a + mix[k][2] * b) for k, a, b in walk(i, every))
        out[i] = (len(own), sum(uni[w] > 0 for w in own), total, base, score)
    return out


def test_language_model_against_scratch(spark, small_docs, monkeypatch):
    from conftest import DATA

    monkeypatch.setattr(M, "BLOCK", 5_000)
    monkeypatch.setattr(M, "RANGE", 7_000)
    docs = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    crc = {i: zlib.crc32(str(i).encode()) for i, _ in docs}
    train = {i for i in crc if crc[i] % 5 != 1}
    want = model(docs, train, {i for i in train if crc[i] // 5 % 20 == 0})
    got = M.op2_deleted_interpolation(spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        n, known, total, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, r["doc_id"] not in train)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score, rel=0.01)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("order", [2, 3])
def test_the_mixture_sums_to_one(order):
    """Over all words after a context, seen in training or not."""
    rng = np.random.default_rng(order)
    size, tokens = 50, rng.zipf(1.5, 4000) % 50
    h = tokens.astype(np.uint64)
    ends = np.array([0, len(h)])
    uni, total = Counter(tokens.tolist()), len(tokens)
    grams = [Counter(zip(*(tokens[i:].tolist() for i in range(k)))) for k in range(1, order + 1)]
    weights = M.mixture(np.array([(k << 8 * order) + 0x050505 % (1 << 8 * order) for k in range(5)]), np.full(5, 40.0), order, 1 / size)
    assert len(h) == ends[-1] and np.allclose(weights.sum(1), 1)
    for before in [(1, 2), (49, 48), (3, 49)]:
        sums = 0.0
        count = [np.array([float(uni.get(x, 0)) for x in range(size)])]
        context = [np.zeros(size)]
        for k in range(2, order + 1):
            own = before[-(k - 1) :]
            count.append(np.array([float(grams[k - 1].get((*own, x), 0)) for x in range(size)]))
            context.append(np.full(size, count[-1].sum()))
        w = weights[M.bucket(context[-1])]
        p, shared = w[:, 0] / size, w[:, 0]
        for k, (e, there) in enumerate(zip(*M._estimates(count, context, float(total)), strict=True), 1):
            p, shared = p + w[:, k] * e, shared + w[:, k] * there
        sums = (p / shared).sum()
        assert sums == pytest.approx(1)


def test_language_model_messy(spark, messy):
    rows = M.lm_scores(messy, F.col("doc_id") != 11, F.col("doc_id") == 2).collect()
    assert len(rows) == messy.count() and all(r["score"] < 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1}
    alone = M.lm_scores(messy, F.lit(False), F.lit(False)).collect()
    assert {r["train_tokens"] for r in alone} == {0} and {r["n_known"] for r in alone} == {0}


def test_orders(spark, small_docs):
    some = small_docs.limit(60)
    trains = F.col("doc_id") % 5 != 0
    uni, tri = (M.lm_scores(some, trains, F.col("doc_id") % 7 == 0, order=k) for k in (1, 3))
    assert uni.agg(F.sum("n_tokens")).first() == tri.agg(F.sum("n_tokens")).first()


def test_pack_and_unpack():
    for kind in ("<u8", "<u4"):
        x = np.random.default_rng(0).integers(0, 1 << 30, 1000).astype(kind)
        assert (M.unpack(M.pack(x), 1000, kind) == x).all()
    assert len(M.unpack(M.pack(np.zeros(0, "<u8")), 0)) == 0


def trained(spark, label, turn):
    """The training rows in order: (label, what turn() makes of the text)."""
    from conftest import DATA

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    labels = [(r["doc_id"], r[label]) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()]
    labels = [x for x in labels if x[0] in docs and zlib.crc32(str(x[0]).encode()) % 5 and x[1] is not None]
    return docs, [(y, turn(docs[i])) for i, y in sorted(labels, key=lambda x: hashlib.md5(str(x[0]).encode()).hexdigest())]


def test_toxicity_against_scratch(spark):
    """FTRL-proximal coordinate by coordinate, on the same hashed features."""
    from conftest import DATA

    def turn(text):
        words = re.findall(rb"[a-z0-9\x80-\xff]+", text.encode().lower())
        want = len(words) * 2 + max(0, len(words) - 1) + max(0, len(words) - 2)
        found = X.features([text])[1]
        assert len(found) == want  # words, stems, pairs, pairs around a word
        return sorted(set(found.tolist()))

    docs, rows = trained(spark, "toxic", turn)
    z, n, bias = {}, {}, 1 << X.BITS

    def weight(i):
        s, least = z.get(i, 0.0), 0.0 if i == bias else X.L1
        return 0.0 if abs(s) <= least else -(s - math.copysign(least, s)) / ((X.BETA + math.sqrt(n.get(i, 0.0))) / X.ALPHA + X.L2)

    for _ in range(X.EPOCHS):
        for y, x in rows:
            w = {i: weight(i) for i in [*x, bias]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in w:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / X.ALPHA * w[i]
                n[i] = old + g * g
    got = {r["doc_id"]: r["score"] for r in X.op1_toxicity(spark, DATA).collect()}
    assert len(got) == len(docs)
    for i, text in docs.items():
        assert got[i] == pytest.approx(1 / (1 + math.exp(-sum(weight(k) for k in [*turn(text), bias]))), rel=1e-6, abs=1e-9)


def test_quality_against_scratch(spark):
    """The same forest from rows collected by hand, descended node by node."""
    from conftest import DATA

    docs, rows = trained(spark, "quality", lambda t: Q.statistics([t])[0])
    f = Q.boost(np.stack([x for _, x in rows]), np.array([float(y) for y, _ in rows]))
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in Q.op3_quality(spark, DATA).collect()}
    assert len(got) == len(docs)
    for i, text in docs.items():
        x, margin = Q.statistics([text])[0], float(f["base"])
        for feature, cut, leaf in zip(f["feature"], f["cut"], f["leaf"], strict=True):
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + (x[feature[at]] > cut[at])
            margin += leaf[at - len(feature)]
        p = 1 / (1 + math.exp(-margin))
        assert got[i] == (pytest.approx(p), int(p >= 0.3))
