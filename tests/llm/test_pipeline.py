import hashlib
import math
import re
from collections import Counter
from itertools import groupby

import corpus_pipeline as P
import numpy as np
import public_tokenizers
from conftest import DATA
from gridloom.llm import common, mixing
from gridloom.llm import quality as Q
from gridloom.llm.common import stage
from test_dedup import brute
from test_scores import trained
from test_texts import check_packing, fill

import __spark_entry__ as entry

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_and_run(spark, small_docs):
    docs, seen = small_docs, []
    for k, (_, f) in enumerate(P.STAGES):
        docs = stage(f(spark, docs, DATA), f"test-{k}")
        seen.append(docs)
    assert all(d.columns == small_docs.columns for d in seen[:-1])
    texts = [Counter(r["text"] for r in d.collect()) for d in seen[:-1]]
    assert set(texts[1]) == set(texts[0]) and max(texts[1].values()) == 1
    assert set(texts[2]) <= set(texts[1])
    good = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1").collect()}
    first = {r["doc_id"] for r in seen[0].collect()}
    assert len(good - first) <= 0.05 * len(good)
    last = [tuple(r) for r in seen[-1].collect()]
    again = [tuple(r) for r in P.run(spark, DATA).collect()]
    crc = seen[-1].columns.index("ids_crc32")
    assert sorted(r[crc] for r in last) == sorted(r[crc] for r in again)


def mixed_by_hand(docs):
    """docs: (id, text, source). The texts that the mix takes, by walking the schedule slot by slot."""
    by, names = {}, sorted({s for _, _, s in docs if s is not None}) + [None] * any(s is None for _, _, s in docs)
    for i, t, s in docs:
        by.setdefault(s, []).append((int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16), i, WORD.findall(t or ""), t))
    sizes = [sum(len(w) for _, _, w, _ in by[s]) for s in names]
    targets = fill(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))])
    total = sum(targets.values())
    wanted = math.ceil(total * mixing.SLOTS_LEAST / min(t for t in targets.values() if t > 0))
    block = max(1, math.ceil(total / min(mixing.SLOTS_MOST, wanted)))
    turns = Counter()
    for slot in range(math.ceil(total / block)):
        u, at, k = (slot + 0.5) * mixing.PHI % 1, 0.0, 0
        while k < len(names) - 1 and u >= at + targets[k] / total:
            at, k = at + targets[k] / total, k + 1
        turns[k] += 1
    out = []
    for k, s in enumerate(names):
        line, n_blocks = [], max(1, math.ceil(sizes[k] / block))
        for _, i, words, text in sorted(by[s], key=lambda x: x[:2]):
            line += [(i, p, text) for p in range(len(words))]
        for epoch in range(2):
            left = min(n_blocks, max(0, turns[k] - epoch * n_blocks))
            for _, own in groupby(line[: left * block], key=lambda x: x[0]):
                own = list(own)
                places = [m.span() for m in WORD.finditer(own[0][2])]
                whole = len(own) == len(places)
                out.append(own[0][2] if whole else own[0][2][places[0][0] : places[len(own) - 1][1]])
    return out


def test_run_against_brute_force(spark, small_docs):
    docs, rows = trained(spark, "quality", lambda t: Q.statistics([t])[0])
    forest = Q.boost(np.stack([x for _, x in rows]), np.array([float(y) for y, _ in rows]))
    source = {r["doc_id"]: r["source"] for r in small_docs.collect()}
    first = {i: t for i, t in docs.items() if Q.traverse(forest, Q.statistics([t]))[0] >= 0.3}
    last = {}
    for i, t in first.items():
        last[t] = max(i, last.get(t, i))
    second = {i: t for t, i in last.items()}
    third = {i: second[i] for i, (_, root) in brute(second.items(), 80).items() if i == root}
    assert len(docs) > len(first) > len(second) > len(third)
    texts = mixed_by_hand([(i, t, source[i]) for i, t in third.items()])
    n, bound = check_packing(P.run(spark, DATA).collect(), texts)
    assert n <= bound * 1.01 + 1


def test_messy_documents(spark, messy, tmp_path):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = messy
    for k, (_, f) in enumerate(P.STAGES):
        docs = stage(f(spark, docs, str(tmp_path)), f"messy-{k}")
        if k < 4:
            assert docs.columns == messy.columns
            texts = [r["text"] for r in docs.select("text").collect()]
        if k in (1, 2):
            assert len({t or "" for t in texts}) == len(texts)
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)
    assert texts and all(WORD.search(t) for t in texts) and docs.agg({"length": "sum"}).first()[0] == sum(len(e.ids) + 1 for e in ids)


def test_run_leaves_only_its_result(spark):
    before = set(common._staged)
    out = P.run(spark, DATA)
    assert set(common._staged) - before == {out._staged_at}


def test_empty_documents(spark, small_docs):
    docs = small_docs.limit(0)
    for _, f in P.STAGES:
        docs = f(spark, docs, DATA)
    assert docs.count() == 0


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
