import hashlib
import random
from collections import Counter

import pytest

from gridloom.llm import exact_dedup as exact
from gridloom.llm import near_dedup as N
from gridloom.llm import components
from gridloom.llm.common import new_path
from gridloom.llm.components import connected_components
from gridloom.llm.exact_dedup import DigestIndex, exact_dedup, op8_exact_dedup


def test_exact_on_the_tables(spark, small_docs):
    from conftest import DATA

    docs = [(r["doc_id"], r["text"] or "") for r in small_docs.collect()]
    last, n = {}, Counter(t for _, t in docs)
    for i, t in docs:
        last[t] = max(i, last.get(t, i))
    want = sorted((i, last[t], n[t], i == last[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in docs)
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in op8_exact_dedup(spark, DATA).collect())
    assert got == want


def test_exact_messy(spark, messy):
    index = DigestIndex(spark, new_path(spark, "index"), buckets=4)
    rows = index.add(messy).collect()
    assert len(rows) == messy.count()
    assert sum(r["kept"] for r in rows) == messy.fillna("", ["text"]).select("text").distinct().count()
    by = [(r["doc_id"], r["keep_id"], r["n_rows"], r["kept"]) for r in rows]
    assert by.count((1, 2, 3, False)) == 1 and sorted(x for x in by if x[0] == 2) == [(2, 2, 3, False), (2, 2, 3, True)]
    assert sorted((x[2], x[3]) for x in by if x[0] is None) == [(2, False), (2, True)]
    assert {(x[0], x[3]) for x in by if x[0] in (3, 4)} == {(3, False), (4, True)}
    kept = exact_dedup(messy)
    assert kept.columns == messy.columns and kept.count() == sum(r["kept"] for r in rows)
    assert kept.filter("score != 'clash'").count() == 0


def test_exact_empty(spark, empty):
    assert exact_dedup(empty).count() == 0


def test_index_outlives_a_batch_and_a_handle(spark):
    path = new_path(spark, "index")
    first = spark.createDataFrame([(5, "a"), (6, "b"), (7, "b")], "doc_id long, text string")
    DigestIndex(spark, path, buckets=4).add(first)
    again = DigestIndex(spark, path, buckets=4)
    second = spark.createDataFrame([(8, "b"), (9, "c"), (1, "c")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in again.add(second).collect())
    assert got == [(1, 9, False), (8, 7, False), (9, 9, True)]
    assert again.table().count() == 3


def test_a_hot_text_is_joined_apart(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE 'text ' || id END AS text")
    rows = DigestIndex(spark, new_path(spark, "index"), buckets=4).add(docs).collect()
    assert sum(r["kept"] for r in rows) == 334 and {r["keep_id"] for r in rows if r["n_rows"] == 167} == {498}


def test_hot_texts_of_earlier_batches_are_chosen_once(spark, monkeypatch):
    monkeypatch.setattr(exact, "HOT_SHARE", 3)
    monkeypatch.setattr(exact, "HOT_LEAST", 2)
    index = DigestIndex(spark, new_path(spark, "index"), buckets=4)
    index.add(spark.range(800).selectExpr("id AS doc_id", "'text ' || id % 40 AS text"))
    found = index.add(spark.range(1000, 1040).selectExpr("id AS doc_id", "'text ' || id % 40 AS text"))
    assert "Limit" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = [(i, 760 + i % 40, 20, False) for i in range(1000, 1040)]
    assert sorted((r["doc_id"], r["keep_id"], r["n_rows"], r["kept"]) for r in found.collect()) == want


def brute(docs, similarity=85):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in where[x] if j > i).items():
            if 100 * n >= similarity * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.components(df).collect()}


def cases():
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    docs, n = [], 0
    for _ in range(4):  # copies of one text, near it but often not near each other
        one = [r.choice(words) for _ in range(200)]
        for _ in range(50):
            copy = list(one)
            for _ in range(r.choice([0, 1, 2, 3, 4])):
                copy[r.randrange(200)] = r.choice(words)
            docs.append((n, " ".join(copy)))
            n += 1
    shared = [r.choice(words) for _ in range(60)]
    for _ in range(150):  # a passage in common, not near
        docs.append((n, " ".join(shared + [r.choice(words) for _ in range(100)])))
        n += 1
    docs += [(n, None), (n + 1, ""), (n + 2, "a b"), (n + 3, "A b"), (n + 4, " \n"), (n + 5, "a b c d e"), (n + 6, "a  b c d E")]
    r.shuffle(docs)
    return docs


def test_near_against_brute_force(spark):
    docs = cases()
    assert result(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_near_with_groups_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(N, "MOST_MEMBERS", 15)
    monkeypatch.setattr(N, "MOST_SHINGLES", 3000)
    docs = cases()
    assert result(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_near_copies_between_the_thresholds(spark):
    assert N.banding(85) == (25, 6) and N.banding(80) == (30, 5)
    r = random.Random(9)
    docs = []
    for k in range(60):  # similarity 0.80 to 0.85: 200 words, 196 shingles, of which the copy changes 20
        one = [f"x{r.randrange(5000)}" for _ in range(200)]
        docs += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(w if j % 49 else f"y{k}" for j, w in enumerate(one[:200])))]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(196)} for _, t in docs]
    assert all(80 <= 100 * len(a & b) / len(a | b) < 85 for a, b in zip(sets[::2], sets[1::2], strict=True))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert N.near_dedup(df, similarity=85).count() == 120
    assert sorted(x["doc_id"] for x in N.near_dedup(df).collect()) == list(range(0, 120, 2))


def test_near_messy(spark, messy):
    rows = N.components(messy).collect()
    assert len(rows) == messy.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["component_id"], r["kept"]))
    assert by[1] == {(1, True)} and by[2] == by[9] == {(1, False)} and by[7] == {(7, True)} and by[8] == {(7, False)}
    assert by[3] == {(3, True)} and by[None] == {(None, True)}
    kept = N.near_dedup(messy)
    assert kept.columns == messy.columns and kept.filter("doc_id IN (2, 8, 9)").count() == 0 and kept.filter("doc_id = 7").count() == 1


def test_near_empty(spark, empty):
    assert N.components(empty).count() == 0 and N.near_dedup(empty).count() == 0


def test_posterior_bound():
    for n, least in N._LEAST:
        assert 0.45 * n < least < 0.85 * n  # a pair at the threshold stays, one far below goes


def test_components_of_a_chain_a_cycle_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(200, 201), (201, 202), (202, 200)] + [(300 + i, 300) for i in range(1, 20)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 131)}, 200: 200, 201: 200, 202: 200, **{300 + i: 300 for i in range(20)}}


def test_components_need_no_limit_of_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "ROUNDS", 1, raising=False)
    edges = [(i, i + 1) for i in range(60)]
    random.Random(2).shuffle(edges)
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((r["node"], r["root"]) for r in got) == [(i, 0) for i in range(61)]


@pytest.mark.parametrize("n", [1, 2])
def test_components_of_nothing(spark, n):
    assert connected_components(spark.createDataFrame([(1, 1)] * n, "u long, v long")).count() == 0


def test_index_keeps_its_buckets_when_reopened(spark):
    path = new_path(spark, "index")
    docs = spark.range(2000).selectExpr("id AS doc_id", "'text ' || id AS text")
    assert DigestIndex(spark, path, buckets=4).add(docs).filter("kept").count() == 2000
    again = DigestIndex(spark, path, buckets=64)
    assert again.buckets == 4 and again.add(docs).filter("kept").count() == 0
    with pytest.raises(ValueError):
        DigestIndex(spark, path, id_type=exact.T.StringType())
    again.close()
    assert again.name not in {t.name for t in spark.catalog.listTables()}


def test_index_takes_a_failed_batch_again(spark, monkeypatch):
    path = new_path(spark, "index")
    docs = spark.createDataFrame([(i, f"t{i // 2}") for i in range(40)] + [(39, "t19")], "doc_id long, text string")
    index = DigestIndex(spark, path, buckets=4)
    with monkeypatch.context() as m:
        m.setattr(exact._Notes, "write", lambda *a: 1 / 0)  # fails after the rows are appended
        with pytest.raises(ZeroDivisionError):
            index.add(docs, "monday")
    first = [sorted((r["doc_id"], r["keep_id"], r["n_rows"], r["kept"]) for r in DigestIndex(spark, path).add(d, "monday").collect()) for d in (docs, docs.repartition(3))]
    assert first[0] == first[1] and sum(x[3] for x in first[0]) == 20 and {x[1] for x in first[0]} == set(range(1, 40, 2))
    assert DigestIndex(spark, path).table().count() == 20
    assert DigestIndex(spark, path).add(docs, "tuesday").filter("kept").count() == 0


def test_a_query_leaves_no_table_behind(spark, small_docs):
    before = {t.name for t in spark.catalog.listTables()}
    exact_dedup(small_docs).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_no_task_gets_more_than_two_chunks(spark, monkeypatch):
    most, members = 50, 600
    sizes = []
    sketches = [random.Random(i).randbytes(N.HASHES) for i in range(members)]
    rows = [(1, i, 1, 1, s) for i, s in enumerate(sketches)] + [(2, 1000 + i, 1, 1, sketches[0]) for i in range(300)]
    df = spark.createDataFrame(rows, "part long, node long, weight int, central int, sketch binary")
    run = N._run

    def counted(rows, method):
        sizes.extend(r["count"] for r in rows.groupBy("part", "chunk").count().collect())
        return run(rows, method)

    monkeypatch.setattr(N, "_run", counted)
    edges = [(r["u"], r["v"]) for r in N.linked(df, N.link_sketches, most).collect()]
    assert max(sizes) <= 2.7 * most + N.PIVOTS  # chunks are dealt by hash, so some are over the mean
    assert not any(u < 1000 for u, _ in edges)  # unlike
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(got) == 300 and {r["root"] for r in got} == {1000}


def test_near_keeps_one_row_where_ids_repeat(spark):
    text, near = " ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(299))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (1, near), (3, "other words only here today"), (3, "some quite unlike text of that id"), (4, ""), (4, "")], "doc_id long, text string")
    got = [r["doc_id"] for r in N.near_dedup(docs).collect()]
    assert sorted(got) == [1, 3, 3, 4, 4]
