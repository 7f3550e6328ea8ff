"""Personal data, quality rules, tokens, packing and mixing."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridloom.llm import mixing, outliers, packing, pii, token_counts

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LARGER = "/root/testdata/sf0.01"


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        out += [(m.start(), 2, m.end())] if 14 <= len(d) <= 19 and luhn(d) else []
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_on_random_strings():
    r = random.Random(1)
    for _ in range(5000):
        t = "".join(r.choice("a.@1 2-+b()0") for _ in range(r.randrange(1, 45)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_personal_data(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = pii.op4_personal_data(spark, LARGER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r["doc_id"]])
        joined = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r["spans"].split(","))


def test_method_adds_spans_and_leaves_others(spark):
    base = [(i, f"hello there x{i}@mail.example.com and +1 (555) 010-{1000 + i} or 10.0.0.{i}") for i in range(40)]
    more = [(100, "please write to jane.doe [at] example [dot] com today"), (101, "call phone 555-123-4567 now"), (102, "see version 555 123 4567"), (103, "plain words only"), (104, "meet at noon dot done")]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(base + more, "doc_id long, text string")).collect()}
    assert got[100] == "email:16:47" and got[101] == "phone:11:23"
    assert got[102] == got[103] == got[104] == ""


def planted(n, seed):
    """Texts with base spans, spans in other forms, and numbers and phrases that are neither: (text, true added spans)."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 9)))
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card(valid):
        while True:
            d = r.choice("45") + str(r.randrange(1, 6)) + number(14)
            if luhn(d) == valid and len(set(d)) >= 4:
                return d

    def quad(d, sep):
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    base = [lambda: f"{word()}.{word()}@{word()}.com", lambda: ".".join(str(r.randrange(256)) for _ in range(4)), lambda: quad(card(True), " "), lambda: f"+1 ({number(3)}) 555-{number(4)}"]
    cues = (["mail", "contact"], ["host", "server"], ["card", "visa"], ["call", "phone"])
    added = [
        ("email", lambda: (r.choice(["mail ", "contact ", "write to ", ""]), f"{word()} [at] {word()} [dot] {r.choice(['com', 'org', 'de'])}")),
        ("email", lambda: (r.choice(["email ", ""]), f"{word()}.{word()} at {word()} dot com")),
        ("ip", lambda: (r.choice(["host ", "server ", ""]), ":".join(f"{r.randrange(1 << 16):x}" for _ in range(8)))),
        ("ip", lambda: (r.choice(["ping ", ""]), "[.]".join(str(r.randrange(1, 256)) for _ in range(4)))),
        ("card", lambda: (r.choice(["card ", "visa ", ""]), quad(card(True), "."))),
        ("phone", lambda: (r.choice(["call ", "phone ", "tel "]), f"{r.randrange(200, 990)}-{number(3)}-{number(4)}")),
    ]
    other = [
        lambda: card(False), lambda: quad(card(False), "."), lambda: f"version {number(3)} {number(3)} {number(4)}", lambda: f"order {number(10)}", lambda: f"isbn {number(13)}",
        lambda: f"serial {number(3)}-{number(4)}-{number(4)}", lambda: f"we met at {word()} dot", lambda: f"invoice {number(11)}", lambda: ".".join(number(3) for _ in range(3)),
    ]
    docs = []
    for _ in range(n):
        parts, truth, at = [], [], 0
        for _ in range(r.randrange(3, 9)):
            roll = r.random()
            if roll < 0.25:
                k = r.randrange(4)
                piece = r.choice([*(f"{c} " for c in cues[k]), "", ""]) + base[k]()
            elif roll < 0.4:
                kind, make = r.choice(added)
                cue, span = make()
                truth.append(f"{kind}:{at + len(cue)}:{at + len(cue) + len(span)}")
                piece = cue + span
            elif roll < 0.6:
                piece = r.choice(other)()
            else:
                piece = " ".join(word() for _ in range(r.randrange(3, 12)))
            piece += " ; " + word() + " ; "
            parts.append(piece)
            at += len(piece)
        docs.append(("".join(parts), truth))
    return docs


def test_added_spans_of_a_planted_corpus(spark):
    docs = planted(1500, 11)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(docs)], "doc_id long, text string")
    got = {r["doc_id"]: set(filter(None, r["spans"].split(","))) for r in pii.personal_data(df).collect()}
    base = {i: {f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in pii.base_spans(t)} for i, (t, _) in enumerate(docs)}
    assert all(base[i] <= got[i] for i in got)
    added, truth = {(i, x) for i in got for x in got[i] - base[i]}, {(i, x) for i, (_, t) in enumerate(docs) for x in t}
    precision, recall = len(added & truth) / len(added), len(added & truth) / len(truth)
    print(f"{len(truth)} planted, precision {precision:.3f}, recall {recall:.3f}")
    assert precision > 0.95 and recall > 0.9


def test_added_spans_do_not_overlap(spark):
    docs = [(i, f"card 4929 3483 8513 6796 tel +1 (555) 010-{1000 + i} then 4111.1111.1111.1111 4845168114407329 7536784127813050 and 555 123 4567 890 1234") for i in range(30)]
    for r in pii.spans(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        mine = [(s["start"], s["end"], s["base"]) for s in r["spans"]]
        assert all(not (a < d and c < b) or (x and y) for k, (a, b, x) in enumerate(mine) for c, d, y in mine[:k])


def test_personal_data_messy(spark, messy, empty):
    rows = pii.personal_data(messy).collect()
    assert len(rows) == messy.count() and {r["spans"] for r in rows if r["doc_id"] in (3, 4, 5)} == {""}
    assert [(r["n_email"], r["n_phone"]) for r in rows if r["doc_id"] == 6] == [(1, 1)]
    assert pii.personal_data(empty).count() == 0


@pytest.mark.parametrize("text", ["1" * 100_000, "1 " * 50_000, "a@" * 50_000, "+1(" * 40_000, "1.1." * 25_000, "1-1-" * 25_000, "4111 1111 1111 1111 " * 5_000])
def test_scan_takes_linear_time(text):
    began = time.perf_counter()
    pii.candidates(text, pii.base_spans(text))
    assert time.perf_counter() - began < 1


def test_reliabilities_find_the_bad_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(2000) < 0.5
    votes = np.stack([np.where(rng.random(2000) < q, truth, ~truth) for q in (0.95, 0.9, 0.9, 0.5)], 1) * 2 - 1
    rows, times = np.unique(np.column_stack([np.zeros(2000, int), votes]), axis=0, return_counts=True)
    p = pii.reliabilities(rows, times.astype(float))
    chance = dict(zip(map(tuple, rows), p, strict=True))
    assert np.mean([(chance[(0, *v)] > 0.5) == t for v, t in zip(votes, truth, strict=True)]) > 0.95


def test_rules_against_brute_force(spark, small_docs):
    from conftest import DATA

    texts = {r["doc_id"]: r["text"] or "" for r in small_docs.collect()}
    word = re.compile(r"[^\x20\x09-\x0D]+")
    rows = outliers.op7_robust_outliers(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        w = word.findall(t)
        lines = [x for x in t.split("\n") if word.search(x)]
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + d for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for d in range(5)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r["base_failed"] and r["kept"])


def test_rules_drop_junk_and_keep_the_rest(spark):
    kept = {r["doc_id"]: r["kept"] for r in outliers.op7_robust_outliers(spark, LARGER).collect() if not r["base_failed"]}
    good = [r["doc_id"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").filter("quality = 1").collect()]
    assert np.mean([kept[i] for i in good if i in kept]) > 0.99 and not all(kept.values())


def test_rules_reject_most_bad_documents(spark):
    kept = {r["doc_id"]: r["kept"] for r in outliers.op7_robust_outliers(spark, LARGER).collect() if not r["base_failed"]}
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    good, bad = ([kept[i] for i, q in quality.items() if q == v and i in kept] for v in (1, 0))
    assert np.mean(bad) < 0.05 and np.mean(good) > 0.998


def verdicts_by_hand(rows, cutoff):
    """kept of each row that passes the base rule, by numpy: the same estimate, a group at a time."""
    xs, floors = list(outliers.COORDS), np.array(list(outliers.COORDS.values()))

    def quantile(values, cells, share):
        order = np.argsort(cells, kind="stable")
        cell = cells[order][int(np.ceil(share * len(order) - 1e-9)) - 1]
        return values[cells == cell].max()

    def octave(d):
        return np.floor(np.log2(d + 2.0**-20) * outliers.OCTAVE)

    def shrunk(cov, n, floor):
        low = np.zeros_like(cov)
        for i in range(len(cov)):
            for j in range(i + 1):
                rest = cov[i, j] - low[i, :j] @ low[j, :j]
                low[i, j] = np.sqrt(max(rest, floor[i] ** 2 / 4)) if i == j else rest / low[j, j]
        return np.linalg.inv(low), 2 * np.log(np.diag(low)).sum()

    def covariance(x, floor):
        c = x.T @ x / len(x) - np.outer(x.mean(0), x.mean(0))
        c[np.diag_indices(len(floor))] = np.maximum(np.diag(c), 0) + floor**2
        return c

    def estimate(x):
        step = floors / outliers.FINE
        mid = np.array([quantile(x[:, i], np.floor(x[:, i] / step[i]), 0.5) for i in range(len(xs))])
        off = np.abs(x - mid)
        dev = np.maximum(1.4826 * np.array([quantile(off[:, i], np.floor(off[:, i] / step[i]), 0.5) for i in range(len(xs))]), floors)
        z, ones = (x - mid) / dev, np.full(len(xs), 0.05)
        turned = z / np.sqrt((z * z).sum(1) + 1e-12)[:, None]
        shapes = (np.eye(len(xs)), turned.T @ turned / len(x) + 0.0025 * np.eye(len(xs)), covariance(np.tanh(z), ones))
        fits = [(mid, shrunk(s, len(x), ones)[0] / dev[None, :], None) for s in shapes]

        def step_on(fit):
            d = ((fit[1] @ (x - fit[0]).T) ** 2).sum(0)
            near = x[d <= quantile(d, octave(d), outliers.NEAREST)]
            return near.mean(0), *shrunk(covariance(near, floors), len(near), floors)

        for _ in range(outliers.FIRST_STEPS):
            fits = [step_on(f) for f in fits]
        fit = min(fits, key=lambda f: f[2])
        while (after := step_on(fit))[2] < fit[2] - outliers.STILL:
            fit = after
        d = ((fit[1] @ (x - fit[0]).T) ** 2).sum(0)
        return fit, max(quantile(d, octave(d), 0.5) / outliers.CHI2_MEDIAN[len(xs)], 1.0)

    def vector(r):
        n, c, lines = r["n_words"], r["word_chars"], r["n_lines"]
        return [np.log((c + 150) / (n + 30)), np.sqrt(r["n_symbols"] / (c + 150)), np.sqrt(r["n_dup_lines"] / (lines + 5)), np.sqrt(r["n_repeat_words"] / (n + 30)), np.sqrt(r["n_capitals"] / (c + 150))]

    good = [r for r in rows if not r["base_failed"]]
    x = np.array([vector(r) for r in good])
    cells, langs = Counter((r["lang"], r["source"]) for r in good), Counter(r["lang"] for r in good)
    fits, out = {}, {}
    for i, r in enumerate(good):
        lang, source = r["lang"], r["source"]
        level = 2 if cells[lang, source] >= outliers.LEAST_ROWS else 1 if langs[lang] >= outliers.LEAST_ROWS else 0
        key = (level, *(lang, source)[:level])
        if key not in fits:
            fits[key] = estimate(np.array([v for v, q in zip(x, good, strict=True) if level < 1 or q["lang"] == lang and (level < 2 or q["source"] == source)]))
        (m, w, _), scale = fits[key]
        out[r["_row"]] = bool(((w @ (x[i] - m)) ** 2).sum() / scale <= cutoff)
    return out


def test_verdicts_against_numpy(spark, small_docs, monkeypatch):
    monkeypatch.setattr(outliers, "LEAST_ROWS", 30)
    rows = outliers.verdicts(small_docs, least=30).collect()
    want = verdicts_by_hand(rows, outliers.CUTOFF)
    assert len(want) > 150 and 0 < sum(want.values()) < len(want)
    assert {r["_row"]: r["kept"] for r in rows if not r["base_failed"]} == want


def test_a_small_source_is_held_against_its_language(spark):
    r = random.Random(12)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 9))) for _ in range(800)]
    text = lambda: ". ".join(" ".join(r.choice(words) for _ in range(8)).capitalize() for _ in range(10))
    junk = lambda: " ".join(r.choice(["###", "$$|", "<><>", "a|b", "%%%", "&&"]) + r.choice(words) for _ in range(80))
    docs = [(i, text(), "en", "big") for i in range(600)] + [(1000 + i, junk(), "en", "tiny") for i in range(3)] + [(2000 + i, text(), "xx", "own") for i in range(3)]
    rows = outliers.verdicts(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()
    assert not any(x["kept"] for x in rows if 1000 <= x["doc_id"] < 2000)
    assert np.mean([x["kept"] for x in rows if x["doc_id"] < 600]) > 0.99 and all(x["kept"] for x in rows if x["doc_id"] >= 2000)


def test_mcd_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.multivariate_normal([1, 2], [[1, 0.6], [0.6, 1]], 600)
    x[:60] = [9, -9] + rng.normal(0, 0.1, (60, 2))
    rows = spark.createDataFrame([(i, "g", float(a), float(b)) for i, (a, b) in enumerate(x)], "_row long, g string, a double, b double")
    fit = outliers.mcd(rows, {"a": 1e-3, "b": 1e-3})
    far = {r["_row"]: r["d"] for r in rows.join(fit, "g").select("_row", (outliers._distance(["a", "b"]) / F.col("scale")).alias("d")).collect()}
    clean = x[60:]
    real = np.einsum("ij,jk,ik->i", clean - clean.mean(0), np.linalg.inv(np.cov(clean.T)), clean - clean.mean(0))
    assert min(far[i] for i in range(60)) > 60 and np.corrcoef([far[i] for i in range(60, 600)], real)[0, 1] > 0.98


def test_rules_messy(spark, messy, empty):
    rows = outliers.verdicts(messy).collect()
    assert len(rows) == messy.count() and {r["kept"] for r in rows if r["doc_id"] in (3, 4, 5)} == {False}
    assert outliers.verdicts(empty).count() == 0


def test_token_counts(spark, messy, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    tricky = ["", " ", "  ", "\n", " \n", "\n ", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", " \n a", "▁", "▁▁x ▁", "<s> </s>", "\x00", "a\r\nb\tc", "é 日本 　x", "x" * 3000]
    r = random.Random(2)
    tricky += ["".join(r.choice("ab \n▁\té.") for _ in range(r.randrange(30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(tricky)), "doc_id long, text string")
    for head in (1 << 17, 0, 3):
        got = {x["doc_id"]: (x["n_tokens"], x["n_bytes"]) for x in token_counts.token_counts(df, PIECES, head).collect()}
        assert got == {i: (len(model.encode(t)), len(t.encode())) for i, t in enumerate(tricky)}
    rows = token_counts.token_counts(messy, PIECES).collect()
    assert len(rows) == messy.count() and {x["n_tokens"] for x in rows if x["doc_id"] in (3, 4)} == {0}
    assert token_counts.token_counts(empty, PIECES).count() == 0


def test_encoder():
    from tokenizers import Tokenizer

    r = random.Random(3)
    texts = ["", "a  b\n\n c\t\td  ", "<|endoftext|> x", "日本語 ² Ⅷ", "\x1c\x1d a", "'s 't isn't we'LL", "a" * 5000, "ñandú “quoted” – dash…"]
    texts += ["".join(r.choice("ab1 '\n\té.,—_<|ß²") for _ in range(r.randrange(60))) for _ in range(3000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    encoder = packing.Encoder(BPE)
    assert encoder.fast is not None and encoder.encode(texts) == want


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    ids = [[*e.ids, 2] for e in Tokenizer.from_file(BPE).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    pieces = []
    for x in ids:
        first = (len(x) - 1) % 1024 + 1
        cuts = [0, *range(first, len(x) + 1, 1024)]
        pieces += [(k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(pieces)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    return len(bins), -(-sum(map(len, ids)) // 1024)


def test_packing(spark, small_docs, messy, empty):
    n, bound = check_packing(packing.pack(small_docs, BPE).collect(), [r["text"] for r in small_docs.collect()])
    assert n <= bound * 1.01 + 1
    packed = packing.pack(messy, BPE, with_ids=True)
    check_packing(packed.collect(), [r["text"] for r in messy.collect()])
    whole = packing.sequences(packed).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] <= 4096 for r in whole)
    assert packing.pack(empty, BPE).count() == 0


def test_slack_search_against_all_subsets():
    from itertools import product

    r = random.Random(4)
    for _ in range(200):
        avail = {r.randrange(1, 20): r.randrange(1, 3) for _ in range(5)}
        room = r.randrange(1, 40)
        best = max(s for c in product(*(range(n + 1) for n in avail.values())) if (s := sum(k * x for k, x in zip(c, avail, strict=True))) <= room)
        used = packing.fullest(avail, room)
        assert sum(used) == best and all(used.count(x) <= avail[x] for x in used)


def test_patterns_use_all_pieces():
    r = random.Random(6)
    counts = Counter(r.choice([3, 50, 333, 700, 1024, r.randrange(1, 1025)]) for _ in range(5000))
    got = Counter()
    for used, times in packing.patterns(counts):
        assert sum(used) <= 1024
        for x in used:
            got[x] += times
    assert got == counts


def fill(sizes, weights):
    """Targets by handing the excess on until none is above its limit."""
    total, fixed = 1.5 * sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left = total - sum(fixed.values())
        want = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if want[i] > 2 * sizes[i] + 1e-9]
        if not over:
            return {**want, **fixed}
        fixed |= {i: 2.0 * sizes[i] for i in over}


def test_targets_fill_up(spark):
    r = random.Random(8)
    for n in (1, 3, 8):
        sizes = [r.randrange(0, 500) for _ in range(n)]
        names = [f"s{i}" for i in range(n - 1)] + [None]
        df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, size long")
        got = {x["source"]: x["target"] for x in mixing.source_targets(df).collect()}
        want = fill(sizes, [(5, 2, 1)[i % 3] for i in range(n)])
        assert got == pytest.approx({names[i]: t for i, t in want.items()})


def test_mix(spark):
    rows = mixing.op10_source_mix(spark, LARGER).collect()
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - t) <= 0.01 * t for s, t in target.items())
    again = mixing.op10_source_mix(spark, LARGER).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in rows)


def test_schedule_is_spread_evenly(spark):
    s = spark.createDataFrame([("a", 1, 600.0), ("b", 2, 300.0), ("c", 3, 100.0)], "source string, source_id int, target double")
    rows = [(r["slot"], r["source_id"], r["rank"]) for r in mixing.schedule(s, 10_000, 1000.0).collect()]
    assert sorted(x[0] for x in rows) == list(range(10_000))
    for i, share in ((1, 0.6), (2, 0.3), (3, 0.1)):
        own = sorted((slot, rank) for slot, x, rank in rows if x == i)
        assert [rank for _, rank in own] == list(range(len(own)))
        assert all(abs(rank - share * slot) < 12 for slot, rank in own)


def test_small_sources_when_the_slots_are_at_their_limit(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS_LEAST", 64)
    monkeypatch.setattr(mixing, "SLOTS_MOST", 1024)
    sizes = [("a", 200, 500), ("b", 100, 500), ("c", 6, 50), ("d", 40, 500)]  # source, documents, words of each
    rows = [(f"{s}{i}", " ".join(["w"] * n), s) for s, k, n in sizes for i in range(k)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string")
    weights = (1000, 1000, 1000, 1)
    sized, taken = mixing.mix(docs, weights)
    per = {r["_row"]: r["n"] for r in taken.groupBy("_row").agg(F.sum("n_words").alias("n")).collect()}
    got, target = Counter(), {}
    for r in sized.collect():
        assert per.get(r["_row"], 0) <= 2 * r["size"]
        got[r["source"]] += per.get(r["_row"], 0)
        target[r["source"]] = r["target"]
    assert target["c"] == 600 and got["c"] == 600 and 100 < target["d"] < 200 and got["d"] == round(target["d"])
    assert all(abs(got[s] - target[s]) <= 0.02 * target[s] for s in "ab")
    n_slots = taken.agg(F.max("slot")).first()[0]
    assert n_slots < 1024
    out = Counter(r["doc_id"][0] for r in mixing.mixed_documents(docs, weights).collect())
    assert out["c"] == 12 and out["d"] == 1


def test_mix_against_sql_at_the_limit_of_slots(spark, monkeypatch, tmp_path):
    import duckdb

    r = random.Random(14)
    rows = [(i, " ".join(["w"] * r.randrange(1, 60)), r.choice(["a"] * 30 + ["b"] * 8 + ["c"] * 2 + [None])) for i in range(700)] + [(1000 + i, "five words are in here", f"s{i}") for i in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(mixing, "SLOTS_LEAST", 32)
    monkeypatch.setattr(mixing, "SLOTS_MOST", 512)
    got = mixing.op10_source_mix(spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = db.execute(mixing.op10_sql(32, 512)).fetchall()
    assert sorted((x["doc_id"], x["size"], x["source_size"], round(x["target"], 6), x["taken"]) for x in got) == sorted((*x[:3], round(x[3], 6), x[4]) for x in want)
    tiny = [x for x in got if x["doc_id"] >= 1000]
    assert all(abs(x["taken"] - x["target"]) <= 1 for x in tiny)


def test_tiny_sources_beside_a_huge_one(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "trim(repeat('w ', 20000)) AS text", "'huge' AS source")
    docs = docs.unionByName(spark.createDataFrame([(1000 + i, "one two three four five", f"s{i}") for i in range(6)], "doc_id long, text string, source string"))
    sized, taken = mixing.mix(docs)
    sums = sized.join(taken.groupBy("_row").agg(F.sum("n_words").alias("n")), "_row", "left").groupBy("source").agg(F.sum("n").alias("n"), F.max("target").alias("target")).collect()
    assert len(sums) == 7 and all(abs(x["n"] - x["target"]) <= max(1, 0.01 * x["target"]) for x in sums)


def test_cut_texts_keep_their_white_space(spark):
    text = " one\n two\t\tthree \n\nfour five "
    df = spark.createDataFrame([(text, k, n) for k in range(5) for n in range(1, 6 - k)], "t string, k long, n long")
    for x in df.withColumn("got", mixing.first_words(F.col("t"), F.col("k"), F.col("n"))).collect():
        words = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
        assert x["got"] == text[words[x["k"]].start() : words[x["k"] + x["n"] - 1].end()]


def test_rows_alike_are_taken_as_often_as_the_mix_says(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", "p"), (1, "a b c d e f", "x", "q"), (1, "f e d c b a", "x", "r"), (2, "g h i j k l", "y", "s"), (3, " ", "y", "t")], "doc_id long, text string, source string, extra string")
    sized, taken = mixing.mix(docs)
    want = sized.join(taken.groupBy("_row", "epoch").agg(F.sum("n_words").alias("n")), "_row").agg(F.count("*"), F.sum("n")).first()
    out = mixing.mixed_documents(docs).collect()
    assert (len(out), sum(len(x["text"].split()) for x in out)) == tuple(want)


def test_mix_messy(spark, messy, empty):
    sized, taken = mixing.mix(messy)
    assert sized.count() == messy.count() and {r["size"] for r in sized.filter("doc_id IN (3, 4, 5)").collect()} == {0}
    got = {r["_row"]: r["n"] for r in taken.groupBy("_row").agg(F.sum("n_words").alias("n")).collect()}
    assert all(got.get(r["_row"], 0) <= 2 * r["size"] for r in sized.collect())
    out = mixing.mixed_documents(messy)
    assert out.columns == messy.columns and out.filter("doc_id IN (3, 4, 5)").count() == 0 and out.count() > 0
    assert mixing.mixed_documents(empty).count() == 0
