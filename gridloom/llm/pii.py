"""Personal data by weak supervision.

Fixed patterns find the base spans, which always stay. Looser patterns find further candidates:
written-out addresses ("name at host dot org"), IPv6 and disguised addresses, and telephone and card
numbers bare, grouped or within longer runs. On each span, base or candidate, five labelers vote yes,
no or nothing: the form (checksum, range, length, borders and variety of digits), a gazetteer (domain
endings, calling codes, card issuers), one of words that stand before numbers of other kinds, cue
words in the context, and the word that follows. Votes are discrete, so the corpus comes down to a
table of vote patterns with their frequencies, of bounded size. Expectation-maximisation on it
estimates each labeler's reliability and the share of true spans per kind, apart for base spans and
candidates. With its posteriors as soft labels, a logistic regression is trained, the span
classifier; beside the votes it sees a span's shape, leading digits and neighbouring words, hashed.
It is fitted on a sample (about PER_PATTERN spans of each vote pattern). Candidates it gives at least
THRESHOLD become spans too, the likeliest first, where they overlap no other span.

All scans take time in proportion to the text.

Defined results: a null text counts as empty and has no spans; rows with the same id are rows of
their own; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import pick, stage, table

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("form", "gazetteer", "foreign", "cue", "after")
THRESHOLD, CONTEXT, ROUNDS = 0.8, 40, 60
#: Hashed features of the span classifier, and spans of each vote pattern in its sample.
WIDTH, PER_PATTERN = 512, 64

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
#: From the first digit of a run only, and never giving digits back: neither could change a match.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
THOUSANDS = re.compile(r"[0-9]{1,3}(?:\.[0-9]{3})+")

_LOCAL, _HOST = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+", r"[A-Za-z0-9-]{1,63}+"
_HEX = r"[0-9A-Fa-f]{1,4}"
LOOSE = tuple((kind, re.compile(p)) for kind, p in (
    (0, rf"{_LOCAL}(?: at | ?[\[({{<]at[\])}}>] ?| ?@ ?){_HOST}(?:(?: dot | ?[\[({{<]dot[\])}}>] ?| ?\. ?){_HOST}){{1,4}}"),
    (1, rf"(?<![0-9A-Za-z:.])(?:{_HEX}:){{7}}{_HEX}(?![0-9A-Za-z:])"),
    (1, rf"(?<![0-9A-Za-z:.])(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}(?![0-9A-Za-z:])"),
    (1, r"(?<![0-9A-Za-z])[0-9]{1,3}( ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)| dot |\.|-) ?)[0-9]{1,3}\1[0-9]{1,3}\1[0-9]{1,3}(?![0-9A-Za-z])"),
    (2, r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    (2, r"(?<![0-9])[0-9]{4}([ ./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])"),
    (2, r"(?<![0-9])[0-9]{4}([ ./_-])[0-9]{6}\1[0-9]{4,5}(?![0-9])"),
    (3, r"(?<![0-9+.])\+[0-9][\x20().0-9/-]{6,18}[0-9](?![0-9])"),
    (3, r"(?<![0-9A-Za-z+.])(?:00[1-9][0-9]{0,2}[ ./-]?)?\(?[0-9]{2,5}\)?[ ./-]{0,3}[0-9]{3,4}[ ./-][0-9]{3,4}(?![0-9A-Za-z]|[ ./-][0-9])"),
    (3, r"(?<![0-9A-Za-z+.])(?:00[1-9][0-9]{0,2}[ ./-]?)?\(?[0-9]{1,4}\)?(?:[ ./-][0-9]{2}){4}(?![0-9A-Za-z]|[ ./-][0-9])"),
    (3, r"(?<![0-9A-Za-z+.])[0-9]{9,12}(?![0-9A-Za-z])"),
))

#: Gazetteers and cue words, in lower case.
ENDINGS = frozenset("com org net edu gov info biz io de fr es uk eu us ca au jp cn ru it nl ch at be se no pl br in".split())
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "35", "36", "37", "38", "60", "62", "64", "65")
FOREIGN = frozenset("version isbn issn page pages figure table chapter section order invoice article year build release line no nr serial ticket ref reference sku part model".split())
UNITS = frozenset("euro euros dollars usd eur kg km cm mm pages items units times years days hours percent bytes kb mb gb".split())
CUES = {
    0: frozenset("mail email e-mail contact write address correo courriel mailto".split()),
    1: frozenset("ip ipv6 host server address addr ping login network".split()),
    2: frozenset("card visa mastercard amex credit debit payment tarjeta carte karte iban account".split()),
    3: frozenset("phone tel telephone call fax mobile cell whatsapp sms ring dial telefon teléfono téléphone".split()),
}


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[::-1]]
    return sum(odd[::2] + [2 * d - 9 * (d > 4) for d in odd[1::2]]) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found, at = [], 0
    p = text.find("@")
    while p >= 0:  # an address has its sign after a run of local characters: look at the signs only
        a = p
        while a > at and LOCAL.fullmatch(text[a - 1]):
            a -= 1
        if a < p and (m := EMAIL.match(text, a)):
            found.append((a, 0, at := m.end()))
        p = text.find("@", max(p + 1, at))
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() < 40 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the looser patterns that overlap no base span; they may overlap each other."""
    found = set()
    digits, signs = DIGIT.search(text) is not None, "@" in text or re.search(r" at |at[\])}>]", text) is not None
    ends = [0]  # the furthest end of the base spans so far
    for _, _, b in base:
        ends.append(max(ends[-1], b))
    starts = [a for a, _, _ in base]
    for kind, pattern in LOOSE:
        if not (signs if kind == 0 else digits or ":" in text and kind == 1):
            continue
        for m in pattern.finditer(text):
            if kind == 0 and not re.search(r"[\[({<]at|@|[\[({<]dot| dot ", m[0]):
                continue
            if ends[bisect_left(starts, m.end())] <= m.start() and not (kind == 3 and THOUSANDS.fullmatch(m[0])):
                found.add((m.start(), kind, m.end()))
    return sorted(found)


def _form(kind: int, span: str, digits: str) -> bool:
    if kind == 0:
        last = re.split(r"[^A-Za-z]", span)[-1].lower()
        return len(last) > 1 and (last in ENDINGS or " at " not in span)  # plain words need a known ending
    if kind == 1:
        return ":" in span or all(len(x) < 4 and int(x) <= 255 for x in re.findall("[0-9]+", span))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) >= 4
    return 7 <= len(digits) <= 15 and len(set(digits)) >= 4


def votes(text: str, start: int, kind: int, end: int) -> tuple[int, ...]:
    """The labelers' votes: 1, -1, or 0 where a labeler has nothing to go by."""
    span = text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    before = re.findall(r"[^\W\d_][\w-]*", text[max(0, start - CONTEXT) : start].lower())
    after = re.match(r"\s?([^\W\d_]+)", text[end : end + CONTEXT].lower())
    alone = not any(c.isalnum() for c in (text[start - 1 : start] if start else "") + text[end : end + 1])
    known = 0
    if kind == 0:
        known = 1 if re.split(r"[^a-z]+", span.lower())[-1] in ENDINGS else -1
    elif kind == 2:
        known = 1 if digits.startswith(ISSUERS) else -1
    elif kind == 3 and span[0] == "+":
        known = 1 if any(digits[:k] in CALLING for k in (1, 2, 3)) else -1
    return (
        1 if alone and _form(kind, span, digits) else -1, known, -1 if before and before[-1] in FOREIGN else 1,
        1 if not CUES[kind].isdisjoint(before[-6:]) else -1, -1 if after and after[1] in UNITS else 1,
    )


def marks(text: str, start: int, kind: int, end: int, vote: tuple[int, ...]) -> list[int]:
    """The classifier's features of a span, hashed: votes, shape, leading digits and neighbouring words."""
    span = text[start : min(end, start + 64)]
    shape = re.sub("[0-9]", "d", re.sub("[A-Za-z]+", "a", span))
    words = re.findall(r"[^\W\d_]+", text[max(0, start - CONTEXT) : start].lower())[-2:]
    after = re.findall(r"[^\W\d_]+", text[end : end + CONTEXT].lower())[:1]
    n = sum(c in "0123456789" for c in span)
    own = [f"kind {kind}", f"shape {kind} {shape}", f"digits {kind} {n}", f"lead {kind} {span[:2]}", f"marks {kind} {''.join(sorted(set(re.sub('[0-9A-Za-z]', '', span))))}"]
    own += [f"vote {k} {v}" for k, v in enumerate(vote)] + [f"vote {kind} {k} {v}" for k, v in enumerate(vote)]
    own += [f"before {kind} {w}" for w in words] + [f"after {kind} {w}" for w in after]
    return sorted({zlib.crc32(x.encode()) % WIDTH for x in own})


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.list_(pa.int32())), ("marks", pa.list_(pa.int32()))])
_SPANS = "array<struct<start: int, kind: int, end: int, base: boolean, votes: array<int>, marks: array<int>>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for x in batch.column(2):
            text = x.as_py() or ""
            base = base_spans(text)
            found = [(*s, True) for s in base] + [(*s, False) for s in candidates(text, base)]
            own = []
            for start, kind, end, strict in found:
                vote = votes(text, start, kind, end)
                own.append({"start": start, "kind": kind, "end": end, "base": strict, "votes": vote, "marks": marks(text, start, kind, end, vote)})
            rows.append(own)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(rows, pa.list_(_SPAN))], ["_row", "doc_id", "found"])


def reliabilities(patterns: np.ndarray, times: np.ndarray, rounds: int = ROUNDS, anchored: bool = False) -> np.ndarray:
    """Posterior of each vote pattern by expectation-maximisation over labelers taken as independent.

    patterns: kind, then the strict pattern (1 or -1), then a vote per labeler. A labeler's chances of
    each vote are estimated per kind for true and for false spans, with one prior for all, that it is
    right more often than not; a yes never counts against a span, nor a no for it. The share of true
    spans is per kind, apart for strict and for loose ones. With `anchored`, what the strict patterns
    find counts as true throughout, as base spans do.
    """
    kind, group, v = patterns[:, 0], patterns[:, 0] * 2 + (patterns[:, 1] > 0), patterns[:, 2:] + 1
    yes, no = (patterns[:, 1:] > 0).sum(1), (patterns[:, 1:] < 0).sum(1)
    known = (patterns[:, 1] > 0) & anchored
    p = np.where(known, 1.0, (1 + yes) / (2 + yes + no))
    for _ in range(rounds):
        score = np.zeros(len(p))
        for k in np.unique(group):
            mine = group == k
            score[mine] = np.log((times[mine] @ p[mine] + 1) / (times[mine] @ (1 - p[mine]) + 1))
        for k in np.unique(kind):
            mine = kind == k
            for j in range(v.shape[1]):
                true = np.bincount(v[mine, j], (times * p)[mine], 3)[[0, 2]] + [1.0, 8.0]
                false = np.bincount(v[mine, j], (times * (1 - p))[mine], 3)[[0, 2]] + [4.0, 1.0]
                ratio = np.log((true / true.sum()) / (false / false.sum()))
                score[mine] += np.array([min(0.0, ratio[0]), 0.0, max(0.0, ratio[1])])[v[mine, j]]
        p = np.where(known, 1.0, 1 / (1 + np.exp(-np.clip(score, -30, 30))))
    return p


def classifier(rows: list[list[int]], soft: np.ndarray, weight: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton steps; the bias is the last."""
    w = np.zeros(WIDTH + 1)
    for _ in range(rounds):
        h, g = ridge * np.eye(len(w)), ridge * w
        for a in range(0, len(rows), 2048):
            part = slice(a, a + 2048)
            x = np.zeros((len(rows[part]), len(w)))
            for i, r in enumerate(rows[part]):
                x[i, r] = 1
            x[:, -1] = 1
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h += (x * (weight[part] * p * (1 - p))[:, None]).T @ x
            g += x.T @ (weight[part] * (p - soft[part]))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def span_model(scanned: DataFrame) -> np.ndarray:
    """The classifier's weights.

    What comes to the driver is the table of vote patterns (8 * 3 ** 5 at most) and the sample, both
    bounded whatever the corpus.
    """
    every = scanned.select("_row", F.explode("found").alias("s")).select("_row", "s.*")
    pattern = F.concat(F.array(F.col("kind"), F.when(F.col("base"), 1).otherwise(-1)), F.col("votes"))
    every = every.withColumn("p", pattern)
    found = every.groupBy("p").count().orderBy("p").collect()
    if not found:
        return np.append(np.zeros(WIDTH), -30.0)
    patterns, times = np.array([r["p"] for r in found]), np.array([float(r["count"]) for r in found])
    posterior = {tuple(r["p"]): (q, r["count"]) for r, q in zip(found, reliabilities(patterns, times, anchored=True), strict=True)}
    rates = scanned.sparkSession.createDataFrame([(list(k), min(1.0, PER_PATTERN / n)) for k, (_, n) in posterior.items()], "p array<int>, rate double")
    chance = F.pmod(F.xxhash64("_row", "start", "kind", "end"), F.lit(1 << 30)) / float(1 << 30)
    sample = every.join(F.broadcast(rates), "p").filter(chance < F.col("rate")).select("p", "marks").orderBy("p", "marks").collect()
    own = [tuple(r["p"]) for r in sample]
    soft = np.array([posterior[k][0] for k in own])
    drawn = Counter(own)
    weight = np.array([(1 + np.log(posterior[k][1])) / drawn[k] for k in own])  # else a few frequent patterns are all that counts
    return classifier([r["marks"] for r in sample], soft, weight)


def chosen(found: list[dict], w: np.ndarray, threshold: float) -> list[tuple[int, int, int, bool, float]]:
    """(start, kind, end, base, chance) of the base spans and of the candidates that become spans, in order."""
    score = [1 / (1 + np.exp(-np.clip(w[s["marks"]].sum() + w[-1], -30, 30))) for s in found]
    base = [(s["start"], s["kind"], s["end"], True, float(p)) for s, p in zip(found, score, strict=True) if s["base"]]
    more = sorted((-p, s["start"], s["kind"], s["end"]) for s, p in zip(found, score, strict=True) if not s["base"] and p >= threshold)
    taken: list[tuple[int, int]] = []  # of the candidates, in order and apart from each other
    for p, start, kind, end in more:
        at = bisect_left(taken, (start, end))
        if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
            taken.insert(at, (start, end))
            base.append((start, kind, end, False, float(-p)))
    return sorted(base)


def spans(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """_row, doc_id, spans per row of docs: start, kind, end (code points, end exclusive), base, chance of each."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = stage(pick(docs, "doc_id", "text").select("_row", "doc_id", "text").mapInArrow(_scan, f"_row long, doc_id {kind}, found {_SPANS}"), "spans")
    model = docs.sparkSession.sparkContext.broadcast(span_model(scanned))
    out = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("chance", pa.float64())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [chosen(found, model.value, threshold) if found else [] for found in batch.column(2).to_pylist()]
            rows = [[dict(zip(("start", "kind", "end", "base", "chance"), s, strict=True)) for s in r] for r in rows]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(rows, out)], ["_row", "doc_id", "spans"])

    return scanned.mapInArrow(finish, f"_row long, doc_id {kind}, spans array<struct<start: int, kind: int, end: int, base: boolean, chance: double>>")


def personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base counts per kind, base_sha256 and spans ("kind:start:end", comma-joined) per row of docs."""
    found = spans(docs, threshold)
    names = F.array(*[F.lit(k) for k in KINDS])
    base = F.filter("spans", lambda s: s["base"])

    def joined(x):
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    def times(k):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")

    counts = [times(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
