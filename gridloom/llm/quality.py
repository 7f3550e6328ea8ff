"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown level by level on histograms of binned statistics, and kept as complete trees in
flat arrays, which a block of documents descends together, a level at a time. They are fitted on a
bounded sample (MAX_DOCS labelled documents, of which only the statistics leave the executors); all
texts are scored whole.

Defined results: a null text counts as empty, and has a score like any other; rows with the same id
are rows of their own, of which training takes the one with the least statistics as bytes; an empty
table gives an empty result; without labels all scores are 1.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.arrays import chunks
from gridloom.llm.common import fold, masked, pick, small_batches, table
from gridloom.llm.labels import one_per_id, training_sample

MAX_DOCS, THRESHOLD = 20_000, 0.3
ROUNDS, DEPTH, BINS, RATE, RIDGE, LEAST = 80, 4, 64, 0.15, 1.0, 5.0

_CLASS = np.zeros(256, np.int64)  # 0 other, then upper, lower, digit, symbol, stop, comma, shout, bar, space, line end, byte over 127
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&<>=_{}[]\\/^~@+", b".", b",;:", b"!?", b"|", b" \t\r\x0b\x0c", b"\n"), 1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 11
_NO_LETTER = re.compile(rb"[^A-Za-z\x80-\xff]+")


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of document statistics per text."""
    rows = []
    for text in texts:
        b = (text or "").encode("utf-8", "surrogatepass")
        words = b.split()
        n, w = max(1, len(b)), max(1, len(words))
        by_class = np.bincount(_CLASS, np.bincount(np.frombuffer(b, np.uint8), minlength=256), 12)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
        counts = Counter(words)
        lines = [x for x in b.split(b"\n") if x.strip()]
        top = counts.most_common(3)
        rows.append([
            np.log1p(len(b)), np.log1p(len(words)), lengths.mean(), lengths.std(), lengths.max(),
            *(by_class / n), by_class[1] / (1 + by_class[1] + by_class[2] + by_class[11]),
            len(counts) / w, len(counts) / w**0.8, 1 - len(set(lines)) / max(1, len(lines)), len(lines) / w,
            max(map(len, lines), default=0) / n, top[0][1] / w if top else 0, sum(c for _, c in top) / w,
            sum(x == y for x, y in zip(words, words[1:], strict=False)) / w, sum(c for x, c in counts.items() if _NO_LETTER.fullmatch(x)) / w,
        ])
    return np.array(rows, np.float32).reshape(len(rows), -1)


def boost(x: np.ndarray, y: np.ndarray, rounds=ROUNDS, depth=DEPTH, bins=BINS, rate=RATE) -> dict[str, np.ndarray]:
    """feature and cut (round, inner node), leaf (round, leaf), base: a forest of complete trees."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # bin b: at most edge b
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = np.log(p0 / (1 - p0))
    inner = (1 << depth) - 1
    feature, cut, leaf = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf, np.float32), np.zeros((rounds, 1 << depth))
    margin = np.full(n, base)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h, at = p - y, p * (1 - p), np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = (1 << level) - 1, 1 << level
            local = at - first
            best = np.zeros(nodes)
            for j in range(d):
                slot, m = local * bins + binned[:, j], nodes * bins
                gl = np.cumsum(np.bincount(slot, g, m).reshape(nodes, bins), 1)
                hl = np.cumsum(np.bincount(slot, h, m).reshape(nodes, bins), 1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(hl < LEAST / 10) | (ht - hl < LEAST / 10)] = 0
                gain = gain[:, : len(edges[j])]
                if gain.shape[1]:
                    b = gain.argmax(1)
                    top = gain[np.arange(nodes), b]
                    for k in np.flatnonzero(top > best + 1e-9):
                        best[k], feature[t, first + k], cut[t, first + k] = top[k], j, edges[j][b[k]]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > cut[t, at])
        k = at - inner
        leaf[t] = -rate * np.bincount(k, g, 1 << depth) / (np.bincount(k, h, 1 << depth) + RIDGE)
        margin += leaf[t, k]
    return {"feature": feature, "cut": cut, "leaf": leaf, "base": np.array(base)}


def traverse(forest: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The probability of each row of x."""
    margin, rows = np.full(len(x), float(forest["base"])), np.arange(len(x))
    for feature, cut, leaf in zip(forest["feature"], forest["cut"], forest["leaf"], strict=True):
        at = np.zeros(len(x), np.int64)
        while len(at) and at[0] < len(feature):
            at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
        margin += leaf[at - len(feature)] if len(at) else 0
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in chunks(batches):
        rows = [r.tobytes() for r in statistics(texts)]
        yield pa.record_batch([part.column("key"), part.column("label"), pa.array(rows, pa.binary())], ["key", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_DOCS) -> dict[str, np.ndarray] | None:
    """The forest, or None without labels. At most `most` short rows come to the driver."""
    sample = small_batches(training_sample(docs, labels, label, most))
    rows = one_per_id(sample.mapInArrow(_statistics, "key string, label int, x binary")).toArrow()
    if not rows.num_rows:
        return None
    rows = rows.sort_by("key")
    x = np.stack([np.frombuffer(v, np.float32) for v in rows.column("x").to_pylist()])
    return boost(x, rows.column("label").to_numpy().astype(float))


def _scorer(model, text: str = "text"):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = model.value
        for part, texts in chunks(batches, text):
            p = np.ones(len(texts)) if forest is None else traverse(forest, statistics(texts))
            yield part.append_column("score", pa.array(p))

    return score


def _scored(df: DataFrame) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])


def quality(docs: DataFrame, forest: dict[str, np.ndarray] | None) -> DataFrame:
    """doc_id, score per row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    given = pick(docs, "doc_id", "text").select("doc_id", "text")
    return given.mapInArrow(_scorer(shared), _scored(given)).select("doc_id", "score")


def accepted(docs: DataFrame, forest: dict[str, np.ndarray] | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is at least the threshold, with all their columns, of which text is a string."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    own, at, back = masked(small_batches(docs))
    given = own.withColumn(at["text"], F.col(at["text"]).cast("string"))
    scored = given.mapInArrow(_scorer(shared, at["text"]), _scored(given))
    return scored.filter(F.col("score") >= threshold).select(*back)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
