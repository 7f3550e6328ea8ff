"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed words, stems (a word's first STEM bytes, so that forms of a word
that training has not met count too), word pairs and pairs with one word between of a text. The
learner keeps a rate per coordinate, and its L1 term leaves most weights at zero, so the model that
is broadcast is short. It is fitted on a bounded sample (MAX_DOCS labelled documents), one after the
other as the method asks: each epoch is a task that streams the sample's written vectors, so what it
holds is its state of 2 ** BITS coordinates and one vector. All texts are scored whole.

Defined results: a null or empty text has the score of the bias alone; rows with the same id are
rows of their own, of which training takes the one with the least vector as bytes; an empty table
gives an empty result; without labels all scores are 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.arrays import ascii_lower, chunks, hash_words, mix
from gridloom.llm.common import fold, pick, small_batches, stage, table, unstage
from gridloom.llm.labels import one_per_id, training_sample

BITS = 20
STEM = 4
MAX_DOCS, EPOCHS = 12_000, 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.0
TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+")


def features(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document, hashed feature) of each occurrence: words, stems, pairs, pairs around a word."""
    h, ends, stems = hash_words([TOKEN.findall(ascii_lower(t)) for t in texts], STEM)
    doc = np.repeat(np.arange(len(texts)), np.diff(ends))
    parts = [(doc, mix(h)), (doc, mix(stems ^ np.uint64(0x632BE59B)))]
    for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
        same = doc[:-gap] == doc[gap:]
        parts.append((doc[:-gap][same], mix(mix(h[:-gap][same] + np.uint64(salt)) ^ h[gap:][same])))
    return np.concatenate([d for d, _ in parts]), (np.concatenate([x for _, x in parts]) >> np.uint64(64 - bits)).astype(np.int64)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in chunks(batches):
        doc, x = features(texts)
        pairs = np.unique(doc << BITS | x)
        at = np.searchsorted(pairs >> BITS, np.arange(len(texts) + 1))
        rows = [(pairs[a:b] & (1 << BITS) - 1).astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.record_batch([part.column("key"), part.column("label"), pa.array(rows, pa.binary())], ["key", "label", "x"])


class Ftrl:
    """The learner's state: per coordinate the sums z and n; the bias, free of L1, is the last."""

    def __init__(self, bits: int = BITS, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        size = (1 << bits) + 1
        self.z, self.n, self.alpha, self.beta, self.l1, self.l2 = np.zeros(size), np.zeros(size), alpha, beta, l1, l2

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, least = self.z[i], np.where(i == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) > least, -(z - np.sign(z) * least) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2), 0.0)

    def learn(self, y: int, x: np.ndarray) -> None:
        i = np.append(x.astype(np.int64), len(self.z) - 1)
        w, n = self.weights(i), self.n[i]
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def ftrl(examples: list[tuple[int, np.ndarray]], bits: int = BITS, epochs: int = EPOCHS, **rates) -> np.ndarray:
    """Weights, with the bias last."""
    learner = Ftrl(bits, **rates)
    for _ in range(epochs):
        for y, x in examples:
            learner.learn(y, x)
    return learner.weights(np.arange(len(learner.z)))


def _epoch(state):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Ftrl()
        at, learner.z[at], learner.n[at] = state.value if state else (slice(0), 0, 0)
        for batch in batches:
            for y, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                learner.learn(y, np.frombuffer(x.as_buffer(), "<u4"))
        at = np.flatnonzero(learner.n)
        yield pa.record_batch([pa.array(at), pa.array(learner.z[at]), pa.array(learner.n[at]), pa.array(learner.weights(at))], ["i", "z", "n", "w"])

    return train


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_DOCS, epochs: int = EPOCHS) -> DataFrame:
    """i, w: the weights that are not zero; i = 2 ** BITS is the bias."""
    spark = docs.sparkSession
    sample = small_batches(training_sample(docs, labels, label, most))
    vectors = one_per_id(sample.mapInArrow(_vectors, "key string, label int, x binary"))
    ordered = stage(vectors.repartition(1).sortWithinPartitions("key").select("label", "x"), "vectors")
    state = None
    for _ in range(epochs):
        # One task, whatever the number of row groups; at most 2 ** BITS + 1 rows come to the driver.
        got = ordered.coalesce(1).mapInArrow(_epoch(state), "i long, z double, n double, w double").toArrow()
        state = spark.sparkContext.broadcast(tuple(got.column(c).to_numpy() for c in ("i", "z", "n")))
    unstage(ordered)
    found = got.filter(pa.compute.not_equal(got.column("w"), 0.0)).select(["i", "w"])
    return spark.createDataFrame(found, "i long, w double") if found.num_rows else spark.createDataFrame([], "i long, w double")


def _scorer(model, bits: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values = model.value
        w = np.zeros((1 << bits) + 1)
        w[at] = values
        bias, empty = w[-1], not len(at)
        for part, texts in chunks(batches):
            doc, x = features(texts, bits)
            hit = w[x] != 0
            pairs = np.unique(doc[hit] << bits | x[hit])  # a feature counts once in a text
            total = bias + np.bincount(pairs >> bits, w[pairs & (1 << bits) - 1], len(texts))
            p = np.zeros(len(texts)) if empty else 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.record_batch([part.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    return score


def toxicity(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """doc_id, score per row of docs, with the weights of fit()."""
    model = weights.toArrow()  # at most 2 ** BITS + 1 rows
    shared = docs.sparkSession.sparkContext.broadcast((model.column(0).to_numpy(), model.column(1).to_numpy()))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return pick(docs, "doc_id", "text").select("doc_id", "text").mapInArrow(_scorer(shared, BITS), f"doc_id {kind}, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
