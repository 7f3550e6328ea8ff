"""Language-model scoring by deleted interpolation.

A token's probability mixes the uniform one and the maximum-likelihood estimates of its n-grams,
n = 1 .. ORDER, with weights that depend on the frequency of its context, in powers of two. The
weights are learned by expectation-maximisation on a deleted part of the training documents,
against the counts of the rest; the scores then use the counts of all training documents.

Counts and scores cover every n-gram, without cut-off. Texts become blocks of about BLOCK tokens,
staged once. A block asks for the counts of its distinct n-grams with one row per range of n-gram
hashes (its own counts come along); each range is summed on its own; and the replies, in the order
of the hashes, go back to the block. So rows are arrays, no n-gram is a row of its own, and a
frequent n-gram is one entry per block. For the weights, the blocks of the deleted part (which are
blocks of their own) reduce their tokens to a histogram over (context bucket, quarter octaves of
each estimate), of bounded size, and expectation-maximisation runs on that.

Words and n-grams are told apart by 64-bit hashes.

Defined results: a null text counts as empty and is the end token alone; rows with the same id are
rows of their own; an empty table gives an empty result; without training documents all estimates
are 0 and the score is that of the uniform distribution.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.arrays import ascii_lower, hash_bytes, mix, word_codes
from gridloom.llm.common import fold, pick, stage, table

ORDER, BLOCK, RANGE = 2, 1_000_000, 1_500_000
#: One in DELETED training documents is in the deleted part.
DELETED, BUCKETS, ROUNDS = 20, 16, 200
END, BEGIN = np.uint64(0xE7D0_0000_0000_0001), np.uint64(0xB361_0000_0000_0001)
NONE, UNSEEN = 255, 254  # quantised estimate of 0, and of a context that training lacks


def pack(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, then compressed: sorted hashes and small counts get short."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, kind: str = "<u8") -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).reshape(n)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys, and where each key is among them."""
    codes, found = pd.factorize(keys)
    order = np.argsort(found)
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    return found[order], place[codes]


def range_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def grams(h: np.ndarray, ends: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-gram that ends at each token, n = 1 .. order; before a document stands BEGIN."""
    first = np.zeros(len(h), np.int64)
    first[ends[:-1]] = ends[:-1]
    since = np.arange(len(h)) - np.maximum.accumulate(first)
    out, key = [h], h
    for k in range(1, order):
        before = np.full(len(h), BEGIN)
        before[k:] = np.where(since[k:] >= k, h[:-k], BEGIN)
        key = mix(key + np.uint64(0x9E3779B97F4A7C15)) ^ mix(before + np.uint64(k))
        out.append(key)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents to rows of blocks; the deleted part has blocks of its own."""
    held: dict[bool, list] = {False: [], True: []}
    size = {False: 0, True: 0}

    def out(deleted, kind):
        rows = held[deleted]
        codes, distinct_words, ends = word_codes([w for _, _, w, _ in rows])
        codes = np.insert(codes, ends[1:], len(distinct_words))  # an end token after each document
        words = np.append(hash_bytes(distinct_words), END)
        lengths = np.diff(ends) + 1
        part = np.array([p for _, _, _, p in rows], "<u4")
        held[deleted], size[deleted] = [], 0
        return pa.RecordBatch.from_pydict({
            "block": [rows[0][0]], "deleted": [deleted], "n_tokens": [len(codes)], "n_train": [int(lengths[part > 0].sum())], "n_docs": [int((part > 0).sum())],
            "lengths": [lengths.astype("<u4").tobytes()], "parts": [part.tobytes()], "words": [words.astype("<u8").tobytes()], "codes": [pack(codes.astype("<u4"))],
            "ids": pa.array([[i for _, i, _, _ in rows]], pa.list_(kind)),
        })

    for batch in batches:
        kind = batch.column(1).type
        for row, doc_id, text, part in zip(*batch.columns, strict=True):
            p = part.as_py()  # 0 not for training, 1 training, 2 training, deleted part
            words = ascii_lower(text.as_py()).split()
            held[p == 2].append((row.as_py(), doc_id.as_py(), words, p))
            size[p == 2] += len(words) + 1
            if size[p == 2] >= BLOCK:
                yield out(p == 2, kind)
    for deleted in (False, True):
        if held[deleted]:
            yield out(deleted, kind)


_BLOCK = "block long, deleted boolean, n_tokens long, n_train long, n_docs long, lengths binary, parts binary, words binary, codes binary"


def _open(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes, where each document begins, and each document's part."""
    tokens = np.frombuffer(block["words"], "<u8")[unpack(block["codes"], block["n_tokens"], "<u4")]
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(block["lengths"], "<u4").astype(np.int64))])
    return tokens, ends, np.frombuffer(block["parts"], "<u4")


def _requests(order: int, n_ranges: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1).to_pylist()[0]
                tokens, ends, part = _open(block)
                train = np.repeat(part > 0, np.diff(ends))
                for k, keys in enumerate(grams(tokens, ends, order), 1):
                    found, code = distinct(keys)
                    times = np.bincount(code[train], minlength=len(found)).astype("<u8")
                    ranges = range_of(found, n_ranges)
                    at = np.flatnonzero(np.diff(ranges, prepend=-1))  # where each range that occurs begins
                    ends_at = np.append(at[1:], len(found))
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array(ranges[at] * (order + 1) + k, pa.int64()), "block": pa.array([block["block"]] * len(at), pa.int64()), "deleted": pa.array([block["deleted"]] * len(at)),
                        "n": pa.array(ends_at - at, pa.int64()), "keys": [pack(found[a:b]) for a, b in zip(at, ends_at, strict=True)], "times": [pack(times[a:b]) for a, b in zip(at, ends_at, strict=True)],
                    })

    return ask


_REQUEST = "part long, block long, deleted boolean, n long, keys binary, times binary"
_REPLY = "part long, block long, deleted boolean, n long, every binary, rest binary, n_distinct long"


def _sum(table_: pa.Table) -> pa.Table:
    """The counts of one range: to each block those of its keys, over all training documents and without the deleted part."""
    rows = table_.to_pylist()
    found, code = distinct(np.concatenate([unpack(r["keys"], r["n"]) for r in rows]))
    times = np.concatenate([unpack(r["times"], r["n"]) for r in rows])
    gone = np.repeat(np.array([r["deleted"] for r in rows]), [r["n"] for r in rows])
    every = np.bincount(code, times, len(found)).astype("<u8")
    rest = np.bincount(code[~gone], times[~gone], len(found)).astype("<u8")
    at = np.cumsum([0] + [r["n"] for r in rows])
    replies = [
        {"part": r["part"], "block": r["block"], "deleted": r["deleted"], "n": r["n"], "every": pack(every[code[a:b]]), "rest": pack(rest[code[a:b]]) if r["deleted"] else None, "n_distinct": 0}
        for r, a, b in zip(rows, at[:-1], at[1:], strict=True)
    ]
    replies.append({"part": rows[0]["part"], "block": -1, "deleted": False, "n": 0, "every": None, "rest": None, "n_distinct": int((every > 0).sum())})
    return pa.Table.from_pylist(replies, schema=_reply_schema())


def _reply_schema() -> pa.Schema:
    return pa.schema([("part", pa.int64()), ("block", pa.int64()), ("deleted", pa.bool_()), ("n", pa.int64()), ("every", pa.binary()), ("rest", pa.binary()), ("n_distinct", pa.int64())])


def _counts(replies: list[dict], name: str, keys: list[np.ndarray], ends: np.ndarray, order: int, n_docs: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per n: the count of the n-gram at each token, and of its context."""
    count, context = [], []
    starts = ends[:-1]
    for k in range(1, order + 1):
        mine = sorted((r for r in replies if r["part"] % (order + 1) == k), key=lambda r: r["part"])
        values = np.concatenate([unpack(r[name], r["n"]) for r in mine]).astype(float)
        count.append(values[distinct(keys[k - 1])[1]])
        before = np.empty(len(keys[0]))
        if k > 1:
            before[1:] = count[k - 2][:-1]
            before[starts] = n_docs
        context.append(before)
    return count, context


def _estimates(count, context, total: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per n: the estimate at each token, and whether there is one (its context occurs in training)."""
    every = [np.full(len(count[0]), total), *context[1:]]
    there = [b > 0 for b in every]
    return [np.divide(c, b, out=np.zeros(len(c)), where=t) for c, b, t in zip(count, every, there, strict=True)], there


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(1 + context).astype(np.int64), BUCKETS - 1)


def _histogram(order: int, total: float, n_docs: float):
    """Tokens of a deleted block as (bucket and quantised estimates, packed; number)."""

    def count(key, blocks: pa.Table, replies: pa.Table) -> pa.Table:
        tokens, ends, _ = _open(blocks.to_pylist()[0])
        counts, context = _counts(replies.to_pylist(), "rest", grams(tokens, ends, order), ends, order, n_docs)
        cell = bucket(context[-1] if order > 1 else np.zeros(len(tokens)))
        for p, there in zip(*_estimates(counts, context, total), strict=True):
            q = np.where(p > 0, np.clip(np.rint(-4 * np.log2(np.maximum(p, 1e-300))), 0, UNSEEN - 1), np.where(there, NONE, UNSEEN)).astype(np.int64)
            cell = cell << 8 | q
        found, n = np.unique(cell, return_counts=True)
        return pa.table({"cell": pa.array(found, pa.int64()), "n": pa.array(n, pa.int64())})

    return count


def mixture(cells: np.ndarray, times: np.ndarray, order: int, uniform: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bucket; uniform, then n = 1 .. order) by expectation-maximisation on the histogram.

    Where a context is unseen, its estimate takes no part and the others share its weight; the
    expectation then counts it as often as its weight says it would have been drawn and put back.
    """
    q = np.stack([cells >> 8 * (order - 1 - k) & 255 for k in range(order)], 1)
    p = np.concatenate([np.full((len(cells), 1), uniform), np.where(q >= UNSEEN, 0.0, 2.0 ** (-q / 4))], 1)
    gone = np.concatenate([np.zeros((len(cells), 1), bool), q == UNSEEN], 1)
    b = cells >> 8 * order

    def step(w, mine, prior):
        r = p[mine] * w
        r = r / r.sum(1, keepdims=True) + gone[mine] * w / (~gone[mine] * w).sum(1, keepdims=True)
        drawn = (r * times[mine][:, None]).sum(0) + prior
        return drawn / drawn.sum()

    every = np.full(order + 1, 1 / (order + 1))
    weights = np.empty((BUCKETS, order + 1))
    # First over all buckets; what this gives is the prior (of weight 10) of each bucket.
    for _ in range(rounds if len(cells) else 0):
        every = step(every, slice(None), 1e-3)
    for k in range(BUCKETS):
        mine, w = b == k, every
        for _ in range(rounds if mine.any() else 0):
            w = step(w, mine, 10 * every)
        weights[k] = w
    return weights


def _score(order: int, total: float, n_docs: float, n_distinct: int, weights: np.ndarray):
    def score(key, blocks: pa.Table, replies: pa.Table) -> pa.Table:
        block = blocks.drop_columns(["ids"]).to_pylist()[0]
        tokens, ends, _ = _open(block)
        counts, context = _counts(replies.to_pylist(), "every", grams(tokens, ends, order), ends, order, n_docs)
        w = weights[bucket(context[-1] if order > 1 else np.zeros(len(tokens)))]
        p, shared = w[:, 0] / (n_distinct + 1), w[:, 0]
        for k, (e, there) in enumerate(zip(*_estimates(counts, context, total), strict=True), 1):
            p, shared = p + w[:, k] * e, shared + w[:, k] * there
        p = p / shared
        base = np.log10((counts[0] + 0.5) / (total + 0.5 * (n_distinct + 1)))
        score, base, known = (np.add.reduceat(x, ends[:-1]) for x in (np.log10(p), base, (counts[0] > 0).astype(np.int64)))
        ids = blocks.column("ids").combine_chunks().flatten()
        return pa.table({"doc_id": ids, "n_tokens": pa.array(np.diff(ends)), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(score)})

    return score


def lm_scores(docs: DataFrame, trains, deleted, order: int = ORDER) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score per row of docs.

    trains and deleted are conditions on doc_id and text: which documents are for training, and
    which of them are the deleted part.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    part = F.when(trains & deleted, 2).when(trains, 1).otherwise(0).cast("int")
    rows = pick(docs, "doc_id", "text").select("_row", "doc_id", "text", part.alias("part"))
    blocks = stage(rows.mapInArrow(_blocks, f"{_BLOCK}, ids array<{kind}>"), "blocks")
    rest = ~F.col("deleted")
    sizes = blocks.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(name) for name, x in (("n", F.col("n_tokens")), ("train", F.col("n_train")), ("docs", F.col("n_docs")), ("rest", F.when(rest, F.col("n_train"))), ("rest_docs", F.when(rest, F.col("n_docs"))))]).first()
    n_ranges = 1 + order * sizes["n"] // RANGE
    asked = blocks.drop("ids").mapInArrow(_requests(order, n_ranges), _REQUEST)
    replies = stage(asked.groupBy("part").applyInArrow(_sum, _REPLY), "replies")
    n_distinct = replies.filter(F.col("part") % (order + 1) == 1).agg(F.sum("n_distinct")).first()[0] or 0
    replies = replies.filter("block >= 0").drop("n_distinct")
    seen = blocks.drop("ids").filter(~rest).groupBy("block").cogroup(replies.filter(~rest).groupBy("block")).applyInArrow(_histogram(order, float(sizes["rest"]), float(sizes["rest_docs"])), "cell long, n long")
    cells = seen.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    weights = mixture(cells.column(0).to_numpy(), cells.column(1).to_numpy().astype(float), order, 1 / (n_distinct + 1))
    score = _score(order, float(sizes["train"]), float(sizes["docs"]), n_distinct, weights)
    scored = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(sizes["train"]).cast("long"))


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0))
    held_out = fold(F.col("doc_id")) == 1
    out = lm_scores(table(spark, sf_dir, "documents"), ~held_out, F.floor(crc / 5) % DELETED == 0)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
