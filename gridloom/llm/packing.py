"""Best-fit packing by minimum bin slack.

A document's ids (with an end mark) are cut, if longer than the sequence, into pieces of the full
length, of which the first may be shorter. Packing needs the pieces' lengths only, so the method
runs on their histogram, which has at most `capacity` entries: per bin, a bitset subset-sum over
the available lengths, with the largest of them in the bin, finds the fullest feasible combination,
which is then removed, as often as it can be: the same search would find it again and again. A piece
finds its place by its rank among the pieces of its length, a running sum in two levels.

Defined results: a null text counts as empty and is a piece of the end mark alone; rows with the
same id are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import pick, running_sum, stage, table

CAPACITY, END = 1024, 2

#: Texts of these characters only, with no word over LONGEST, are encoded by the faster library; on
#: these, all regex engines agree which characters are letters, digits and space.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1\xa7\xab\xb0\xb7\xbb\xbf\xc0-\xd6\xd8-\xf6\xf8-\u017f\u2013\u2014\u2018-\u201d\u2026\u20ac]*")
LONGEST = 4000


def byte_symbols() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow 255 in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as little-endian uint32 bytes, by the file of a byte-level BPE tokenizer.

    The file is that of `tokenizers`, whose ids these are. Plain texts go through tiktoken, given
    the same vocabulary as ranks, which is several times as fast; it applies where the vocabulary
    is in the order of the merges. All other texts, and those with a special string, go through
    `tokenizers` itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kept = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, kept))) if kept else None
        self.fast = self._ranked(path)

    @staticmethod
    def _ranked(path: str):
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"]
        byte_level = cut and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not spec["normalizer"]
        merged = [model["vocab"][x.replace(" ", "") if isinstance(x, str) else "".join(x)] for x in model.get("merges", [])]
        if not byte_level or any(x >= y for x, y in zip(merged, merged[1:], strict=False)):
            return None
        symbols, added = byte_symbols(), {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(symbols[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bool:
        if self.fast is None or PLAIN.fullmatch(text) is None or (self.special and self.special.search(text)):
            return False
        return len(text) <= LONGEST or max(map(len, text.split()), default=0) <= LONGEST

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self._plain(t) for t in texts]
        rest = iter(self.tokenizer.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [self.fast.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes() if p else np.array(next(rest).ids, "<u4").tobytes() for t, p in zip(texts, plain, strict=True)]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of n ids; only the first may be shorter than the capacity."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((a, a + capacity) for a in range(first, n, capacity))]


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    mark = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                at, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, got in enumerate(encoder.encode([x or "" for x in part.column(2).to_pylist()])):
                    got += mark
                    for k, (x, y) in enumerate(cuts(len(got) // 4, capacity)):
                        own = got[4 * x : 4 * y]
                        at.append(i)
                        piece.append(k)
                        start.append(x)
                        length.append(y - x)
                        crc.append(zlib.crc32(own))
                        ids.append(own if with_ids else None)
                take = pa.array(at, pa.int32())
                yield pa.record_batch(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary())],
                    ["_row", "doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    return run


def fullest(avail: dict[int, int], room: int) -> list[int]:
    """The lengths of the fullest feasible combination within room; larger lengths where there are several."""
    reach, steps, goal = 1, [], 1 << room
    mask = (goal << 1) - 1
    for length in sorted((x for x, n in avail.items() if n and x <= room), reverse=True):
        left, k = min(avail[length], room // length), 1
        while left:  # so many copies as sums of powers of two
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (k * length)) & mask
            left, k = left - k, 2 * k
        if reach & goal:
            break
    at, found = reach.bit_length() - 1, []
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            found += [length] * k
            at -= k * length
    return found


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins) by minimum bin slack over a histogram of lengths."""
    avail, out = {k: n for k, n in counts.items() if n}, []
    while avail:
        largest = max(avail)
        rest = {**avail, largest: avail[largest] - 1}
        used = sorted([largest, *fullest(rest, capacity - largest)], reverse=True)
        times = min(avail[x] // used.count(x) for x in set(used))
        out.append((used, times))
        for x in set(used):
            avail[x] -= times * used.count(x)
            if not avail[x]:
                del avail[x]
    return out


def places(found: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """Per length: rows of (first rank, copies in a bin, first bin, first offset), by rank."""
    rows: dict[int, list] = {}
    ranks: dict[int, int] = {}
    bins = 0
    for used, times in found:
        offset = 0
        for x in dict.fromkeys(used):
            m = used.count(x)
            rows.setdefault(x, []).append((ranks.get(x, 0), m, bins, offset))
            ranks[x] = ranks.get(x, 0) + m * times
            offset += m * x
        bins += times
    return {x: np.array(r, np.int64) for x, r in rows.items()}


def _placer(spots):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = spots.value
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at, rows = np.flatnonzero(length == x), where[int(x)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                turn, copy = np.divmod(rank[at] - row[:, 0], row[:, 1])
                seq[at], off[at] = row[:, 2] + turn, row[:, 3] + copy * x
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.record_batch([*(batch.column(n) for n in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, ids (null unless asked for), sequence_id, offset."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    cols = f"_row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary"
    pieces = stage(pick(docs, "doc_id", "text").select("_row", "doc_id", "text").mapInArrow(_pieces(path, capacity, end, with_ids), cols), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    spots = spark.sparkContext.broadcast(places(patterns(counts, capacity)))
    ranked = running_sum(pieces.withColumn("chunk", F.shiftright("_row", 12)), ["length"], "chunk", ["_row", "piece"], F.lit(1), "rank")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "rank")
    return ranked.mapInArrow(_placer(spots), f"{cols.removeprefix('_row long, ')}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """From pieces with ids, a row per sequence: sequence_id, n_tokens, ids (a sequence has `capacity` ids at most)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select("sequence_id", "n_tokens", joined.alias("ids"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")
