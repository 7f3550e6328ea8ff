"""Token counts: pieces are counted once per distinct pre-token and joined to the documents' frequencies.

A pre-token is a run of spaces with what follows up to the next space or line end, or a line end
with what follows: no piece of the model crosses these places, so the pieces of a text are those of
its pre-tokens. Three steps, all distributed:

1. the pre-tokens of the corpus with their frequencies, summed over tasks, and the pieces of each,
   counted once per distinct pre-token;
2. each document's pre-token frequencies, joined in the worker to the counts of the HEAD most
   frequent pre-tokens of at most SHORT characters, which are broadcast, with the rest left as rows;
3. these rows, of rare or long keys, joined to the counts by shuffle and summed per document; adaptive
   execution splits a long key that many documents share.

Ids are never kept: of a pre-token only the number of its pieces leaves the tokenizer.

Defined results: a null text counts as empty and has 0 tokens; rows with the same id are rows of
their own; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import pick, small_batches, stage, table

HEAD, SHORT, FLUSH, LIMIT = 1 << 17, 64, 100_000, 4096
SPACE = "▁"  # the mark that stands for a space in pieces


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first space; one after a line end starts with the line end."""
    if not text:
        return []
    if SPACE in text:
        text = text.replace(SPACE, " ")
    flat = text.replace("\n", " \n")
    if "  " not in flat and text[0] != " ":  # the model puts a space before the text
        return flat.split(" ")
    return [x[1:] if x[0] == " " else x for x in re.findall(r" +[^ \n]*|\n[^ \n]*", " " + text)]


def load(path: str):
    """The model, after a check that its pieces stay within pre-tokens."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if "\n" in piece or re.search(f"[^{SPACE}]{SPACE}", piece):
            raise ValueError(f"a piece crosses pre-tokens: {piece!r}")
    return model


def piece_counts(model, keys: list[str]) -> list[int]:
    """Pieces of each pre-token. The model puts a space mark before each string it is given."""
    alone = len(model.encode("a ")) - len(model.encode("a"))
    found = model.encode(keys, num_threads=1) if keys else []
    return [alone if not k else len(x) - alone * (k[0] == "\n") for k, x in zip(keys, found, strict=True)]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out():
        batch = pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pretoken", "n"])
        seen.clear()
        return batch

    for batch in batches:
        for text in batch.column(0):
            seen.update(pretokens(text.as_py() or ""))
            if len(seen) > FLUSH:
                yield out()
    if seen:
        yield out()


def _piece_counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(piece_counts(model, keys), pa.int32())], ["pretoken", "n", "pieces"])

    return count


def _head_sums(head):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = head.value
        for batch in batches:
            known, keys, times, ends = [], [], [], [0]
            for text in batch.column(3):
                total = 0
                for key, n in Counter(pretokens(text.as_py() or "")).items():
                    p = pieces.get(key)
                    if p is None:
                        keys.append(key)
                        times.append(n)
                    else:
                        total += n * p
                known.append(total)
                ends.append(len(keys))
            rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(times, pa.int32())], ["pretoken", "times"]))
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(known, pa.int64()), rest], ["_row", "doc_id", "n_bytes", "known", "rest"])

    return sums


def dictionary(docs: DataFrame, path: str) -> DataFrame:
    """pretoken, n (its frequency in all texts), pieces."""
    found = small_batches(docs).select(F.col("text").cast("string")).mapInArrow(_frequencies, "pretoken string, n long")
    return stage(found.groupBy("pretoken").agg(F.sum("n").alias("n")).mapInArrow(_piece_counter(path), "pretoken string, n long, pieces int"), "pieces")


def _least_frequency(words: DataFrame, most: int) -> int:
    """The frequency that at most `most` pre-tokens reach, from a histogram in sixteenths of octaves."""
    octave = F.floor(F.log2("n") * 16)
    bins = words.groupBy(octave.alias("bin")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).collect()
    total, least = 0, 1 << 62
    for r in sorted(bins, key=lambda r: -r["bin"]):
        total += r["rows"]
        if total > most:
            break
        least = r["least"]
    return least


def token_counts(docs: DataFrame, path: str, head_size: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens per row of docs."""
    spark = docs.sparkSession
    words = dictionary(docs, path)
    short = words.filter(F.length("pretoken") <= SHORT)  # so that the broadcast is bounded in bytes too
    top = short.filter(F.col("n") >= _least_frequency(short, head_size)).select("pretoken", "pieces").toArrow()
    head = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))
    rows = pick(docs, "doc_id", "text").select("_row", "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stage(rows.mapInArrow(_head_sums(head), f"_row long, doc_id {kind}, n_bytes long, known long, rest array<struct<pretoken: string, times: int>>"), "frequencies")
    tail = rows.select("_row", F.explode("rest").alias("x")).select("_row", "x.pretoken", "x.times")
    sums = tail.join(words.select("pretoken", "pieces"), "pretoken").groupBy("_row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    return rows.drop("rest").join(sums, "_row", "left").select("doc_id", "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
