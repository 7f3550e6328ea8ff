"""Exact deduplication with a persistent digest index.

The index is a Parquet table, bucketed and sorted by the SHA-256 of the text, at a path that
outlives the session. A batch is reduced to one row per digest, kept against the index by a
sort-merge anti-join whose index side needs no shuffle, and the new digests are appended.

Beside the data lie the bucket count and id type, which a reopened index takes over, and a note per
finished batch. Rows are read only if their batch has such a note, so what a failed attempt has
left counts for nothing, and the batch can be added again under the same name.

Defined results: a null text counts as empty. Of equal texts within a batch the row with the
largest doc_id stays; rows with a null doc_id stay only where no equal row has one; of rows equal
in doc_id too exactly one stays. A text that an earlier batch has brought is dropped, and keep_id
names the row of that batch. A batch that is added again under its name leaves the index as it is and
gives the same result again. An empty table gives an empty result and adds no digest. Reopening an index with another id type raises a ValueError.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import delete, masked, new_path, pick, small, stage, staged_alone, table

#: A digest with this share of a batch is joined by broadcast, so at most 10,000 digests are.
HOT_SHARE, HOT_LEAST = 10_000, 100


def digest(text):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class _Notes:
    """Small JSON files in a folder beside the data, which Parquet readers pass over."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.root = f"{path}/_notes"
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> dict | None:
        """The note, or None if there is none or it was cut off."""
        if not self.fs.exists(self._at(name)):
            return None
        stream = self.fs.open(self._at(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def write(self, name: str, note: dict) -> None:
        stream = self.fs.create(self._at(name), True)
        try:
            stream.write(bytearray(json.dumps(note).encode()))
        finally:
            stream.close()

    def names(self, prefix: str) -> list[str]:
        found = self.fs.listStatus(self._at("")) if self.fs.exists(self._at("")) else []
        return [n for f in found if (n := f.getPath().getName()).startswith(prefix)]


class DigestIndex:
    """digest -> (keep_id, n_rows, attempt), in buckets sorted by digest; one writer at a time.

    `buckets` holds for a new index; one that is there keeps its own.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: T.DataType = T.LongType(), buckets: int = 64):
        self.spark, self.path, self.notes = spark, path, _Notes(spark, path)
        made = self.notes.read("index")
        if made is None:
            made = {"buckets": buckets, "id_type": id_type.simpleString()}
            self.notes.write("index", made)
        if made["id_type"] != id_type.simpleString():
            raise ValueError(f"the index at {path} has ids of type {made['id_type']}, not {id_type.simpleString()}")
        self.buckets = made["buckets"]
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id {made['id_type']}, n_rows BIGINT, attempt STRING) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}/data'"
        )

    def close(self, forget: bool = False) -> None:
        """Takes the table out of the catalog, and with forget deletes the index too."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if forget:
            delete(self.spark, self.path)

    def table(self) -> DataFrame:
        """The rows of all finished batches."""
        done = [note["attempt"] for name in self.notes.names("batch-") if (note := self.notes.read(name))]
        return self.spark.table(self.name).filter(F.col("attempt").isin(done) if done else F.lit(False))

    def add(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Adds a batch with the columns doc_id and text, under a name by which it can be tried again.

        Returns a row per document: doc_id, digest, keep_id, n_rows (equal rows of this batch, or
        of the batch that the text came with), kept.
        """
        note = "batch-" + (uuid.uuid4().hex if batch is None else batch.encode().hex())
        rows = stage(pick(docs, "doc_id", "text").select("_row", "doc_id", digest(F.col("text")).alias("digest")), "digests")
        groups = rows.groupBy("digest").agg(
            F.max("doc_id").alias("keep_id"),
            F.coalesce(F.max_by("_row", "doc_id"), F.max("_row")).alias("stays"),
            F.count("*").alias("n_rows"),
        )
        # Staged, else the optimizer moves the anti-join below the sums, where a large group is one task.
        groups = stage(groups, "groups")
        done = self.notes.read(note)
        if done is None:
            done = {"attempt": uuid.uuid4().hex}
            self._append(groups, done["attempt"])
            self.notes.write(note, done)
        return self._decide(rows, groups, done["attempt"])

    def _append(self, groups: DataFrame, attempt: str) -> None:
        new = groups.join(self.table().hint("merge"), "digest", "left_anti").select("digest", "keep_id", "n_rows", F.lit(attempt).alias("attempt"))
        new.repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def _decide(self, rows: DataFrame, groups: DataFrame, attempt: str) -> DataFrame:
        """Joins the rows to the index's row of their digest; hot digests apart, so that no task gets a large group."""
        own = groups.select("digest", "stays", F.col("n_rows").alias("_n"))
        known = stage(own.join(self.table().hint("merge"), "digest"), "known")
        hot_rows = max(HOT_LEAST, rows.count() // HOT_SHARE)
        hot, rest = F.col("_n") >= hot_rows, F.col("_n") < hot_rows
        first = rows.join(F.broadcast(known.filter(hot)), "digest")
        others = rows.join(F.broadcast(known.filter(hot).select("digest")), "digest", "left_anti").join(known.filter(rest), "digest")
        kept = (F.col("attempt") == attempt) & (F.col("_row") == F.col("stays"))
        return first.unionByName(others).select("doc_id", "digest", "keep_id", "n_rows", kept.alias("kept"))


def decided(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """What add() returns, written; with no index given, against one that is deleted afterwards."""
    if index:
        return staged_alone(lambda: index.add(docs), "decided")
    spark = docs.sparkSession
    own = DigestIndex(spark, new_path(spark, "digest-index"), docs.schema["doc_id"].dataType, int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        return staged_alone(lambda: own.add(docs), "decided")
    finally:
        own.close(forget=True)


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns; extra columns pass through."""
    keys = decided(docs, index).groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    keys = stage(keys.select(F.col("doc_id").alias("_key_id"), F.col("digest").alias("_key_digest"), "kept", "n"), "keys")
    own, at, back = masked(docs)
    marked = own.withColumn("_digest", digest(F.col(at["text"]).cast("string")))
    same = F.col(at["doc_id"]).eqNullSafe(F.col("_key_id")) & (F.col("_digest") == F.col("_key_digest"))
    # What goes is less than what stays: the texts themselves move only if it is too much to broadcast.
    left = marked.join(small(keys.filter(~F.col("kept")), 200_000), same, "left_anti")
    twice = keys.filter("kept AND n > 1")
    if twice.isEmpty():
        return left.select(*back)
    twice = small(twice, 200_000)
    one = marked.join(twice, same, "left_semi").dropDuplicates([at["doc_id"], "_digest"])
    return left.join(twice, same, "left_anti").unionByName(one).select(*back)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", F.col("n_rows").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP8_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
