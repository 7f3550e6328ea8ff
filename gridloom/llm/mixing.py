"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled (by md5 of the id) into one line of words and cut into blocks
of equal length. Slot i of the schedule is the golden-ratio point frac((i + 1/2) * phi), mapped
through the cumulative targets to a source; the slots of a source are ranked, and rank r takes
block r mod n of the source's n blocks, in epoch r div n. Nothing is drawn at random, so reruns agree.
Where the limit of slots makes blocks longer, sources of few blocks are not left to the slots: the words
of their line are taken up to the target, and their places are spread evenly over the schedule.

All ranks and running sums are in two levels (chunks, then within a chunk), so that a source with
a third of all rows is no single task.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of
its own, the last one; rows with the same id are rows of their own; an empty table gives an empty
result. Sources without words have target 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, masked, pick, running_sum, small, stage, table, words

WEIGHTS = (5, 2, 1)
SHARE, MAX_EPOCHS = 1.5, 2
#: Slots for the source with the smallest target, and slots at most: the error of a source's
#: taken words is a few blocks, and a block is the total divided by the slots.
SLOTS_LEAST, SLOTS_MOST = 4096, 1 << 22
PHI = 0.6180339887498949
CELLS, CHUNK = 4096, 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS) -> DataFrame:
    """source, source_id, n_docs, source_size, target; one row per source.

    Targets fill up like water: in the order of limit by weight, sources at their limit come first,
    and the rest share what is left by weight.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("source_id") - 1) % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", "source_id")
    every = Window.partitionBy()
    sources = (
        sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
        .withColumn("source_id", F.row_number().over(order))
        .withColumn("weight", w)
        .withColumn("most", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("rank", F.row_number().over(by_ratio))
        .withColumn("left", F.sum("source_size").over(every) * F.lit(float(share)) - (F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most")))
        .withColumn("level", F.col("left") / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("turn", F.min(F.when(F.col("ratio") >= F.col("level"), F.col("rank"))).over(every))
        .withColumn("at", F.max(F.when(F.col("rank") == F.col("turn"), F.col("level"))).over(every))
    )
    target = F.when(F.col("rank") < F.col("turn"), F.col("most").cast("double")).otherwise(F.col("at") * F.col("weight"))
    return sources.select("source", "source_id", "n_docs", "source_size", F.coalesce(target, F.col("most").cast("double")).alias("target"))


def schedule(sources: DataFrame, n_slots: int, total: float) -> DataFrame:
    """slot, source_id, rank: each slot's source, and the number of that source's slots before it."""
    spark = sources.sparkSession
    # The sum of the targets before a source, in the order of source_id.
    cum = Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, 0)
    spans = (
        sources.filter("target > 0").withColumn("hi", F.sum("target").over(cum) / F.lit(total)).withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("source_id")), F.lit(0.0)))
        .withColumn("hi", F.when(F.row_number().over(Window.orderBy(F.desc("source_id"))) == 1, F.lit(2.0)).otherwise(F.col("hi")))
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
        .select("source_id", "lo", "hi", "cell")
    )
    x = (F.col("slot") + F.lit(0.5)) * F.lit(PHI)
    slots = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("u", x - F.floor(x)).withColumn("cell", F.floor(F.col("u") * CELLS))
    placed = slots.join(spans, "cell").filter("u >= lo AND u < hi").select("slot", "source_id", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    return running_sum(placed, ["source_id"], "chunk", ["slot"], F.lit(1), "rank").select("slot", "source_id", "rank")


def _text_hash(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS) -> tuple[DataFrame, DataFrame]:
    """The documents with their size and their source's target, and what the mix takes of them.

    First: _row, doc_id, source, text_hash, size, source_size, target. Second: _row, slot, epoch, first and
    n_words, a range of the document's words per slot.
    """
    spark = docs.sparkSession
    sizes = stage(pick(docs, "doc_id", "source", "text").select("_row", "doc_id", "source", _text_hash(F.col("text")).alias("text_hash"), F.coalesce(F.size(words(F.col("text"))), F.lit(0)).cast("long").alias("size")), "sizes")
    sources = stage(source_targets(sizes, weights, share, max_epochs), "sources")
    total, least = sources.agg(F.sum("target"), F.min(F.when(F.col("target") > 0, F.col("target")))).first()
    total = total or 0.0
    wanted = -(-total * SLOTS_LEAST // least) if least else 0
    n = min(SLOTS_MOST, wanted)
    block = max(1, -int(-total // n)) if n else 1
    # The least target that slots serve, if the limit has made blocks longer than that source asks for.
    least_by_slots = SLOTS_LEAST * block if n and block > max(1, -int(-total // wanted)) else 0
    n_slots = -int(-total // block)
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")
    lined = (
        sizes.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("key", key).withColumn("chunk", F.floor(F.col("key") / F.lit(float(1 << 48)) * F.ceil(F.col("n_docs") / CHUNK)))
    )
    lined = running_sum(lined, ["source_id"], "chunk", ["key", "doc_id", "size", "_row"], F.col("size"), "start")
    lined = stage(lined.select("_row", "doc_id", "source", "text_hash", "size", "source_size", "target", "source_id", "start"), "lines")
    pieces = (
        lined.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
        .withColumn("from", F.greatest(F.col("start"), F.col("block") * block))
        .withColumn("n_words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.col("from"))
        .select("_row", "source_id", "block", "from", (F.col("from") - F.col("start")).alias("first"), "n_words")
    )
    n_blocks = F.ceil(F.col("source_size") / block)
    turns = (
        schedule(sources, n_slots, total).join(sources.filter(F.col("target") >= least_by_slots).select("source_id", "source_size"), "source_id")
        .withColumn("epoch", F.floor(F.col("rank") / n_blocks)).filter(F.col("epoch") < max_epochs)
        .select("source_id", "slot", "epoch", (F.col("rank") - F.col("epoch") * n_blocks).alias("block"))
    )
    taken = pieces.join(turns, ["source_id", "block"]).select("_row", "slot", "epoch", "first", "n_words")
    if least_by_slots:
        few = sources.filter((F.col("target") > 0) & (F.col("target") < least_by_slots)).select("source_id", "source_size", "target")
        taken = taken.unionByName(_up_to_target(pieces.join(few, "source_id"), n_slots, max_epochs))
    return lined.drop("source_id", "start"), taken


def _up_to_target(pieces: DataFrame, n_slots: int, max_epochs: int) -> DataFrame:
    """_row, slot, epoch, first, n_words: what the first words of each source's line, as many as its target, take of pieces."""
    at = F.col("epoch") * F.col("source_size") + F.col("from")
    left = F.round("target").cast("long") - F.col("at")
    return (
        pieces.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max_epochs - 1).cast("long")))).withColumn("at", at)
        .withColumn("n_words", F.least("n_words", left)).filter("n_words > 0")
        .select("_row", F.floor(F.col("at") / F.col("target") * n_slots).alias("slot"), "epoch", "first", "n_words")
    )


def first_words(text, first, n):
    """n words of text after the first so many, with the white space between them as it is."""
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    gaps = F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]+"), F.lit(0)), (first + lead + 1).cast("int"), (n - 1).cast("int"))
    own = F.slice(words(text), (first + 1).cast("int"), n.cast("int"))
    return F.array_join(F.zip_with(own, gaps, lambda word, gap: F.concat(word, F.coalesce(gap, F.lit("")))), "")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS) -> DataFrame:
    """docs as the mix takes them: a row per document and epoch, with all columns of docs.

    A document of which an epoch takes a part only, at the end of a source's line of blocks, has
    those words, and the white space between them; its other columns stay. Where rows are alike in
    id, source and text, each that is taken has the other columns of one of them.
    """
    sized, taken = mix(docs, weights, share, max_epochs)
    parts = taken.groupBy("_row", "epoch").agg(F.min("first").alias("_first"), F.sum("n_words").alias("_n"))
    parts = sized.join(parts, "_row").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_of"), F.col("size").alias("_size"), "_first", "_n")
    own, at, back = masked(docs)
    text = F.col(at["text"]).cast("string")
    marked = own.withColumn("_hash", _text_hash(text))
    alike = sized.filter("size > 0").groupBy("doc_id", "source", "text_hash").agg(F.count("*").alias("n")).filter("n > 1")
    alike = stage(alike.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_of")), "alike")
    same = F.col(at["doc_id"]).eqNullSafe(F.col("_id")) & F.col(at["source"]).cast("string").eqNullSafe(F.col("_source")) & (F.col("_hash") == F.col("_of"))
    if not alike.isEmpty():
        alike = small(alike, 200_000)
        one = marked.join(alike, same, "left_semi").dropDuplicates([at["doc_id"], at["source"], "_hash"])
        marked = marked.join(alike, same, "left_anti").unionByName(one)
    cut = F.when(F.col("_n") == F.col("_size"), text).otherwise(first_words(text, F.col("_first"), F.col("_n")))
    return marked.join(parts, same).withColumn(at["text"], cut).select(*back)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, taken = mix(table(spark, sf_dir, "documents"))
    sums = taken.groupBy("_row").agg(F.sum("n_words").alias("taken"))
    return sized.join(sums, "_row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def op10_sql(slots_least: int = SLOTS_LEAST, slots_most: int = SLOTS_MOST) -> str:
    return rf"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_id FROM s0),
s2 AS (SELECT *, CASE (source_id - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2 AS most FROM s1),
s3 AS (SELECT *, CAST(most AS DOUBLE) / weight AS ratio FROM s2),
s4 AS (SELECT *, row_number() OVER (ORDER BY ratio, source_id) AS rank,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5e0
           - CAST(sum(most) OVER (ORDER BY ratio, source_id ROWS UNBOUNDED PRECEDING) - most AS DOUBLE) AS remaining,
         sum(weight) OVER (ORDER BY ratio, source_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s3),
s5 AS (SELECT *, remaining / CAST(rest AS DOUBLE) AS level FROM s4),
s6 AS (SELECT *, min(CASE WHEN ratio >= level THEN rank END) OVER () AS turn FROM s5),
s7 AS (SELECT *, max(CASE WHEN rank = turn THEN level END) OVER () AS lev FROM s6),
sources AS (SELECT source, source_id, source_size,
         CASE WHEN rank < turn THEN CAST(most AS DOUBLE) ELSE lev * weight END AS target FROM s7),
plan AS (SELECT sum(target) AS total, min(CASE WHEN target > 0 THEN target END) AS least FROM sources),
plan1 AS (SELECT total, ceil(total * {slots_least} / least) AS wanted FROM plan),
plan2 AS (SELECT total, block, CASE WHEN block > greatest(1, ceil(total / wanted)) THEN {slots_least} * block ELSE 0 END AS least_by_slots
          FROM (SELECT total, wanted, CAST(greatest(1, ceil(total / least({slots_most}, wanted))) AS BIGINT) AS block FROM plan1)),
spans AS (SELECT source_id, source_size, hi, coalesce(lag(hi) OVER (ORDER BY source_id), 0) AS lo FROM (
         SELECT source_id, source_size, CASE WHEN row_number() OVER (ORDER BY source_id DESC) = 1 THEN 2e0
           ELSE sum(target) OVER (ORDER BY source_id ROWS UNBOUNDED PRECEDING) / total END AS hi
         FROM sources, plan2 WHERE target > 0)),
slots AS (SELECT ((r.i + 0.5e0) * {PHI}e0) - floor((r.i + 0.5e0) * {PHI}e0) AS u
          FROM plan2, LATERAL (SELECT unnest(range(CAST(ceil(total / block) AS BIGINT))) AS i) r),
turns AS (SELECT source_id, any_value(source_size) AS source_size, count(*) AS n FROM slots JOIN spans ON u >= lo AND u < hi GROUP BY source_id),
ends AS (SELECT t.source_id, block, CAST(ceil(CAST(t.source_size AS DOUBLE) / block) AS BIGINT) AS nb, least(n, 2 * CAST(ceil(CAST(t.source_size AS DOUBLE) / block) AS BIGINT)) AS n FROM turns t, plan2),
docs AS (SELECT d.doc_id, d.size, s.source_size, s.target, s.source_id,
         CAST(sum(d.size) OVER (PARTITION BY s.source_id ORDER BY ('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 12))::BIGINT, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS first
         FROM sizes d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, d.source_size, target, CASE WHEN target < (SELECT least_by_slots FROM plan2)
       THEN CAST(greatest(0, least(size, round(target) - first)) + greatest(0, least(size, round(target) - d.source_size - first)) AS BIGINT)
       ELSE CAST(coalesce((n // nb) * size + greatest(0, least(first + size, (n % nb) * block) - first), 0) AS BIGINT) END AS taken
FROM docs d LEFT JOIN ends e ON d.source_id = e.source_id
"""


OP10_SQL = op10_sql()
