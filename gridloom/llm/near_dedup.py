"""Near-duplicates by MinHash with sequential Bayesian verification.

1. Each text's set of word shingles gives a digest, band keys of a MinHash signature, and a sketch
   (a byte of each signature value). Documents with equal sets are one class from here on.
2. Classes that share a band key are compared within that bucket, sketch batch by sketch batch: a
   pair is dropped as soon as the posterior chance that its similarity reaches the threshold is
   under MISS. Who survives is joined into loose groups, by a union-find in the bucket.
3. Each loose group gets its texts again, and its pairs that share a band and survive are confirmed
   on the full sets. Pairs that are connected already need no test, so a group of copies of one text
   costs about one test per copy, not one per pair, and no pair is ever a row.

The groups of steps 2 and 3 go to tasks of bounded size: one that is over the limit is dealt in
chunks, each of which gets the PIVOTS most central members too. What is not connected to the
largest part after that is dealt in chunks again, and each of these meets each of the first, two
chunks to a task. So nothing is capped, and no task has more than two chunks; a group that is
over the limit and mostly unlike costs as many tasks as it has pairs of chunks.

Defined results: texts without words, null ones too, are linked with nothing. Rows with the same id
are rows of their own in components(), while near_dedup() leaves one row of a component; rows with
a null id link like others, and are kept only where no id is in their component. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import groupby
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.arrays import ascii_lower, chunks, hash_words, mix, rolling
from gridloom.llm.common import masked, pick, small, split_join, stage, staged_alone, table
from gridloom.llm.components import connected_components

WIDTH = 5  # words in a shingle
#: Link from this percentage on: components() and op5, and near_dedup(), the stage of the pipeline.
SIMILARITY, STAGE_SIMILARITY = 85, 80
#: Values of a signature, and the chance under which a pair at the threshold shares no band.
HASHES, NO_BAND, BATCH, MISS = 150, 1e-5, 30, 1e-6
#: Members of a bucket, and shingles of a loose group, that one task takes.
MOST_MEMBERS, MOST_SHINGLES, PIVOTS = 4_000, 400_000, 16

_i = np.arange(1, HASHES + 1, dtype=np.uint64)
_FACTOR, _SHIFT = mix(_i).astype(np.uint32) | np.uint32(1), (mix(_i) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; shorter texts have one shingle of all words."""
    h, ends = hash_words([ascii_lower(t).split() for t in texts])
    runs, doc = rolling(h, ends, width)
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for i, n in enumerate(np.diff(ends)):
        if n >= width:
            out.append(np.unique(runs[at[i] : at[i + 1]]))
        else:
            out.append(rolling(h[ends[i] : ends[i + 1]], np.array([0, n]), int(n), salt=int(n) + 1)[0] if n else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A MinHash signature per set; sets must not be empty."""
    starts = np.cumsum([0] + [len(s) for s in sets])[:-1]
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(x * _FACTOR[k] + _SHIFT[k], starts)
    return out


def banding(similarity: int) -> tuple[int, int]:
    """Bands and the rows of each, the most that miss a pair at the threshold with a chance under NO_BAND: 25 of 6 at 85 %, 30 of 5 at 80 %."""
    for n in range(HASHES, 0, -1):
        if (1 - (similarity / 100) ** n) ** (HASHES // n) < NO_BAND:
            return HASHES // n, n
    raise ValueError(f"similarity is too low for {HASHES} hashes: {similarity}")


def band_keys(sig: np.ndarray, similarity: int = SIMILARITY) -> np.ndarray:
    n_bands, n_rows = banding(similarity)
    key = np.broadcast_to(np.arange(1, n_bands + 1, dtype=np.uint64), (len(sig), n_bands)).copy()
    rows = sig[:, : n_bands * n_rows].reshape(len(sig), n_bands, n_rows).astype(np.uint64)
    for k in range(n_rows):
        key = mix(key ^ rows[:, :, k]) + np.uint64(0x9E3779B97F4A7C15)
    return key.view(np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    return (sig * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)


def least_matches(n: int, similarity: float = SIMILARITY / 100, miss: float = MISS) -> int:
    """The fewest matches of n at which the posterior chance of at least this similarity (uniform prior) is not under miss.

    The posterior is Beta(m + 1, n - m + 1), and its upper tail at s is the chance of at most m
    successes in n + 1 trials at s.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def bounds(similarity: int) -> list[tuple[int, int]]:
    return [(n, least_matches(n, similarity / 100)) for n in range(BATCH, HASHES + 1, BATCH)]


_LEAST = bounds(SIMILARITY)


def survivors(one: np.ndarray, others: np.ndarray, bound: list[tuple[int, int]] = _LEAST) -> np.ndarray:
    """Which of others' sketches stay plausible partners of one, a batch of values at a time."""
    alive, matches = np.arange(len(others)), np.zeros(len(others), np.int64)
    for n, least in bound:
        matches = matches + (others[alive, n - BATCH : n] == one[n - BATCH : n]).sum(1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    return alive


def link(order: np.ndarray, labels: np.ndarray, partners: Callable[[int, np.ndarray], np.ndarray]) -> None:
    """Joins labels in place: each member of order in turn with those after it that are not connected to it yet."""
    for i, one in enumerate(order[:-1]):
        rest = order[i + 1 :]
        rest = rest[labels[rest] != labels[one]]
        if len(rest) and len(found := partners(one, rest)):
            joined = np.unique(np.append(labels[found], labels[one]))
            labels[np.isin(labels, joined)] = joined[0]


def link_sketches(nodes: np.ndarray, labels: np.ndarray, rows: list[dict], similarity: int = SIMILARITY) -> None:
    """Members of one bucket, by sketch; the most typical member first."""
    own = np.stack([np.frombuffer(r["sketch"], np.uint8) for r in rows])
    typical = np.zeros(len(own), np.int64)
    for k in range(own.shape[1]):
        typical += np.bincount(own[:, k], minlength=256)[own[:, k]]
    bound = bounds(similarity)
    link(np.argsort(-typical, kind="stable"), labels, lambda one, rest: rest[survivors(own[one], own[rest], bound)])


def link_texts(nodes: np.ndarray, labels: np.ndarray, rows: list[dict], similarity: int = SIMILARITY) -> None:
    """Members of one loose group, by full sets; pairs that share a band only, each in the first band they share."""
    sets = shingle_sets([r["text"] for r in rows])
    sig = signatures(sets)
    bands, own, size, bound = band_keys(sig, similarity), sketches(sig), np.array([len(s) for s in sets]), bounds(similarity)
    typical = np.zeros(len(rows), np.int64)
    buckets = []
    for k in range(bands.shape[1]):
        _, code, n = np.unique(bands[:, k], return_inverse=True, return_counts=True)
        typical += n[code]
        members = np.argsort(code, kind="stable")
        buckets.append([b for b in np.split(members, np.cumsum(n)[:-1]) if len(b) > 1])
    for k, found in enumerate(buckets):

        def partners(one, rest, k=k):
            first = (bands[rest, :k] != bands[one, :k]).all(1)
            close = 100 * np.minimum(size[rest], size[one]) >= similarity * np.maximum(size[rest], size[one])
            rest = rest[first & close]
            rest = rest[survivors(own[one], own[rest], bound)]
            if not len(rest):
                return rest
            flat = np.concatenate([sets[r] for r in rest])
            at = np.minimum(np.searchsorted(sets[one], flat), size[one] - 1)
            inter = np.add.reduceat((sets[one][at] == flat).astype(np.int64), np.cumsum([0, *size[rest]])[:-1])
            return rest[100 * inter >= similarity * (size[one] + size[rest] - inter)]

        for members in found:
            link(members[np.argsort(-typical[members], kind="stable")], labels, partners)


def _linker(method: Callable):
    """Runs a method on each run of rows with the same part; gives (node, root) for all members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        u, v = [], []
        for _, part in groupby(rows, key=lambda r: (r["part"], r["chunk"])):
            own = list({r["node"]: r for r in part}.values())
            nodes = np.array([r["node"] for r in own], np.int64)
            start, labels = np.unique(np.array([r["label"] for r in own], np.int64), return_inverse=True)
            if len(start) > 1:
                method(nodes, labels, own)
            for joined in np.unique(labels):
                mine = nodes[labels == joined]
                u += mine.tolist()
                v += [int(mine.min())] * len(mine)
            if len(u) > 50_000:
                yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
                u, v = [], []
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _run(members: DataFrame, method: Callable) -> DataFrame:
    """members: part, chunk, node, label, and what the method needs."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.repartition(n, "part", "chunk").sortWithinPartitions("part", "chunk")
    return dealt.mapInArrow(_linker(method), "u long, v long").filter("u != v")


def linked(members: DataFrame, method: Callable, most: int) -> DataFrame:
    """Edges (u, v) that connect what the method links. members: part, node, weight, central, and what the method needs.

    A part of a total weight over `most` is dealt in chunks. First each chunk is run with the
    part's pivots; then the members outside the part's largest component so far, dealt in chunks
    too, with every chunk of the part.
    """
    members = members.withColumn("label", F.col("node"))
    sizes = members.groupBy("part").agg(F.sum("weight").alias("size"))
    hot = stage(sizes.filter(F.col("size") > most).select("part", F.ceil(F.col("size") / most).cast("int").alias("n_chunks")), "hot")
    if hot.isEmpty():
        return _run(members.withColumn("chunk", F.lit(0).cast("long")), method)
    hot = small(hot, 100_000)
    plain = members.join(hot, "part", "left_anti").withColumn("chunk", F.lit(0).cast("long"))
    dealt = stage(members.join(hot, "part").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("n_chunks"))), "dealt")

    def top(rows: DataFrame, group: list[str]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("central"), "node"))
        return rows.withColumn("rank", rank).filter(F.col("rank") <= PIVOTS).drop("rank")

    # The most central of a part are among the most central of its chunks.
    pivots = stage(top(top(dealt.select("part", "chunk", "node", "central"), ["part", "chunk"]), ["part"]).select("part", "node"), "pivots")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - F.lit(1).cast("long")))
    copies = dealt.drop("chunk").join(small(pivots, 100_000), ["part", "node"], "left_semi").withColumn("chunk", every)
    edges = stage(_run(dealt.unionByName(copies).drop("n_chunks"), method), "edges")
    roots = stage(connected_components(edges).withColumnRenamed("root", "label"), "roots")
    now = stage(dealt.drop("label").join(roots, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    parts = now.groupBy("part", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("size"))
    parts = parts.groupBy("part").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("size").alias("all"), F.max_by("size", F.struct("n", "label")).alias("size"))
    parts = parts.select("part", "main", F.ceil((F.col("all") - F.col("size")) / most).cast("long").alias("n_loose")).filter("n_loose > 0")
    now = now.join(small(stage(parts, "parts"), 100_000), "part")
    # Task (i, k): chunk i of what is loose, and chunk k of all.
    loose = now.filter(F.col("label") != F.col("main")).withColumn("i", F.pmod(F.xxhash64("node", F.lit(1)), F.col("n_loose")))
    loose = loose.withColumn("k", every).select(*dealt.columns, (F.col("i") * F.col("n_chunks") + F.col("k")).alias("task"))
    others = now.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_loose") - F.lit(1).cast("long"))))
    others = others.select(*dealt.columns, (F.col("i") * F.col("n_chunks") + F.col("chunk")).alias("task"))
    again = loose.unionByName(others).drop("n_chunks", "chunk").withColumnRenamed("task", "chunk")
    return _run(plain, method).unionByName(edges).unionByName(_run(again, method))


def _features(similarity: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            sets = shingle_sets(texts)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            sketch: list = [None] * len(sets)
            if full:
                sig = signatures([sets[i] for i in full])
                for i, b, s in zip(full, band_keys(sig, similarity), sketches(sig), strict=True):
                    bands[i], sketch[i] = b, s.tobytes()
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.record_batch(
                [*(part.column(n) for n in ("_row", "doc_id", "text_hash")), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["_row", "doc_id", "text_hash", "n_shingles", "digest", "bands", "sketch"],
            )

    return run


def _text_hash(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def components(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept, root per row of docs; links from similarity in percent on.

    root is a number of the component, null for texts without words.
    """
    by_sketch, by_text = partial(link_sketches, similarity=similarity), partial(link_texts, similarity=similarity)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = pick(docs, "doc_id", "text").select("_row", "doc_id", _text_hash(F.col("text")).alias("text_hash"), "text")
    rows = stage(rows.mapInArrow(_features(similarity), f"_row long, doc_id {kind}, text_hash long, n_shingles long, digest binary, bands array<long>, sketch binary"), "features")
    classes = stage(rows.filter("n_shingles > 0").groupBy("digest").agg(F.min("_row").alias("node"), F.min("doc_id").alias("class_id")), "classes")
    reps = rows.join(classes.select(F.col("node").alias("_row")), "_row", "left_semi").withColumnRenamed("_row", "node")
    # Step 2: band keys that several classes share, with the members' sketches.
    keys = reps.select("node", F.explode("bands").alias("part"))
    shared = keys.groupBy("part").agg(F.count("*").alias("n")).filter("n > 1")
    pairs = stage(keys.join(shared, "part"), "pairs")
    central = pairs.groupBy("node").agg(F.sum("n").alias("central"))  # how many share its bands
    members = pairs.drop("n").join(reps.select("node", "sketch").join(central, "node"), "node").withColumn("weight", F.lit(1))
    loose = connected_components(linked(stage(members, "members"), by_sketch, MOST_MEMBERS))
    loose = stage(loose.join(reps.select("node", "doc_id", "text_hash", "n_shingles"), "node").join(central, "node"), "loose")
    # Step 3: the texts of loose groups, found again by id and hash.
    texts = docs.select(docs["doc_id"].alias("_id"), docs["text"].cast("string").alias("text")).withColumn("_hash", _text_hash(F.col("text")))
    same = loose["doc_id"].eqNullSafe(texts["_id"]) & (loose["text_hash"] == texts["_hash"])
    groups = texts.join(small(loose, 200_000), same).select(F.col("root").alias("part"), "node", F.col("n_shingles").alias("weight"), "central", "text")
    edges = stage(linked(groups, by_text, MOST_SHINGLES), "links")
    roots = connected_components(edges)
    named = stage(classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    least = stage(named.groupBy("root").agg(F.min("class_id").alias("component_id")), "least")
    named = stage(split_join(named.select("digest", "root"), least, "root"), "ids")
    rows = rows.drop("bands", "sketch")
    alone = rows.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("root", F.lit(None).cast("long"))
    out = ["doc_id", "text_hash", "n_shingles", "component_id", "root"]
    every = alone.select(*out).unionByName(split_join(rows.filter("n_shingles > 0"), named, "digest").select(*out))
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, similarity: int = STAGE_SIMILARITY) -> DataFrame:
    """The rows of docs that are kept, one of each component, with all columns.

    Where rows repeat the id that is kept, the one with the least hash of its text stays.
    """
    found = staged_alone(lambda: components(docs, similarity), "components")
    full = found.filter("root IS NOT NULL")
    kept = full.filter("kept").groupBy("root").agg(F.min("text_hash").alias("_first"), F.count("*").alias("_n"))
    # Only a repeated id leaves more than one row to a component.
    again = stage(kept.filter("_n > 1").select("root", "_first"), "again")
    gone, twice = full.filter(~F.col("kept")), None
    if not again.isEmpty():
        known = full.filter("kept").join(small(again, 200_000), "root")
        gone = gone.select("doc_id", "text_hash").unionByName(known.filter("text_hash != _first").select("doc_id", "text_hash"))
        twice = known.filter("text_hash = _first").select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct()
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash"))
    own, at, back = masked(docs)
    marked = own.withColumn("_hash", _text_hash(F.col(at["text"]).cast("string")))
    same = F.col(at["doc_id"]).eqNullSafe(F.col("_gone_id")) & (F.col("_hash") == F.col("_gone_hash"))
    left = marked.join(small(stage(gone, "gone"), 200_000), same, "left_anti")
    if twice is None:
        return left.select(*back)
    twice = small(stage(twice, "twice"), 200_000)
    one = left.join(twice, same, "left_semi").dropDuplicates([at["doc_id"], "_hash"])
    return left.join(twice, same, "left_anti").unionByName(one).select(*back)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), SIMILARITY).drop("text_hash", "root")
