"""Clustering of vector columns and the quality of clusterings."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans, PowerIterationClustering
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.vectors import doubles, standardise
from gridloom.operators.aggregates import center_separation, size_balance
from gridloom.session import small, written

BLOCK = 2048


def _squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


@dataclass
class ClusterModel:
    """Cluster centres of scaled vectors, with the scaler: what new vectors need to find their cluster."""

    mean: list[float]
    std: list[float]
    centers: list[list[float]]
    counts: list[float] = field(default_factory=list)

    def assign(self, df: DataFrame, v: str, out: str = "cluster") -> DataFrame:
        """df with the nearest centre of each vector; ties go to the lowest."""
        lit = lambda xs: F.array(*[F.lit(float(x)) for x in xs])  # noqa: E731  a number per dimension, or per centre and dimension
        scaled = F.zip_with(doubles(F.col(v)), F.arrays_zip(lit(self.mean).alias("m"), lit(self.std).alias("s")), lambda x, f: (x - f["m"]) / f["s"])
        listed = F.array(*[F.struct(F.lit(c).alias("c"), lit(x).alias("center")) for c, x in enumerate(self.centers)])
        near = F.array_min(F.transform(listed, lambda t: F.struct(_squared(F.col("_z"), t["center"]).alias("d"), t["c"].alias("c"))))["c"]
        return df.withColumn("_z", scaled).withColumn(out, near).drop("_z")

    def partial_fit(self, batch: DataFrame, v: str) -> ClusterModel:
        """The model after one more mini-batch: each centre moves to the mean of all vectors it has been given.

        One aggregate over the batch; a number per centre and dimension comes to the driver.
        """
        dims = self.assign(batch, v, "_c").select("_c", F.posexplode(doubles(F.col(v))).alias("pos", "x"))
        counts, centers = list(self.counts) or [0.0] * len(self.centers), list(self.centers)
        found: dict[int, dict[int, tuple[int, float]]] = {}
        for r in dims.groupBy("_c", "pos").agg(F.count("*").alias("n"), F.sum("x").alias("s")).collect():
            found.setdefault(r["_c"], {})[r["pos"]] = (r["n"], r["s"])
        for c, sums in found.items():
            n, more = counts[c], sums[0][0]
            centers[c] = [(x * n + (sums[d][1] - more * self.mean[d]) / self.std[d]) / (n + more) for d, x in enumerate(centers[c])]
            counts[c] = n + more
        return ClusterModel(self.mean, self.std, centers, counts)

    def save(self, spark, path: str) -> None:
        text = json.dumps({"mean": self.mean, "std": self.std, "centers": self.centers, "counts": self.counts})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark, path: str) -> ClusterModel:
        return ClusterModel(**json.loads(spark.read.text(path).first()[0]))


def scaler(df: DataFrame, v: str) -> tuple[list[float], list[float]]:
    """Mean and population deviation of each dimension, 1 for constant ones."""
    dims = df.select(F.posexplode(doubles(F.col(v)))).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).orderBy("pos").collect()
    return [r["m"] for r in dims], [r["s"] if r["s"] > 0 else 1.0 for r in dims]


def kmeans_model(df: DataFrame, v: str, k: int, seed: int = 42, restarts: int = 1, scale: bool = True, max_iter: int = 50) -> ClusterModel:
    """The model of k-means on standardised vectors; of several restarts the one of least cost."""
    mean, std = scaler(df, v)
    if not scale:
        mean, std = [0.0] * len(mean), [1.0] * len(std)
    rows = standardise(df, v, "_z") if scale else df.withColumn("_z", doubles(F.col(v)))
    rows = rows.select(array_to_vector("_z").alias("_f")).persist()
    fits = [KMeans(k=k, seed=seed + r, featuresCol="_f", maxIter=max_iter).fit(rows) for r in range(restarts)]
    rows.unpersist()
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return ClusterModel(mean, std, [c.tolist() for c in best.clusterCenters()], [float(n) for n in best.summary.clusterSizes])


def kmeans(df: DataFrame, v: str, k: int, seed: int = 42, restarts: int = 1, scale: bool = True, out: str = "cluster", max_iter: int = 50) -> DataFrame:
    """df with its cluster by kmeans_model()."""
    return kmeans_model(df, v, k, seed, restarts, scale, max_iter).assign(df, v, out)


def minibatch_kmeans(df: DataFrame, v: str, k: int, batches: int = 10, key: str = "id", scale: bool = True, start: ClusterModel | None = None) -> ClusterModel:
    """One pass of mini-batches (key modulo batches, written apart once), from the k vectors of lowest key.

    Each batch is a distributed aggregate, and only the centres go from batch to batch;
    gridloom.streaming.batches.cluster_stream() does the same with arriving data.
    """
    if start is None:
        mean, std = scaler(df, v)
        if not scale:
            mean, std = [0.0] * len(mean), [1.0] * len(std)
        first = [r[0] for r in df.orderBy(key).limit(k).select(doubles(F.col(v))).collect()]
        start = ClusterModel(mean, std, [[(x - m) / s for x, m, s in zip(c, mean, std, strict=True)] for c in first], [0.0] * len(first))
    dealt = written(df.select(F.col(v).alias("_v"), F.pmod(F.col(key), F.lit(batches)).cast("int").alias("_batch")).repartition("_batch"), "batches")
    for b in range(batches):
        start = start.partial_fit(dealt.filter(F.col("_batch") == b), "_v")
    return start


def lloyd(df: DataFrame, v: str, k: int, rounds: int = 1, key: str = "id", out: str = "cluster") -> DataFrame:
    """df with its cluster after so many rounds of Lloyd's algorithm from the k rows of lowest key.

    Without randomness: ties go to the lowest cluster, and a cluster that is left empty is dropped.
    """
    rows = df.withColumn("_v", doubles(F.col(v)))
    seeds = rows.orderBy(key).limit(k).select((F.row_number().over(Window.orderBy(key)) - 1).alias("c"), F.col("_v").alias("center"))
    for step in range(rounds + 1):
        listed = F.broadcast(seeds.agg(F.array_sort(F.collect_list(F.struct("c", "center"))).alias("_centers")))  # k vectors
        near = F.array_min(F.transform("_centers", lambda s: F.struct(_squared(F.col("_v"), s["center"]).alias("d"), s["c"].alias("c"))))["c"]
        assigned = rows.crossJoin(listed).withColumn(out, near).drop("_centers")
        if step < rounds:
            dims = assigned.select(out, F.posexplode("_v")).groupBy(out, "pos").agg(F.avg("col").alias("m"))
            seeds = dims.groupBy(F.col(out).alias("c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("center"))
    return assigned.drop("_v")


def bisecting(df: DataFrame, v: str, k: int, seed: int = 42, scale: bool = True, out: str = "cluster") -> DataFrame:
    """df with its cluster by splitting clusters in two until there are k: a hierarchy from the top.

    Standardised vectors are moved off the origin: the library parts a cluster by stretching its
    centre, which does nothing to a centre of zeros.
    """
    rows = standardise(df, v, "_z") if scale else df.withColumn("_z", doubles(F.col(v)))
    rows = rows.withColumn("_f", array_to_vector(F.transform("_z", lambda x: x + 1) if scale else F.col("_z")))
    return BisectingKMeans(k=k, seed=seed, featuresCol="_f", predictionCol=out).fit(rows).transform(rows).drop("_f", "_z")


def spectral(edges: DataFrame, k: int, rounds: int = 20, start: str = "random") -> DataFrame:
    """id, cluster of a graph's nodes (i, j, w) by power iteration; each pair counts once, with the mean of its weights."""
    once = edges.select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst"), "w").groupBy("src", "dst").agg(F.avg("w").alias("weight"))
    found = PowerIterationClustering(k=k, maxIter=rounds, initMode=start, weightCol="weight").assignClusters(once)
    return found.select("id", F.col("cluster").cast("int").alias("cluster"))


def compare_labelings(df: DataFrame, key: str, v: str, old: str, new: str) -> DataFrame:
    """One row: ari and nmi of two labelings of the same points, and the new one's gain in each quality figure."""
    from gridloom.operators.agreement import agreement

    figures = ("silhouette", "calinski_harabasz", "davies_bouldin")
    a, b = (quality(df, key, v, c).select(*[F.col(f).alias(f"{c}_{f}") for f in figures]) for c in (old, new))
    both = agreement(df, old, new).select("ari", "nmi").crossJoin(a).crossJoin(b)  # one row each
    return both.select("ari", "nmi", *[(F.col(f"{new}_{f}") - F.col(f"{old}_{f}")).alias(f"{f}_gain") for f in figures])


def _to(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of points by centres, without an array of points by centres by dimensions."""
    return np.stack([((x - c) ** 2).sum(1) for c in centers], 1)


def _numpy_kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 50) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[[rng.integers(len(x))]]
    while len(centers) < k:  # k-means++
        d = np.minimum(d, _to(x, centers[-1:])[:, 0]) if len(centers) > 1 else _to(x, centers)[:, 0]
        centers = np.vstack([centers, x[rng.choice(len(x), p=d / d.sum()) if d.sum() else rng.integers(len(x))]])
    labels = np.zeros(len(x), int)
    for _ in range(rounds):
        new = _to(x, centers).argmin(1)
        if (new == labels).all() and _:
            break
        labels = new
        centers = np.array([x[labels == c].mean(0) if (labels == c).any() else centers[c] for c in range(k)])
    return labels


def kmeans_per_sample(df: DataFrame, v: str, k: int, seed: int = 0, key: str = "id", sample: str = "sample", unknown: str | None = None) -> DataFrame:
    """key, sample, cluster: each sample scaled and clustered by itself, in at most as many clusters as it has rows.

    A null sample (or the value `unknown`) gets -1. A sample is one task: samples are of a size for that.
    """
    known = F.col(sample).isNotNull() & (F.lit(True) if unknown is None else F.col(sample) != unknown)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.stack(pdf["_v"].to_numpy()).astype(float)
        std = x.std(0)
        labels = _numpy_kmeans((x - x.mean(0)) / np.where(std > 0, std, 1), min(k, len(x)), seed)
        return pd.DataFrame({key: pdf[key], sample: pdf[sample], "cluster": labels.astype("int32")})

    rows = df.select(key, sample, doubles(F.col(v)).alias("_v"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    done = rows.filter(known).groupBy(sample).applyInPandas(fit, f"{key} {kinds[key]}, {sample} {kinds[sample]}, cluster int")
    return done.unionByName(rows.filter(~known | F.col(sample).isNull()).select(key, sample, F.lit(-1).alias("cluster")))


def hash_sample(df: DataFrame, key: str, n: int = 5000) -> DataFrame:
    """At most n rows, the same ones each time."""
    return df.orderBy(F.xxhash64(key), key).limit(n)


def choose_k(df: DataFrame, v: str, k_max: int, criterion: str = "silhouette", key: str = "id", sample: int = 5000, seed: int = 0) -> tuple[int, dict[int, float]]:
    """The k in 2 .. k_max of the largest silhouette or least Davies-Bouldin index on a sample, and all values; the first of equals."""
    if criterion not in ("silhouette", "davies_bouldin"):
        raise ValueError(f"unknown criterion: {criterion}")
    rows = standardise(hash_sample(df, key, sample), v, "_s").persist()
    found = {}
    for k in range(2, k_max + 1):
        labelled = kmeans(rows.select(key, "_s"), "_s", k, seed, scale=False)
        found[k] = silhouette_mean(labelled, key, "_s", "cluster") if criterion == "silhouette" else davies_bouldin(labelled, "_s", "cluster").first()[0]
    best = max(found, key=lambda k: (found[k], -k)) if criterion == "silhouette" else min(found, key=lambda k: (found[k], k))
    return best, found


def choose_k_by_criteria(df: DataFrame, v: str, k_max: int, key: str = "id", sample: int = 5000) -> int:
    """The whole part of the median of the k that each criterion prefers."""
    rows = standardise(hash_sample(df, key, sample), v, "_s").persist()
    scores = {}
    for k in range(2, k_max + 1):
        q = quality(kmeans(rows.select(key, "_s"), "_s", k, 0, scale=False), key, "_s", "cluster").first()
        scores[k] = (q["silhouette"], q["calinski_harabasz"], -q["davies_bouldin"])
    return int(np.median([max(scores, key=lambda k: scores[k][c]) for c in range(3)]))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            data = np.ascontiguousarray(np.stack(part.column(2).to_numpy(zero_copy_only=False)), "<f8")
            yield pa.record_batch([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([part.column(1).to_pylist()], pa.list_(pa.int64())), pa.array([data.tobytes()])], ["ids", "labels", "data"])


def _distance_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            x, y = (np.frombuffer(d, "<f8").reshape(len(i), -1) for d, i in ((r["data"], r["ids"]), (r["t_data"], r["t_labels"])))
            labels, code = np.unique(np.array(r["t_labels"]), return_inverse=True)
            if x.shape[1] <= 16:  # by differences, exact where points are close together and far from the origin
                d = np.sqrt(sum(np.subtract.outer(x[:, k], y[:, k]) ** 2 for k in range(x.shape[1])))
            else:
                d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0))
                if r["block"] == r["t_block"]:
                    np.fill_diagonal(d, 0.0)
            sums = np.stack([d[:, code == c].sum(1) for c in range(len(labels))], 1)
            n = len(labels)
            yield pa.record_batch(
                [pa.array(np.repeat(r["ids"], n)), pa.array(np.repeat(r["labels"], n)), pa.array(np.tile(labels, len(x))), pa.array(sums.ravel()), pa.array(np.tile(np.bincount(code), len(x)).astype(np.int64))],
                ["id", "label", "other", "total", "n"])


def silhouette(df: DataFrame, key: str, v: str, label: str) -> DataFrame:
    """id, label, a, b, silhouette of each point (Rousseeuw 1987, Euclidean); 0 in clusters of one.

    All distances, in blocks of points against blocks of points, never a row per pair. Exact, and
    so quadratic in work: for large tables take hash_sample() first.
    """
    rows = df.select(F.col(key).cast("bigint"), F.col(label).cast("bigint"), doubles(F.col(v)))
    blocks = rows.mapInArrow(_blocks, "ids array<bigint>, labels array<bigint>, data binary")
    blocks = written(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    other = blocks.select(F.col("block").alias("t_block"), F.col("labels").alias("t_labels"), F.col("data").alias("t_data"))
    names = blocks.agg(F.collect_list("block").alias("_names"))  # one row, a number per block
    every = blocks.crossJoin(F.broadcast(names)).withColumn("t_block", F.explode("_names")).drop("_names")
    sums = every.join(other, "t_block").mapInArrow(_distance_sums, "id bigint, label bigint, other bigint, total double, n bigint")
    per = sums.groupBy("id", "label", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.col("other") == F.col("label")
    s = per.groupBy("id", "label").agg(
        F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    value = (F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0))
    return s.withColumn("silhouette", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.coalesce(value, F.lit(0.0))).otherwise(F.lit(0.0)))


def simplified_silhouette(df: DataFrame, key: str, v: str, label: str) -> DataFrame:
    """id, label, a, b, silhouette with the distance to a cluster's mean in place of the mean distance to its points.

    Linear in the points, for tables where the exact one is too much; clusters by points are compared.
    """
    rows = df.select(F.col(key).alias("id"), F.col(label).cast("bigint").alias("label"), doubles(F.col(v)).alias("_v"))
    dims = rows.select("label", F.posexplode("_v")).groupBy("label", "pos").agg(F.avg("col").alias("m"))
    centers = dims.groupBy(F.col("label").alias("c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("center"))
    d = rows.crossJoin(small(written(centers, "centers"))).select("id", "label", "c", F.sqrt(_squared(F.col("_v"), F.col("center"))).alias("d"))  # a row per cluster
    s = d.groupBy("id", "label").agg(F.max(F.when(F.col("c") == F.col("label"), F.col("d"))).alias("a"), F.min(F.when(F.col("c") != F.col("label"), F.col("d"))).alias("b"))
    return s.withColumn("silhouette", F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))


def pair_distances(points: DataFrame, label: str, key: str = "id") -> DataFrame:
    """label, mean_distance of the pairs within each cluster of two or more; in blocks, as silhouette() has them."""
    own = silhouette(points.withColumn("_xy", F.array("x", "y")), key, "_xy", label).filter(F.col("a").isNotNull())
    return own.groupBy(F.col("label").alias(label)).agg(F.avg("a").alias("mean_distance"))


def silhouette_mean(df: DataFrame, key: str, v: str, label: str) -> float:
    return silhouette(df, key, v, label).agg(F.avg("silhouette")).first()[0]


def silhouette_by_cluster(s: DataFrame) -> DataFrame:
    return s.groupBy("label").agg(F.avg("silhouette").alias("mean"), F.stddev_pop("silhouette").alias("std"), F.count("*").alias("n"))


def coherence_effect(a: Column, b: Column) -> Column:
    """Relative gain of one mean silhouette over another, 0 where the other is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise((a - b) / F.nullif(b, F.lit(0.0)))


def calinski_harabasz(df: DataFrame, v: str, label: str) -> DataFrame:
    """One row: (between / (k - 1)) / (within / (n - k)); null for one cluster. One pass over the data."""
    dims = df.select(label, F.posexplode(doubles(F.col(v)))).groupBy(label, "pos").agg(F.count("*").cast("double").alias("n"), F.sum("col").alias("s"), F.sum(F.col("col") * F.col("col")).alias("q"))
    own = dims.groupBy("pos").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("sq"), F.count("*").cast("double").alias("k"))
    t = own.agg(F.sum("within").alias("w"), F.sum(F.col("sq") - F.col("ts") * F.col("ts") / F.col("tn")).alias("b"), F.max("tn").alias("n"), F.max("k").alias("k"))
    return t.select(((F.col("b") / F.nullif(F.col("k") - 1, F.lit(0.0))) / F.nullif(F.col("w") / F.nullif(F.col("n") - F.col("k"), F.lit(0.0)), F.lit(0.0))).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, v: str, label: str) -> DataFrame:
    """One row: the mean over clusters of the largest (s_i + s_j) / d_ij; null for one cluster."""
    dims = df.select(label, F.posexplode(doubles(F.col(v)))).groupBy(label, "pos").agg(F.avg("col").alias("m"))
    centers = dims.groupBy(F.col(label).alias("_c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("center"))
    spread = df.join(small(written(centers, "centers")), F.col(label) == F.col("_c")).groupBy("_c").agg(F.avg(F.sqrt(_squared(doubles(F.col(v)), F.col("center")))).alias("s"), F.first("center").alias("center"))
    spread = written(spread, "spread")
    other = spread.select(F.col("_c").alias("c2"), F.col("s").alias("s2"), F.col("center").alias("center2"))
    pairs = spread.join(small(other), F.col("_c") != F.col("c2"))  # clusters by clusters
    ratio = (F.col("s") + F.col("s2")) / F.nullif(F.sqrt(_squared(F.col("center"), F.col("center2"))), F.lit(0.0))
    return pairs.groupBy("_c").agg(F.max(ratio).alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def quality(df: DataFrame, key: str, v: str, label: str) -> DataFrame:
    """One row: silhouette, calinski_harabasz, davies_bouldin. One cluster gives -1, 0 and infinity."""
    s = silhouette(df, key, v, label).agg(F.avg("silhouette").alias("silhouette"), F.count_distinct("label").alias("k"))
    out = s.crossJoin(calinski_harabasz(df, v, label)).crossJoin(davies_bouldin(df, v, label))  # one row each
    one = F.col("k") < 2
    return out.select(
        F.when(one, F.lit(-1.0)).otherwise(F.col("silhouette")).alias("silhouette"), F.when(one, F.lit(0.0)).otherwise(F.col("calinski_harabasz")).alias("calinski_harabasz"),
        F.when(one, F.lit(float("inf"))).otherwise(F.col("davies_bouldin")).alias("davies_bouldin"))


def quality_bundle(df: DataFrame, key: str, v: str, label: str) -> DataFrame:
    """quality() with the balance of sizes and the separation of the clusters' mean vectors."""
    return quality(df, key, v, label).crossJoin(size_balance(df, label)).crossJoin(center_separation(df, label, v))


def pca(df: DataFrame, v: str, k: int = 2, out: str = "pc") -> tuple[DataFrame, list[float]]:
    """df with its first k principal components, and the share of variance of each."""
    rows = df.withColumn("_f", array_to_vector(doubles(F.col(v))))
    model = PCA(k=k, inputCol="_f", outputCol="_pc").fit(rows)
    return model.transform(rows).withColumn(out, vector_to_array("_pc")).drop("_f", "_pc"), model.explainedVariance.toArray().tolist()


def feature_quality(df: DataFrame, v: str) -> dict[str, float]:
    """Mean and variation of the dimensions' variances, mean absolute correlation between them, and what principal components hold."""
    rows = df.withColumn("_f", array_to_vector(doubles(F.col(v))))
    dims = df.select(F.posexplode(doubles(F.col(v)))).groupBy("pos").agg(F.var_pop("col").alias("var"))
    mean, std, d = dims.agg(F.avg("var"), F.stddev_pop("var"), F.count("*")).first()
    corr = np.nan_to_num(Correlation.corr(rows, "_f").first()[0].toArray())
    share = np.cumsum(PCA(k=d, inputCol="_f", outputCol="_pc").fit(rows).explainedVariance.toArray())
    return {"variance_mean": mean, "variance_cv": std / mean if mean else 0.0, "mean_abs_correlation": float(np.abs(corr[~np.eye(d, dtype=bool)]).mean()), "variance_at_50": float(share[min(50, d) - 1]), "components_95": int(np.searchsorted(share, 0.95) + 1)}


def ensemble(df: DataFrame, v: str, k: int, key: str = "id", sample: int = 1000, seed: int = 42) -> DataFrame:
    """df with cluster: k-means, bisecting and graph clusterings of a sample, joined by consensus() and weighed by silhouette.

    The consensus is of at most `sample` rows, since it compares all with all; every row then takes the
    nearest of its clusters' mean vectors.
    """
    from gridloom.operators.joins import knn_edges

    some = written(hash_sample(df, key, sample).select(F.col(key).alias("id"), doubles(F.col(v)).alias("_v")), "sample")
    plane, _ = pca(standardise(some, "_v", "_z"), "_z", 2)
    edges = knn_edges(plane.select("id", F.col("pc")[0].alias("x"), F.col("pc")[1].alias("y"), F.lit("all").alias("sample")), 10)
    ways = {
        "kmeans": kmeans(some, "_v", k, seed).select("id", F.col("cluster").alias("kmeans")),
        "bisecting": bisecting(some, "_v", k, seed).select("id", F.col("cluster").alias("bisecting")),
        "spectral": spectral(edges, k).select("id", F.col("cluster").alias("spectral")),
    }
    both = some
    for way in ways.values():
        both = both.join(way, "id", "left").fillna(-1)
    both = written(both, "labelings")
    scores = [max(1e-3, silhouette_mean(both, "id", "_v", name) or 0.0) for name in ways]
    rows = both.select("id", *ways).orderBy("id").toPandas()  # the sample
    rows["cluster"] = consensus(rows[list(ways)], scores, min(k, len(rows)))
    labelled = some.join(some.sparkSession.createDataFrame(rows[["id", "cluster"]].astype("int64")), "id")
    dims = labelled.select("cluster", F.posexplode("_v")).groupBy("cluster", "pos").agg(F.avg("col").alias("m")).orderBy("cluster", "pos").collect()
    centers: dict[int, list[float]] = {}
    for r in dims:
        centers.setdefault(r["cluster"], []).append(r["m"])
    width = len(next(iter(centers.values())))
    return ClusterModel([0.0] * width, [1.0] * width, [centers[c] for c in sorted(centers)]).assign(df, v)


def consensus(labelings: pd.DataFrame, scores: list[float], k: int) -> np.ndarray:
    """k clusters from several labelings of the same few points (a column each): average linkage on score-weighted co-association.

    On the driver, for samples of at most some thousands.
    """
    x, w = labelings.to_numpy(), np.asarray(scores, float)
    w = w / w.sum()
    dist = 1 - sum(wi * (x[:, [c]] == x[None, :, c]) for c, wi in enumerate(w))
    groups, sizes = list(range(len(x))), np.ones(len(x))
    np.fill_diagonal(dist, np.inf)
    for _ in range(len(x) - k):
        i, j = sorted(np.unravel_index(np.argmin(dist), dist.shape))
        merged = (sizes[i] * dist[i] + sizes[j] * dist[j]) / (sizes[i] + sizes[j])
        dist[i], dist[:, i], dist[i, i] = merged, merged, np.inf
        dist[j], dist[:, j] = np.inf, np.inf
        sizes[i] += sizes[j]
        groups = [i if g == j else g for g in groups]
    return np.unique(groups, return_inverse=True)[1]
