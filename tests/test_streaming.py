import numpy as np
from pyspark.sql import functions as F

from gridloom.operators.clustering import ClusterModel, minibatch_kmeans
from gridloom.operators.joins import nearest
from gridloom.streaming.batches import assign_stream, cluster_stream


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    rows = [(i, float(i % 17), float(i * 7 % 23)) for i in range(60)]
    spots = spark.createDataFrame([(i, float(i % 5 * 4), float(i // 5 * 5)) for i in range(25)], "id bigint, x double, y double")
    points = spark.createDataFrame(rows, "id bigint, x double, y double")
    points.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    for _ in range(2):  # the second finds nothing new
        assign_stream(stream, spots, 4.0, f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert got.select("batch").distinct().count() == 3
    assert sorted(tuple(r) for r in got.select("l_id", "r_id", "dist").collect()) == sorted(tuple(r) for r in nearest(points, spots, 4.0).select("l_id", "r_id", "dist").collect())


def test_clusters_of_a_stream(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(10 * (i % 3), 1, 2)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    for part in range(3):
        df.filter(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    start = ClusterModel([0.0, 0.0], [1.0, 1.0], [[0.0, 0.0], [9.0, 9.0], [21.0, 21.0]], [0.0] * 3)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    for _ in range(2):  # the second finds nothing new
        cluster_stream(stream, "v", start, f"file://{tmp_path}/model", f"file://{tmp_path}/check").awaitTermination()
    model = ClusterModel.load(spark, f"file://{tmp_path}/model/batch=2")
    assert model.counts == [30.0, 30.0, 30.0]
    for c in range(3):
        assert np.allclose(model.centers[c], np.mean([v for i, v in rows if i % 3 == c], axis=0))


def test_a_pass_of_batches_against_numpy(spark):
    r = np.random.default_rng(4)
    x = r.normal(0, 1, (120, 3)) + np.repeat(np.eye(3) * 6, 40, 0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    model = minibatch_kmeans(df, "v", 3, batches=4)
    mean, std = x.mean(0), x.std(0)
    z, centers, counts = (x - mean) / std, ((x - mean) / std)[:3].copy(), np.zeros(3)
    for b in range(4):
        part = z[np.arange(120) % 4 == b]
        near = ((part[:, None] - centers) ** 2).sum(2).argmin(1)
        for c in range(3):
            if (near == c).any():
                centers[c] = (centers[c] * counts[c] + part[near == c].sum(0)) / (counts[c] + (near == c).sum())
                counts[c] += (near == c).sum()
    assert np.allclose(model.centers, centers) and np.allclose(model.counts, counts)
    got = [r["cluster"] for r in model.assign(df, "v").orderBy("id").collect()]
    assert got == ((z[:, None] - centers) ** 2).sum(2).argmin(1).tolist()
