"""Queries of readers and writers: what is written is read again and held against SQL on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import colors as K
from gridloom.functions import vectors as V
from gridloom.operators import clustering as C
from gridloom.operators import filters as L
from gridloom.operators import joins as J
from gridloom.operators import raster as I
from gridloom.plans.base import DIST, METRICS, PIX, PIXEL_COLS, PIXEL_ROWS, PTS, SPOTS, metrics, nuclei, pixels, points, query, r6, spots, table
from gridloom.plans.matching import NEAREST, PASS, RANGES
from gridloom.session import scratch
from gridloom.sources import readers as R
from gridloom.sources import writers as W

YX = "CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x"


@query(f"WITH {PIX} SELECT {YX}, CAST(0 AS INTEGER) AS c, CAST(v AS DOUBLE) AS v FROM pix")
def gray_tiff(spark, sf):
    path = f"{scratch(spark, 'images')}/gray.tif"
    W.image(pixels(spark, sf), path, PIXEL_ROWS, PIXEL_COLS, ["v"], strip_rows=7)
    return R.raster(spark, path)


@query(f"WITH {PIX} SELECT {YX}, CAST(0 AS INTEGER) AS c, CAST(v AS DOUBLE) AS v FROM pix WHERE y BETWEEN 5 AND 19 AND x BETWEEN 8 AND 39")
def raster_region(spark, sf):
    path = f"{scratch(spark, 'images')}/gray.npy"
    W.image(pixels(spark, sf), path, PIXEL_ROWS, PIXEL_COLS, ["v"], "uint16", strip_rows=5)
    return R.raster(spark, path, (5, 20, 8, 40))


@query(f"WITH {PIX} SELECT {YX}, label > 0 AS v FROM pix")
def binary_tiff(spark, sf):
    path = f"{scratch(spark, 'images')}/binary.tif"
    W.image(I.binary(pixels(spark, sf)), path, PIXEL_ROWS, PIXEL_COLS, ["v"])
    return R.binary_mask(spark, path)


@query(f"WITH {PIX} SELECT {YX}, CAST(label AS INTEGER) AS label FROM pix WHERE label > 0")
def label_map_file(spark, sf):
    path = f"{scratch(spark, 'images')}/labels.npy"
    W.image(pixels(spark, sf), path, PIXEL_ROWS, PIXEL_COLS, ["label"], "int32")
    return R.label_map(spark, path)


@query(f"WITH {PIX}, t AS (SELECT y, x, v, label FROM pix) SELECT {YX}, CAST(c AS INTEGER) AS c, CAST(CASE WHEN label > 0 THEN trunc(v * 0.5e0 + (CASE WHEN c = 0 THEN 255 ELSE 0 END) * 0.5e0) ELSE v END AS DOUBLE) AS v FROM t, range(3) r(c)")
def tiled_overlay(spark, sf):
    """An overlay as TIFF tiles; the palette has one colour."""
    folder, p = scratch(spark, "overlay"), pixels(spark, sf)
    o = I.overlay(p.select("y", "x", "v"), p.select("y", "x", "label"), K.palette_table(spark, K.palette(1, custom=["#FF0000"])), 1, 0.5)
    W.tiff_tiles(o, folder, PIXEL_ROWS, PIXEL_COLS, ["r", "g", "b"], tile=20)
    return R.raster_tiles(spark, folder, 20)


@query(f"SELECT name, CAST({PIXEL_COLS} AS INTEGER) AS w, CAST({PIXEL_ROWS} AS INTEGER) AS h FROM (VALUES ('npy'), ('tif')) t(name) UNION ALL SELECT 'none', 1000, 1000")
def image_sizes(spark, sf):
    folder, rows = scratch(spark, "images"), []
    for kind in ("npy", "tif"):
        W.image(pixels(spark, sf), f"{folder}/a.{kind}", PIXEL_ROWS, PIXEL_COLS, ["v"])
        rows.append((kind, *R.image_size(spark, f"{folder}/a.{kind}")))
    return spark.createDataFrame([*rows, ("none", *R.image_size(spark, f"{folder}/none.npy"))], "name string, w int, h int")


def _scaled(spark, sf):
    """nucleus_id, scale, v: 32 dimensions as scale 16 and 32 as scale 32."""
    e = table(spark, sf, "embeddings")
    parts = [e.select(F.col("vec_id").alias("nucleus_id"), F.lit(s).alias("scale"), F.slice("embedding", a, 32).alias("v")) for s, a in ((16, 1), (32, 33))]
    return parts[0].unionByName(parts[1])


@query("SELECT vec_id AS nucleus_id, CAST(32 AS INTEGER) AS scale, round(list_sum(CAST(embedding[33:64] AS DOUBLE[])), 6) + 0 AS total, CAST(1000 * CAST(embedding[1] AS DOUBLE) AS INTEGER) AS x_center FROM embeddings")
def features_by_scale(spark, sf):
    """Vectors in a folder per scale, of which one is read, joined to the coordinates."""
    folder = scratch(spark, "features")
    coords = points(spark, sf).select(F.col("id").alias("nucleus_id"), F.rint("x").cast("int").alias("x_center"))
    W.features(_scaled(spark, sf), coords, spark.createDataFrame([("concatenate",)], "method string"), folder, by_scale=True)
    one = spark.read.parquet(f"{folder}/features").filter("scale = 32")
    total = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return J.positional_join(one, spark.read.parquet(f"{folder}/coords")).select("nucleus_id", "scale", r6(total).alias("total"), "x_center")


@query("SELECT CAST(embedding[3] AS FLOAT) AS vit32_0, CAST(embedding[4] AS FLOAT) AS vit32_1 FROM embeddings")
def columns_of_scale(spark, sf):
    e = F.col("embedding")
    wide = table(spark, sf, "embeddings").select(*[e[i].alias(f"vit{s}_{k}") for i, (s, k) in enumerate(((16, 0), (16, 1), (32, 0), (32, 1), (64, 0)))])
    return R.features_of_scales(wide, [32])


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def features_from_csv(spark, sf):
    """There is no Parquet folder, so the CSV is read."""
    folder = scratch(spark, "features")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("header", True).csv(f"{folder}/csv")
    found = R.features(spark, f"{folder}/parquet", f"{folder}/csv")
    return found.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))


@query(f"WITH {SPOTS}, p AS (SELECT a.id AS nucleus_id, b.id AS spot_id, a.sample, {DIST} AS dist FROM nuclei a JOIN spots b ON a.sample = b.sample WHERE {DIST} <= 50 AND a.sample IN ('S0', 'S2')) SELECT sample, nucleus_id, spot_id, round(dist, 6) + 0 AS dist FROM ({NEAREST})")
def aligned_rows(spark, sf):
    a = R.aligned(nuclei(spark, sf).select("id", "x", "y", "sample"), spots(spark, sf).select("id", "x", "y", "sample"), ["S0", "S2"])
    return a.select("sample", F.col("l_id").alias("nucleus_id"), F.col("r_id").alias("spot_id"), r6("dist").alias("dist"))


@query(f"WITH {SPOTS}, p AS (SELECT b.id AS nucleus_id, a.id AS spot_id, a.sample, {DIST} AS dist FROM nuclei a JOIN spots b ON a.sample = b.sample WHERE {DIST} < 100 AND a.sample = 'S1') SELECT sample, nucleus_id AS spot_id, spot_id AS nucleus_id, round(dist, 6) + 0 AS dist FROM ({NEAREST})")
def matched_rows(spark, sf):
    a = R.matched(nuclei(spark, sf).select("id", "x", "y", "sample"), spots(spark, sf).select("id", "x", "y", "sample"), ["S1"])
    return a.select("sample", F.col("l_id").alias("spot_id"), F.col("r_id").alias("nucleus_id"), r6("dist").alias("dist"))


@query(f"WITH {PTS}, n AS (SELECT CASE WHEN sample = 'S2' THEN 'S2-late' ELSE sample END AS sample, CASE WHEN label > 2 THEN label END AS cluster FROM pts) SELECT side, sample, count(*) AS n FROM (SELECT 'points' AS side, left(sample, 2) AS sample FROM n WHERE cluster IS NOT NULL AND sample IN ('S0', 'S2-late') UNION ALL SELECT 'spots', sample FROM pts WHERE sample IN ('S0', 'S2')) GROUP BY 1, 2")
def validated_rows(spark, sf):
    """Rows of the wanted samples (one of which has a longer name) without missing labels."""
    p = points(spark, sf)
    late = F.when(F.col("sample") == "S2", F.lit("S2-late")).otherwise(F.col("sample"))
    a, b = R.validated_pair(p.withColumn("cluster", F.when(F.col("label") > 2, F.col("label"))).withColumn("sample", late), p, ["S0", "S2"], "label")
    both = a.select(F.lit("points").alias("side"), "sample").unionByName(b.select(F.lit("spots").alias("side"), "sample"))
    return both.groupBy("side", "sample").agg(F.count("*").alias("n"))


@query(f"WITH {PTS} SELECT sample, count(*) AS n, CAST(sum(label) AS BIGINT) AS labels FROM pts WHERE sample IN ('S1', 'S2') GROUP BY sample")
def rows_of_samples(spark, sf):
    p = points(spark, sf)
    _, _, own = R.triple(p.select("id"), p.select("v"), p, ["S1", "S2"])
    return own.groupBy("sample").agg(F.count("*").alias("n"), F.sum("label").cast("bigint").alias("labels"))


@query("SELECT o_orderpriority AS configuration, count(*) AS n FROM orders GROUP BY 1")
def discovered_folders(spark, sf):
    """A folder per priority, found by a pattern, and the rows in it."""
    folder, o = scratch(spark, "found"), table(spark, sf, "orders")
    o.select("o_orderkey", F.regexp_replace("o_orderpriority", "[^0-9A-Za-z]+", "_").alias("name"), "o_orderpriority").repartition(1).write.partitionBy("name").parquet(folder)
    found = R.discover(spark, f"{folder}/*/*.parquet").groupBy("configuration").agg(F.first("path").alias("path"))
    rows = spark.read.parquet(folder).withColumn("configuration", F.concat(F.lit("name="), "name"))
    return rows.join(found, "configuration").groupBy(F.col("o_orderpriority").alias("configuration")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, round(avg(l_quantity), 6) + 0 AS mean, max(l_linenumber) AS most FROM lineitem")
def metrics_as_json(spark, sf):
    path = scratch(spark, "metrics")
    got = table(spark, sf, "lineitem").agg(F.count("*").alias("n"), r6(F.avg("l_quantity")).alias("mean"), F.max("l_linenumber").alias("most")).first()
    W.write_json(spark, got.asDict(), path)
    return R.metrics_json(spark, path).select("n", "mean", F.col("most").cast("int").alias("most"))


@query("SELECT 'S3' AS missing UNION ALL SELECT 'S9'")
def missing_samples(spark, sf):
    p = points(spark, sf)
    return spark.createDataFrame([(s,) for s in R.validate_inputs(p, p, (["x", "y", "sample", "label"], ["x", "y", "sample"]), ["S0", "S1", "S3", "S9"])], "missing string")


@query(f"WITH {METRICS}, t AS (SELECT label, {PASS} AS passed FROM d) SELECT passed, count(*) AS n, CAST(sum(label) AS BIGINT) AS labels, (SELECT count(*) FROM t) AS total FROM t GROUP BY passed")
def passed_files(spark, sf):
    """Labels that passed and that failed, each from its own folder, beside the counts."""
    folder = scratch(spark, "passed")
    W.labels_by_pass(L.passed(L.derived(metrics(spark, sf)), RANGES.validate()).select("label", "passed"), folder)
    both = [spark.read.parquet(f"{folder}/{n}").withColumn("passed", F.lit(n == "passed")) for n in ("passed", "failed")]
    n = R.metrics_json(spark, f"{folder}/counts").select((F.col("passed") + F.col("failed")).cast("bigint").alias("total"))
    return both[0].unionByName(both[1]).groupBy("passed").agg(F.count("*").alias("n"), F.sum("label").cast("bigint").alias("labels")).crossJoin(n)


@query(f"WITH {PIX} SELECT CAST(label AS INTEGER) AS label, count(*) AS n, CAST(sum(y * 1000 + x) AS BIGINT) AS places FROM pix WHERE label > 0 AND label % 3 = 0 GROUP BY label")
def mask_files(spark, sf):
    path, p = scratch(spark, "masks"), pixels(spark, sf).filter("label > 0")
    W.mask_stack(p, p.filter("label % 3 = 0").select("label"), path)
    return spark.read.parquet(path).groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"), F.sum(F.col("y") * 1000 + F.col("x")).cast("bigint").alias("places"))


@query(f"""WITH {PTS}, m AS (SELECT 0 AS c, -50 AS x, -50 AS y UNION ALL SELECT 1, 60, -10 UNION ALL SELECT 2, 0, 80)
SELECT id, CAST(c AS INTEGER) AS cluster FROM (SELECT a.id, b.c, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.c) AS rn FROM pts a, m b) WHERE rn = 1""")
def saved_model(spark, sf):
    """Points find their clusters by a model that was saved and loaded: centres in scaled coordinates, and the scaler."""
    folder, p = scratch(spark, "clusters"), points(spark, sf).withColumn("xy", F.array("x", "y"))
    model = C.ClusterModel([10.0, -20.0], [10.0, 10.0], [[-6.0, -3.0], [5.0, 1.0], [-1.0, 10.0]])
    W.clusters(model.assign(p, "xy").select("id", "cluster"), spark.createDataFrame([(0,)], "c int"), folder, model)
    return C.ClusterModel.load(spark, f"{folder}/model").assign(p, "xy").select("id", "cluster")


@query("""SELECT quality AS a, count(CASE WHEN toxic = 0 THEN 1 END) AS "0", count(CASE WHEN toxic = 1 THEN 1 END) AS "1" FROM labels GROUP BY quality""")
def confusion_file(spark, sf):
    folder, t = scratch(spark, "metrics"), table(spark, sf, "labels")
    cells = t.groupBy(F.col("quality").alias("a"), F.col("toxic").alias("b")).agg(F.count("*").alias("n"))
    one = spark.createDataFrame([(0, 1.0)], "label int, mean double")
    W.metrics_bundle(spark, {"ari": 0.5}, {"first": one, "second": one}, cells, folder)
    return R.csv(spark, f"{folder}/confusion", "a int, `0` bigint, `1` bigint")


@query(f"WITH {PTS} SELECT sample, count(*) AS n_points, round(avg(x), 5) + 0 AS mean_x FROM pts GROUP BY sample")
def spatial_files(spark, sf):
    folder, p = scratch(spark, "spatial"), points(spark, sf)
    W.spatial_bundle(p.groupBy("sample").agg(F.count("*").alias("n_points"), F.avg("x").alias("mean_x")), p.select("id", "x"), folder)
    return R.csv(spark, f"{folder}/autocorrelation", "sample string, n_points bigint, mean_x double").withColumn("mean_x", F.round("mean_x", 5) + 0)


RESULTS = "r AS (SELECT o_orderstatus AS scales, CAST(o_custkey % 3 AS INTEGER) AS K, o_orderpriority AS sample, avg(o_totalprice) / 1000000 AS ari FROM orders GROUP BY 1, 2, 3)"


@query(f"WITH {RESULTS} SELECT scales, K, round(avg(ari), 6) + 0 AS ari FROM r GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 1")
def best_configuration(spark, sf):
    folder, o = scratch(spark, "report"), table(spark, sf, "orders")
    r = o.groupBy(F.col("o_orderstatus").alias("scales"), (F.col("o_custkey") % 3).cast("int").alias("K"), F.col("o_orderpriority").alias("sample")).agg((F.avg("o_totalprice") / 1000000).alias("ari"))
    W.comparison_report(r, folder)
    return R.metrics_json(spark, f"{folder}/best").select("scales", F.col("K").cast("int").alias("K"), r6("ari").alias("ari"))


@query("SELECT o_orderpriority AS configuration, count(*) AS n FROM orders GROUP BY 1")
def quality_files(spark, sf):
    folder = scratch(spark, "quality")
    q = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("configuration")).agg(F.count("*").alias("n"))
    W.quality_report(q, q.limit(1), folder)
    return R.csv(spark, f"{folder}/quality", "configuration string, n bigint")


@query("SELECT CAST(16 * power(2, n_regionkey % 3) AS INTEGER) AS scale, CAST(min(n_nationkey) AS INTEGER) AS first, CAST(max(n_nationkey) + 1 AS INTEGER) AS stop FROM nation GROUP BY 1")
def detected_scales(spark, sf):
    """Scales and their positions, from column names made of the nations."""
    names = [f"vit{16 * 2 ** (r['n_regionkey'] % 3)}_{r['n_nationkey']}" for r in table(spark, sf, "nation").orderBy("n_nationkey").collect()]
    return spark.createDataFrame([(s, a, b) for s, (a, b) in V.detect_scales(names).items()], "scale int, first int, stop int")


@query("SELECT vec_id, embedding[1] AS vit16_0, embedding[2] AS vit16_1, embedding[5] AS vit64_0 FROM embeddings")
def selected_scales(spark, sf):
    """Asked for in any order, scales come in ascending order."""
    e = F.col("embedding")
    wide = table(spark, sf, "embeddings").select("vec_id", *[e[i].alias(f"vit{s}_{k}") for i, (s, k) in enumerate(((16, 0), (16, 1), (32, 0), (32, 1), (64, 0)))])
    return V.select_scales(wide, [64, 16], ["vec_id"])


@query("SELECT h, w, CAST(trunc(0.1e0 * h) AS INTEGER) AS y0, CAST(trunc(0.5e0 * h) AS INTEGER) AS y1, CAST(trunc(0.2e0 * w) AS INTEGER) AS x0, CAST(least(w, trunc(1.6e0 * w)) AS INTEGER) AS x1 FROM (SELECT CAST(r_regionkey * 100 + 37 AS INTEGER) AS h, CAST(r_regionkey * 70 + 11 AS INTEGER) AS w FROM region)")
def region_bounds(spark, sf):
    sizes = [(r["r_regionkey"] * 100 + 37, r["r_regionkey"] * 70 + 11) for r in table(spark, sf, "region").collect()]
    return spark.createDataFrame([(h, w, *L.region_slice(h, w, (0.1, 0.5, 0.2, 1.6))) for h, w in sizes], "h int, w int, y0 int, y1 int, x0 int, x1 int")


@query("SELECT name, low, high, low >= 0 AND low <= high AND high <= 1 AS valid FROM (SELECT r_name AS name, CAST(r_regionkey AS DOUBLE) / 4 AS low, CAST(r_regionkey * 0.5e0 AS DOUBLE) AS high FROM region)")
def valid_thresholds(spark, sf):
    rows = []
    for r in table(spark, sf, "region").collect():
        low, high = r["r_regionkey"] / 4, r["r_regionkey"] * 0.5
        try:
            L.Thresholds(solidity=(low, high)).validate()
            rows.append((r["r_name"], low, high, True))
        except ValueError:
            rows.append((r["r_name"], low, high, False))
    return spark.createDataFrame(rows, "name string, low double, high double, valid boolean")


@query("SELECT background, CAST(alpha AS INTEGER) AS alpha, CAST(n AS INTEGER) AS n FROM (VALUES ('dark', 255, 7), ('light', 128, 7)) t(background, alpha, n)")
def color_settings(spark, sf):
    """Settings as a dictionary and back, and the number of colours that they give."""
    made = [K.ColorConfig.from_dict(K.ColorConfig(background=b, alpha=a).to_dict()) for b, a in (("dark", 255), ("light", 128))]
    return spark.createDataFrame([(c.background, c.alpha, len({x[:3] for x in c.generate(7)})) for c in made], "background string, alpha int, n int")


@query()
def enhanced_image(spark, sf):
    """The enhancement of the binary image, which a test holds against a pixel-by-pixel version."""
    rows = I.binary(pixels(spark, sf)).orderBy("y", "x").toPandas()  # the fixed small image
    out = I.enhance_binary(rows["v"].to_numpy().reshape(PIXEL_ROWS, PIXEL_COLS).astype("uint8"))
    return spark.createDataFrame([(int(y), int(x), int(out[y, x])) for y in range(PIXEL_ROWS) for x in range(PIXEL_COLS)], "y int, x int, v int")
