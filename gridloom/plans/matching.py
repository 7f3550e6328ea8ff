"""Queries of filters, projections and spatial joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import vectors as V
from gridloom.operators import aggregates as A
from gridloom.operators import filters as L
from gridloom.operators import joins as J
from gridloom.operators.agreement import agreement
from gridloom.operators.projections import as_spots, encode_labels, flip_y, zone
from gridloom.plans.base import DIMS, DIST, METRICS, PTS, SPOTS, metrics, nuclei, points, query, r6, spots, table
from gridloom.session import with_ids
from gridloom.sources.readers import patch_sizes

RADIUS, NEAR = 60.0, 80.0
BLOCKS = {16: (0, 16), 32: (16, 32), 64: (32, 64)}
RANGES = L.Thresholds(pixels=(5, 45), circularity=(0.2, 1.0), solidity=(0.93, 1.0), eccentricity=(0.0, 0.9), aspect_ratio=(0.0, 3.0), hole_fraction=(0.0, 0.07))
PASS = "coalesce(area BETWEEN 5 AND 45 AND circularity BETWEEN 0.2e0 AND 1 AND solidity BETWEEN 0.93e0 AND 1 AND eccentricity BETWEEN 0 AND 0.9e0 AND aspect_ratio BETWEEN 0 AND 3 AND hole_fraction BETWEEN 0 AND 0.07e0, false)"


@query(f"WITH {METRICS} SELECT label, aspect_ratio, hole_fraction, circularity FROM d")
def derived_ratios(spark, sf):
    return L.derived(metrics(spark, sf)).select("label", "aspect_ratio", "hole_fraction", "circularity")


@query(f"WITH {METRICS} SELECT label, {PASS} AS passed FROM d")
def range_filter_passfail(spark, sf):
    return L.passed(L.derived(metrics(spark, sf)), RANGES).select("label", "passed")


@query(f"WITH {METRICS} SELECT {PASS} AS passed, count(*) AS n FROM d GROUP BY 1")
def passed_counts(spark, sf):
    return L.passed(L.derived(metrics(spark, sf)), RANGES).groupBy("passed").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey AS label, l_linenumber, (l_suppkey % 50 <= 0 OR l_partkey % 50 <= 0 OR l_suppkey % 50 + 5 >= 48 OR l_partkey % 50 + 5 >= 48) AS border_touch FROM lineitem""")
def border_touch(spark, sf):
    t = table(spark, sf, "lineitem").withColumns({"bbox_0": F.col("l_suppkey") % 50, "bbox_1": F.col("l_partkey") % 50, "bbox_2": F.col("l_suppkey") % 50 + 5, "bbox_3": F.col("l_partkey") % 50 + 5})
    one = F.lit(1.0)
    t = t.withColumns({c: one for c in ("area", "perimeter", "filled_area", "major_axis_length", "minor_axis_length")})
    return L.derived(t, 48, 48).select(F.col("l_orderkey").alias("label"), "l_linenumber", "border_touch")


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS code FROM orders")
def label_encode(spark, sf):
    return encode_labels(table(spark, sf, "orders"), "o_orderpriority").select("o_orderkey", "code")


TYPES = ("PT-S1/S2", "DCT", "CNT", "glomeruli", "PT-S3", "TAL", "collecting duct", "interstitial cells", "FR-PT", "not listed")


@query(f"""WITH {PTS} SELECT id, CASE WHEN label < 4 THEN 'cortex' WHEN label = 4 THEN 'outer_medulla' WHEN label IN (5, 6) THEN 'medulla' WHEN label = 7 THEN 'interstitial' WHEN label = 8 THEN 'injury' END AS zone FROM pts""")
def zone_map(spark, sf):
    kind = F.get(F.array(*[F.lit(t) for t in TYPES]), F.col("label"))
    return points(spark, sf).select("id", zone(kind).alias("zone"))


@query(f"WITH {PTS} SELECT id, round(max(y) OVER (PARTITION BY sample) - y, 6) + 0 AS y FROM pts")
def y_flip(spark, sf):
    return flip_y(points(spark, sf)).select("id", r6("y").alias("y"))


@query(f"WITH {PTS} SELECT id AS spot_id, round(x, 6) + 0 AS spot_x, round(y, 6) + 0 AS spot_y, sample, 'IRI' AS condition FROM pts")
def spot_schema(spark, sf):
    return as_spots(points(spark, sf)).select("spot_id", r6("spot_x").alias("spot_x"), r6("spot_y").alias("spot_y"), "sample", "condition")


@query(f"""WITH {DIMS} SELECT id, round(sum(CASE WHEN pos < 16 THEN val ELSE 0 END), 6) + 0 AS s16, round(sum(CASE WHEN pos >= 32 THEN val ELSE 0 END), 6) + 0 AS s64, CAST(48 AS INTEGER) AS width FROM dims GROUP BY id""")
def scale_slice(spark, sf):
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    block = {s: V.scale_block(F.col("v"), BLOCKS, s) for s in BLOCKS}
    return points(spark, sf).select("id", r6(total(block[16])).alias("s16"), r6(total(block[64])).alias("s64"), F.size(F.concat(block[16], block[64])).alias("width"))


@query(f"""WITH {DIMS}, n AS (SELECT id, sqrt(sum(val * val)) AS norm FROM dims GROUP BY id) SELECT id, pos, round(val / (norm + 1e-8), 6) + 0 AS val FROM dims JOIN n USING (id)""")
def l2_normalize(spark, sf):
    p = points(spark, sf).select("id", F.posexplode(V.l2_normalise(F.col("v"))).alias("pos", "val"))
    return p.select("id", F.col("pos").cast("bigint").alias("pos"), r6("val").alias("val"))


WEIGHTS_SQL = f"""{DIMS}, var AS (SELECT pos, var_pop(val) AS var FROM dims GROUP BY pos),
w0 AS (SELECT CASE WHEN pos < 16 THEN 16 WHEN pos < 32 THEN 32 ELSE 64 END AS scale, avg(var) AS spread FROM var GROUP BY 1),
w AS (SELECT scale, spread / sum(spread) OVER () AS weight FROM w0)"""


@query(f"WITH {WEIGHTS_SQL} SELECT scale, round(weight, 6) + 0 AS weight FROM w")
def scale_weights(spark, sf):
    return V.scale_weights(points(spark, sf), "v", BLOCKS).select("scale", r6("weight").alias("weight"))


@query(f"""WITH {WEIGHTS_SQL}, s AS (SELECT id, pos, val, CASE WHEN pos < 16 THEN 16 WHEN pos < 32 THEN 32 ELSE 64 END AS scale FROM dims),
n AS (SELECT id, scale, sqrt(sum(val * val)) AS norm FROM s GROUP BY id, scale),
f AS (SELECT s.id, pos, val / (norm + 1e-8) * weight AS val FROM s JOIN n ON s.id = n.id AND s.scale = n.scale JOIN w ON s.scale = w.scale),
t AS (SELECT id, sqrt(sum(val * val)) AS norm FROM f GROUP BY id) SELECT f.id, pos, round(val / (norm + 1e-8), 6) + 0 AS val FROM f JOIN t USING (id)""")
def weighted_fusion(spark, sf):
    f = V.weighted_fusion(points(spark, sf), "v", BLOCKS).select("id", F.posexplode("fused").alias("pos", "val"))
    return f.select("id", F.col("pos").cast("bigint").alias("pos"), r6("val").alias("val"))


@query(f"""WITH {DIMS} SELECT id, pos % 16 AS pos, round(avg(val), 6) + 0 AS mean, round(max(val), 6) + 0 AS most FROM dims WHERE pos < 32 GROUP BY id, pos % 16""")
def fusion_variants(spark, sf):
    blocks = [V.scale_block(F.col("v"), BLOCKS, s) for s in (16, 32)]
    both = F.arrays_zip(V.fuse(blocks, "average").alias("a"), V.fuse(blocks, "max").alias("b"))
    p = points(spark, sf).select("id", F.posexplode(both).alias("pos", "s"))
    return p.select("id", F.col("pos").cast("bigint").alias("pos"), r6(F.col("s")["a"]).alias("mean"), r6(F.col("s")["b"]).alias("most"))


@query(f"""WITH {DIMS}, f AS (SELECT pos, avg(val) AS mean, stddev_pop(val) AS std FROM dims GROUP BY pos) SELECT id, pos, round((val - mean) / CASE WHEN std > 0 THEN std ELSE 1 END, 6) + 0 AS z FROM dims JOIN f USING (pos)""")
def standardize(spark, sf):
    z = V.standardise(points(spark, sf), "v").select("id", F.posexplode("z").alias("pos", "z"))
    return z.select("id", F.col("pos").cast("bigint").alias("pos"), r6("z").alias("z"))


NEAREST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nucleus_id ORDER BY dist, spot_id) AS rn FROM p) WHERE rn = 1"
ASSIGNED = f"{SPOTS}, p AS (SELECT a.id AS nucleus_id, b.id AS spot_id, b.sample, {DIST} AS dist FROM nuclei a, spots b WHERE {DIST} <= {NEAR}), assigned AS ({NEAREST})"


def assigned(spark, sf):
    a = J.nearest(nuclei(spark, sf).select("id", "x", "y"), spots(spark, sf).select("id", "x", "y", "sample"), NEAR)
    return a.select(F.col("l_id").alias("nucleus_id"), F.col("r_id").alias("spot_id"), F.col("r_sample").alias("sample"), "dist")


@query(f"WITH {ASSIGNED} SELECT nucleus_id, spot_id, sample, round(dist, 6) + 0 AS dist FROM assigned")
def nearest_assign(spark, sf):
    return assigned(spark, sf).withColumn("dist", r6("dist"))


@query(f"""WITH {SPOTS}, p AS (SELECT a.id AS nucleus_id, b.id AS spot_id, a.sample, {DIST} AS dist FROM nuclei a JOIN spots b ON a.sample = b.sample WHERE {DIST} <= {NEAR})
SELECT sample, nucleus_id, spot_id, round(dist, 6) + 0 AS dist FROM ({NEAREST})""")
def nearest_in_sample(spark, sf):
    a = J.nearest_or_fail(nuclei(spark, sf).select("id", "x", "y", "sample"), spots(spark, sf).select("id", "x", "y", "sample"), NEAR, ["sample"])
    return a.select("sample", F.col("l_id").alias("nucleus_id"), F.col("r_id").alias("spot_id"), r6("dist").alias("dist"))


@query(f"""WITH {SPOTS}, p AS (SELECT b.id AS nucleus_id, a.id AS spot_id, a.sample, {DIST} AS dist FROM nuclei a JOIN spots b ON a.sample = b.sample WHERE {DIST} < {NEAR})
SELECT sample, nucleus_id AS spot_id, spot_id AS nucleus_id, round(dist, 6) + 0 AS dist FROM ({NEAREST})""")
def reverse_nearest_lt(spark, sf):
    a = J.nearest(spots(spark, sf).select("id", "x", "y", "sample"), nuclei(spark, sf).select("id", "x", "y", "sample"), NEAR, ["sample"], strict=True)
    return a.select("sample", F.col("l_id").alias("spot_id"), F.col("r_id").alias("nucleus_id"), r6("dist").alias("dist"))


VOTES = f"""{SPOTS}, pairs AS (SELECT a.id, b.label AS c FROM spots a JOIN nuclei b ON a.sample = b.sample WHERE {DIST} <= {RADIUS}),
v AS (SELECT id, c, count(*) AS n FROM pairs GROUP BY id, c),
top AS (SELECT id, c, sum(n) OVER (PARTITION BY id) AS total, row_number() OVER (PARTITION BY id ORDER BY n DESC, c) AS rn FROM v),
votes AS (SELECT s.id, s.sample, s.label, CAST(coalesce(c, -1) AS INTEGER) AS vote, CAST(coalesce(total, 0) AS BIGINT) AS n_nuclei FROM spots s LEFT JOIN top t ON s.id = t.id AND rn = 1)"""


def voted(spark, sf):
    n = nuclei(spark, sf).withColumnRenamed("label", "cluster")
    return J.majority_vote(spots(spark, sf).drop("v"), n, RADIUS, ["sample"])


@query(f"WITH {VOTES} SELECT id, sample, vote, n_nuclei FROM votes")
def radius_majority_vote(spark, sf):
    return voted(spark, sf).select("id", "sample", "vote", "n_nuclei")


AGREE = """tot AS (SELECT g, CAST(sum(n) AS DOUBLE) AS t FROM cells GROUP BY g), ma AS (SELECT g, a, CAST(sum(n) AS DOUBLE) AS n FROM cells GROUP BY g, a), mb AS (SELECT g, b, CAST(sum(n) AS DOUBLE) AS n FROM cells GROUP BY g, b),
ia AS (SELECT g, sum(n * (n - 1) / CAST(2 AS DOUBLE)) AS s, -sum(n / t * ln(n / t)) AS h, count(*) AS k FROM ma JOIN tot USING (g) GROUP BY g),
ib AS (SELECT g, sum(n * (n - 1) / CAST(2 AS DOUBLE)) AS s, -sum(n / t * ln(n / t)) AS h, count(*) AS k FROM mb JOIN tot USING (g) GROUP BY g),
ii AS (SELECT c.g, sum(CAST(c.n AS DOUBLE) * (c.n - 1) / CAST(2 AS DOUBLE)) AS s, sum(c.n / t * ln((c.n / t) / ((ma.n / t) * (mb.n / t)))) AS mi, sum(CASE WHEN c.a = c.b THEN c.n / t ELSE 0 END) AS po
  FROM cells c JOIN tot ON tot.g = c.g JOIN ma ON ma.g = c.g AND ma.a = c.a JOIN mb ON mb.g = c.g AND mb.b = c.b GROUP BY c.g),
pe AS (SELECT ma.g, sum(ma.n / t * (mb.n / t)) AS pe FROM ma JOIN mb ON ma.g = mb.g AND ma.a = mb.b JOIN tot ON tot.g = ma.g GROUP BY ma.g),
res AS (SELECT tot.g, CAST(t AS BIGINT) AS n, ia.k AS n_a, ib.k AS n_b, coalesce((ii.s - ia.s * ib.s / nullif(t * (t - 1) / 2, 0)) / nullif((ia.s + ib.s) / 2 - ia.s * ib.s / nullif(t * (t - 1) / 2, 0), 0), 1) AS ari,
  CASE WHEN ia.k = 1 AND ib.k = 1 THEN 1 WHEN mi <= 1e-15 THEN 0 ELSE mi / ((ia.h + ib.h) / 2) END AS nmi, po AS accuracy, coalesce((po - coalesce(pe, 0)) / nullif(1 - coalesce(pe, 0), 0), 1) AS kappa
  FROM tot JOIN ia USING (g) JOIN ib USING (g) JOIN ii USING (g) LEFT JOIN pe USING (g))"""
AGREE_OUT = "CAST(n AS BIGINT) AS n, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, round(ari, 6) + 0 AS ari, round(nmi, 6) + 0 AS nmi, round(accuracy, 6) + 0 AS accuracy, round(kappa, 6) + 0 AS kappa FROM res"


def agreement_out(df, *keys):
    return df.select(*keys, "n", F.col("n_a").cast("bigint").alias("n_a"), F.col("n_b").cast("bigint").alias("n_b"), *[r6(c).alias(c) for c in ("ari", "nmi", "accuracy", "kappa")])


@query(f"WITH {VOTES}, cells AS (SELECT sample AS g, vote AS a, label AS b, count(*) AS n FROM votes WHERE vote >= 0 GROUP BY 1, 2, 3), {AGREE} SELECT g AS sample, {AGREE_OUT}")
def sample_agreement(spark, sf):
    """Radius join, majority vote, contingency table, agreement per sample."""
    return agreement_out(agreement(voted(spark, sf).filter("vote >= 0"), "vote", "label", ["sample"]), "sample")


@query(f"""WITH {VOTES}, z AS (SELECT sample, vote, CASE WHEN label < 4 THEN 'cortex' WHEN label = 4 THEN 'outer_medulla' WHEN label IN (5, 6) THEN 'medulla' WHEN label = 7 THEN 'interstitial' WHEN label = 8 THEN 'injury' END AS zone, n_nuclei FROM votes WHERE vote >= 0),
cells AS (SELECT sample AS g, CAST(vote AS VARCHAR) AS a, zone AS b, count(*) AS n FROM z WHERE zone IS NOT NULL GROUP BY 1, 2, 3), {AGREE}, per AS (SELECT sample, count(*) AS m, avg(n_nuclei) AS mean_n FROM z WHERE zone IS NOT NULL GROUP BY sample)
SELECT CAST(sum(m) AS BIGINT) AS n_matched, round(avg(mean_n), 6) + 0 AS mean_nuclei, round(avg(ari), 6) + 0 AS ari, round(avg(nmi), 6) + 0 AS nmi FROM res JOIN per ON res.g = per.sample WHERE m >= 10""")
def zone_agreement_overall(spark, sf):
    """Agreement with zones per sample of at least ten matches, then the plain mean over samples."""
    kind = F.get(F.array(*[F.lit(t) for t in TYPES]), F.col("label"))
    v = voted(spark, sf).filter("vote >= 0").withColumn("zone", zone(kind)).dropna(subset=["zone"])
    v = L.large_groups(v, ["sample"], 10).withColumn("vote", F.col("vote").cast("string"))
    per = v.groupBy("sample").agg(F.count("*").alias("m"), F.avg("n_nuclei").alias("mean_n"))
    a = agreement(v, "vote", "zone", ["sample"]).join(per, "sample")
    return a.agg(F.sum("m").alias("n_matched"), r6(F.avg("mean_n")).alias("mean_nuclei"), r6(F.avg("ari")).alias("ari"), r6(F.avg("nmi")).alias("nmi"))


BOXES = f"""{PTS}, box AS (SELECT sample, avg(x) - stddev_pop(x) AS x0, avg(x) + stddev_pop(x) AS x1, avg(y) - stddev_pop(y) AS y0, avg(y) + stddev_pop(y) AS y1, row_number() OVER (ORDER BY sample) AS ord FROM pts GROUP BY sample),
pb AS (SELECT p.id, b.sample, ord, x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AS inside, sqrt((x - (x0 + x1) / 2) * (x - (x0 + x1) / 2) + (y - (y0 + y1) / 2) * (y - (y0 + y1) / 2)) AS dist FROM pts p, box b)"""


def boxes(spark, sf):
    """A box per sample: a deviation each way around the mean of its points."""
    sides = [(F.avg(c) + sign * F.stddev_pop(c)).alias(f"{c}_{side}") for c in "xy" for side, sign in (("min", -1), ("max", 1))]
    return points(spark, sf).groupBy("sample").agg(*sides).withColumn("ord", F.row_number().over(Window.orderBy("sample")))


@query(f"""WITH {BOXES}, i AS (SELECT id, max_by(sample, ord) AS s FROM pb WHERE inside GROUP BY id), c AS (SELECT id, sample AS s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, ord) AS rn FROM pb) WHERE rn = 1)
SELECT c.id, coalesce(i.s, c.s) AS assigned FROM c LEFT JOIN i USING (id)""")
def bbox_assign_last_wins(spark, sf):
    return J.assign_boxes(points(spark, sf), boxes(spark, sf)).select("id", "assigned")


@query(f"""WITH {BOXES}, i AS (SELECT id, sample AS s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, ord) AS rn FROM pb WHERE inside) WHERE rn = 1), c AS (SELECT id, sample AS s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, ord) AS rn FROM pb) WHERE rn = 1)
SELECT c.id, coalesce(i.s, c.s) AS assigned FROM c LEFT JOIN i USING (id)""")
def bbox_assign_nearest(spark, sf):
    return J.assign_boxes(points(spark, sf), boxes(spark, sf), overlap="nearest").select("id", "assigned")


KNN = f"knn AS (SELECT * FROM (SELECT a.sample, a.id AS i, b.id AS j, {DIST} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) AS rank FROM pts a JOIN pts b ON a.sample = b.sample AND a.id <> b.id) WHERE rank <= 8)"


@query(f"WITH {PTS}, {KNN} SELECT sample, i, j, round(dist, 6) + 0 AS dist, CAST(rank AS BIGINT) AS rank, round(CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY i), 6) + 0 AS w FROM knn")
def knn_edges(spark, sf):
    e = J.knn_edges(points(spark, sf), 8)
    return e.select("sample", "i", "j", r6("dist").alias("dist"), F.col("rank").cast("bigint").alias("rank"), r6("w").alias("w"))


@query(f"WITH {PTS} SELECT a.sample, a.id AS i, b.id AS j, round({DIST}, 6) + 0 AS dist, round(CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY a.id), 6) + 0 AS w FROM pts a JOIN pts b ON a.sample = b.sample WHERE {DIST} > 0 AND {DIST} <= {RADIUS}")
def band_edges(spark, sf):
    e = J.band_edges(points(spark, sf), RADIUS)
    return e.select("sample", "i", "j", r6("dist").alias("dist"), r6("w").alias("w"))


@query()
def delaunay_edges(spark, sf):
    return J.delaunay_edges(points(spark, sf)).withColumn("w", r6("w"))


def _spot_features(method):
    def run(spark, sf):
        f = A.spot_features(assigned(spark, sf), points(spark, sf).select(F.col("id").alias("nucleus_id"), "v"), method, 2, ("sample",))
        f = f.select("spot_id", "sample", "n_nuclei", r6("mean_distance").alias("mean_distance"), F.posexplode("agg").alias("pos", "val"))
        return f.withColumn("pos", F.col("pos").cast("bigint")).withColumn("val", r6("val"))

    return run


for _name, _method, _agg in (("spot_mean", "mean", "avg"), ("spot_median", "median", "median"), ("spot_max", "max", "max")):
    _run = _spot_features(_method)
    _run.__name__ = _name
    query(f"""WITH {ASSIGNED}, d AS (SELECT id, unnest(range(64)) AS pos, CAST(unnest(v) AS DOUBLE) AS val FROM pts), s AS (SELECT spot_id, min_by(sample, nucleus_id) AS sample, count(*) AS n_nuclei, avg(dist) AS md FROM assigned GROUP BY spot_id HAVING count(*) >= 2)
    SELECT s.spot_id, s.sample, s.n_nuclei, round(md, 6) + 0 AS mean_distance, pos, round({_agg}(val), 6) + 0 AS val FROM s JOIN assigned a ON a.spot_id = s.spot_id JOIN d ON d.id = a.nucleus_id GROUP BY s.spot_id, s.sample, s.n_nuclei, md, pos""")(_run)


@query(f"""WITH {ASSIGNED}, t AS (SELECT unnest([CAST(20 AS DOUBLE), 40, 60, 80]) AS threshold), n AS (SELECT threshold, count(CASE WHEN dist <= threshold THEN 1 END) AS n, CAST(count(CASE WHEN dist <= threshold THEN 1 END) AS DOUBLE) / count(*) AS share FROM t, assigned GROUP BY threshold)
SELECT threshold, n, round(share, 6) + 0 AS share, coalesce(threshold = min(CASE WHEN share >= 0.8e0 THEN threshold END) OVER (), false) AS chosen FROM n""")
def success_by_distance(spark, sf):
    return A.success_by_distance(assigned(spark, sf), (20, 40, 60, 80)).withColumn("share", r6("share"))


@query(f"""WITH {ASSIGNED}, r AS (SELECT min(dist) AS lo, max(dist) AS hi FROM assigned), b AS (SELECT least(49, CAST(floor((dist - lo) / nullif(hi - lo, 0) * 50) AS BIGINT)) AS bin FROM assigned, r) SELECT bin, count(*) AS n FROM b GROUP BY bin""")
def distance_histogram(spark, sf):
    return A.histogram(assigned(spark, sf), "dist", 50).select("bin", "n")


@query(f"""WITH {METRICS} SELECT 'area' AS metric, CAST(count(CASE WHEN area NOT BETWEEN 5 AND 45 THEN 1 END) AS BIGINT) AS n_outside, CAST(count(CASE WHEN area IS NULL THEN 1 END) AS BIGINT) AS n_missing FROM d UNION ALL
SELECT 'circularity', count(CASE WHEN circularity NOT BETWEEN 0.2e0 AND 1 THEN 1 END), count(CASE WHEN circularity IS NULL THEN 1 END) FROM d UNION ALL
SELECT 'solidity', count(CASE WHEN solidity NOT BETWEEN 0.93e0 AND 1 THEN 1 END), count(CASE WHEN solidity IS NULL THEN 1 END) FROM d UNION ALL
SELECT 'eccentricity', count(CASE WHEN eccentricity NOT BETWEEN 0 AND 0.9e0 THEN 1 END), count(CASE WHEN eccentricity IS NULL THEN 1 END) FROM d UNION ALL
SELECT 'aspect_ratio', count(CASE WHEN aspect_ratio NOT BETWEEN 0 AND 3 THEN 1 END), count(CASE WHEN aspect_ratio IS NULL THEN 1 END) FROM d UNION ALL
SELECT 'hole_fraction', count(CASE WHEN hole_fraction NOT BETWEEN 0 AND 0.07e0 THEN 1 END), count(CASE WHEN hole_fraction IS NULL THEN 1 END) FROM d""")
def excluded_counts(spark, sf):
    return L.excluded_counts(L.derived(metrics(spark, sf)), RANGES)


@query("""WITH n(configuration) AS (SELECT * FROM (VALUES ('run_16_32_64px'), ('run_16_32px'), ('run_32_64px'), ('run_16px'), ('run_32px'), ('run_64px'), ('plain')) t)
SELECT configuration, CASE WHEN configuration LIKE '%16_32_64px' THEN 37 WHEN configuration LIKE '%16_32px' THEN 24 WHEN configuration LIKE '%32_64px' THEN 48 WHEN configuration LIKE '%_16px' THEN 16 WHEN configuration LIKE '%_64px' THEN 64 ELSE 32 END AS primary_size,
CAST(CASE WHEN configuration LIKE '%16_32_64px' THEN 3 WHEN configuration LIKE '%16_32px' OR configuration LIKE '%32_64px' THEN 2 ELSE 1 END AS INTEGER) AS n_sizes FROM n""")
def configuration_names(spark, sf):
    names = [("run_16_32_64px",), ("run_16_32px",), ("run_32_64px",), ("run_16px",), ("run_32px",), ("run_64px",), ("plain",)]
    p = spark.createDataFrame(names, "configuration string").withColumn("p", patch_sizes(F.col("configuration")))
    return p.select("configuration", "p.primary_size", F.size("p.sizes").alias("n_sizes"))


@query(f"WITH {PTS} SELECT id, CAST(row_number() OVER (ORDER BY y, x) - 1 AS BIGINT) AS place FROM pts")
def positional_ids(spark, sf):
    return with_ids(points(spark, sf).select("id", "x", "y"), ["y", "x"], "place").select("id", "place")
