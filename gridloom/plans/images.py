"""Queries of raster operators and colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import colors as K
from gridloom.operators import filters as L
from gridloom.operators import raster as I
from gridloom.plans.base import PIX, PIXEL_COLS, PIXEL_ROWS, PTS, pixels, points, query, r6, table


@query("SELECT CAST(ty * 7 + tx AS BIGINT) AS tile, CAST(ty AS INTEGER) AS tile_y, CAST(tx AS INTEGER) AS tile_x, CAST(ty * 32 + 32 AS INTEGER) AS y_center, CAST(tx * 32 + 32 AS INTEGER) AS x_center FROM range(5) a(ty), range(7) b(tx)")
def tile_grid(spark, sf):
    return I.tile_grid(spark, 200, 150, 32, 64)


@query(f"""WITH {PIX}, t AS (SELECT CAST(y // 20 AS INTEGER) AS tile_y, CAST(x // 20 AS INTEGER) AS tile_x, v FROM pix) SELECT tile_y, tile_x, CAST(sum(v) AS DOUBLE) AS total, CAST(400 AS INTEGER) AS n FROM t GROUP BY 1, 2""")
def padded_tiles(spark, sf):
    t = I.tile_pixels(pixels(spark, sf), 20, 20)
    return t.select("tile_y", "tile_x", F.aggregate("data", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("data").alias("n"))


@query(f"""WITH {PIX}, s AS (SELECT c AS id, 8 * c - 1.5e0 + i AS sy, 10 * c - 1.5e0 + j AS sx, i, j FROM range(7) a(c), range(4) b(i), range(4) d(j)),
k AS (SELECT id, i, j, CAST(floor(sy) + a AS BIGINT) AS y, CAST(floor(sx) + b AS BIGINT) AS x, (CASE WHEN a = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE WHEN b = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) AS w FROM s, range(2) e(a), range(2) f(b))
SELECT id, i * 4 + j AS pos, round(sum(w * coalesce(v, 0)), 6) + 0 AS val FROM k LEFT JOIN pix ON k.y = pix.y AND k.x = pix.x GROUP BY 1, 2""")
def bilinear_crops(spark, sf):
    c = spark.range(7).select("id", (F.col("id") * 8).cast("double").alias("y"), (F.col("id") * 10).cast("double").alias("x"))
    out = I.crops(pixels(spark, sf), c, 4).select("id", F.posexplode("data").alias("pos", "val"))
    return out.select("id", F.col("pos").cast("bigint").alias("pos"), r6("val").alias("val"))


LUT = "c AS (SELECT label, max_by(vec_id % 4, vec_id) AS cluster FROM embeddings GROUP BY label)"


def lut_clusters(spark, sf):
    return table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 4).alias("cluster"), F.col("vec_id").alias("ord"))


@query(f"WITH {PIX}, {LUT} SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(CASE WHEN pix.label > 0 THEN coalesce(cluster + 1, 0) ELSE 0 END AS BIGINT) AS lut FROM pix LEFT JOIN c ON pix.label = c.label")
def lut_recolor(spark, sf):
    return I.recolor(pixels(spark, sf), lut_clusters(spark, sf)).select("y", "x", F.col("lut").cast("bigint").alias("lut"))


def _mix(color: str, alpha: str) -> str:
    return f"least(255, greatest(0, CAST(trunc(CAST(v AS DOUBLE) * (1 - {alpha}) + ({color}) * {alpha}) AS INTEGER)))"


@query(f"""WITH {PIX} SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {', '.join(f"CASE WHEN label > 0 THEN {_mix(c, '0.5e0')} ELSE CAST(v AS INTEGER) END AS {n}" for n, c in (("r", "CASE label % 4 WHEN 0 THEN 255 WHEN 3 THEN 255 ELSE 0 END"), ("g", "CASE label % 4 WHEN 1 THEN 255 WHEN 2 THEN 128 ELSE 0 END"), ("b", "CASE label % 4 WHEN 2 THEN 255 WHEN 3 THEN 255 ELSE 0 END")))} FROM pix""")
def alpha_blend(spark, sf):
    p = pixels(spark, sf)
    return I.overlay(p.select("y", "x", "v"), p.select("y", "x", "label"), K.palette_table(spark, K.palette(4)), 4, 0.5)


@query(f"""WITH {PIX} SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {', '.join(f"CASE WHEN label > 0 THEN {_mix(c, '0.35e0')} ELSE CAST(v AS INTEGER) END AS {n}" for n, c in (("r", "CASE WHEN label % 2 = 0 THEN 0 ELSE 255 END"), ("g", "CASE WHEN label % 2 = 0 THEN 255 ELSE 0 END"), ("b", "0")))} FROM pix""")
def pass_overlay(spark, sf):
    p = pixels(spark, sf)
    return I.pass_overlay(p.select("y", "x", "v"), p.select("y", "x", "label"), spark.range(0, 30, 2).select(F.col("id").cast("int").alias("label")))


TILES = "t AS (SELECT id AS tile, 3 + (id * 7) % 40 AS yc, 2 + (id * 11) % 60 AS xc, id % 5 AS cluster FROM range(30) r(id))"


@query(f"""WITH {TILES}, p AS (SELECT tile, cluster, yc - 4 + dy AS y, xc - 4 + dx AS x FROM t, range(8) a(dy), range(8) b(dx) WHERE yc - 4 >= 0 AND xc - 4 >= 0 AND yc + 4 <= {PIXEL_ROWS} AND xc + 4 <= {PIXEL_COLS}) SELECT CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, max_by(cluster, tile) AS cluster FROM p GROUP BY 1, 2""")
def tile_overlay(spark, sf):
    i = F.col("id")
    t = spark.range(30).select(i.alias("tile"), (3 + (i * 7) % 40).alias("y_center"), (2 + (i * 11) % 60).alias("x_center"), (i % 5).alias("cluster"))
    return I.tile_overlay(t, 8, PIXEL_ROWS, PIXEL_COLS)


STACK = "s AS (SELECT p AS plane, y, x, (x + y + p * 3) % 7 < 2 AS v FROM range(4) a(p), range(24) b(y), range(24) c(x))"


def stack(spark):
    i = F.col("id")
    s = spark.range(4 * 576).select(F.floor(i / 576).cast("int").alias("plane"), F.floor(i % 576 / 24).cast("int").alias("y"), (i % 24).cast("int").alias("x"))
    return s.withColumn("v", (F.col("x") + F.col("y") + F.col("plane") * 3) % 7 < 2)


@query(f"WITH {STACK} SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(max(plane) + 1 AS INTEGER) AS label FROM s WHERE v GROUP BY 1, 2")
def packed_planes(spark, sf):
    return I.pack_planes(stack(spark))


@query(f"WITH {STACK} SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, bool_or(v) AS v FROM s GROUP BY 1, 2")
def any_plane(spark, sf):
    return I.any_plane(stack(spark))


@query(f"WITH {PIX} SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(CASE WHEN label > 0 THEN 255 ELSE 0 END AS INTEGER) AS v FROM pix")
def binary_image(spark, sf):
    return I.binary(pixels(spark, sf))


@query(f"WITH {PIX} SELECT CAST(y // 16 AS BIGINT) AS tile, round(sum(v / CAST(m AS DOUBLE) * 255), 4) + 0 AS total FROM (SELECT *, max(v) OVER (PARTITION BY y // 16) AS m FROM pix) GROUP BY 1")
def tile_intensity(spark, sf):
    p = pixels(spark, sf).withColumn("tile", F.floor(F.col("y") / 16))
    return I.normalise_intensity(p, ["tile"]).groupBy("tile").agg((F.round(F.sum("v"), 4) + 0).alias("total"))


@query(f"WITH {PIX} SELECT round(sum(v / CAST((SELECT max(v) FROM pix) AS DOUBLE) * 255), 4) + 0 AS total FROM pix")
def image_intensity(spark, sf):
    return I.normalise_intensity(pixels(spark, sf)).agg((F.round(F.sum("v"), 4) + 0).alias("total"))


@query(f"WITH {PIX} SELECT CAST(label AS INTEGER) AS label, CAST(trunc(avg(x)) AS INTEGER) AS x_center, CAST(trunc(avg(y)) AS INTEGER) AS y_center FROM pix WHERE label <> 0 GROUP BY label")
def centroids(spark, sf):
    return I.centroids(pixels(spark, sf))


@query(f"WITH {PIX}, w AS (SELECT i AS ord, 22 - 3 * i AS label FROM range(7) r(i)) SELECT CAST(ord AS BIGINT) AS ord, CAST(w.label AS INTEGER) AS label, CAST(round_even(avg(x), 0) AS INTEGER) AS x_center, CAST(round_even(avg(y), 0) AS INTEGER) AS y_center FROM w JOIN pix ON w.label = pix.label GROUP BY ord, w.label")
def wanted_centroids(spark, sf):
    w = spark.range(7).select(F.col("id").alias("ord"), (22 - 3 * F.col("id")).cast("int").alias("label"))
    return I.centroids_of(pixels(spark, sf), w)


@query(f"""WITH {PIX}, m AS (SELECT label, count(*) AS area, min(y) AS bbox_0, min(x) AS bbox_1, max(y) + 1 AS bbox_2, max(x) + 1 AS bbox_3, var_pop(y) AS vy, var_pop(x) AS vx, covar_pop(y, x) AS c, avg(v) AS mean_intensity FROM pix WHERE label <> 0 GROUP BY label),
e AS (SELECT *, (vy + vx + sqrt((vy - vx) * (vy - vx) + 4 * c * c)) / 2 AS l1, greatest(0, (vy + vx - sqrt((vy - vx) * (vy - vx) + 4 * c * c)) / 2) AS l2 FROM m)
SELECT CAST(label AS INTEGER) AS label, area, CAST(bbox_0 AS INTEGER) AS bbox_0, CAST(bbox_1 AS INTEGER) AS bbox_1, CAST(bbox_2 AS INTEGER) AS bbox_2, CAST(bbox_3 AS INTEGER) AS bbox_3, round(4 * sqrt(l1), 6) + 0 AS major_axis_length, round(4 * sqrt(l2), 6) + 0 AS minor_axis_length, round(mean_intensity, 6) + 0 AS mean_intensity FROM e""")
def region_moments(spark, sf):
    m = I.moments(pixels(spark, sf), "v")
    return m.select("label", "area", "bbox_0", "bbox_1", "bbox_2", "bbox_3", *[r6(c).alias(c) for c in ("major_axis_length", "minor_axis_length", "mean_intensity")])


@query()
def region_shapes(spark, sf):
    """Perimeter, solidity and filled area of each label."""
    return I.shapes(pixels(spark, sf))


@query(f"WITH {PIX} SELECT CAST(max(label) AS INTEGER) AS max_label FROM pix")
def max_label(spark, sf):
    return I.max_label(pixels(spark, sf))


@query(f"WITH {PIX} SELECT count(*) AS n, CAST(min(y) AS INTEGER) AS y0, CAST(max(y) AS INTEGER) AS y1, CAST(min(x) AS INTEGER) AS x0, CAST(max(x) AS INTEGER) AS x1 FROM pix WHERE y >= 12 AND y < 36 AND x >= 16 AND x < 48")
def cropped(spark, sf):
    return L.crop(pixels(spark, sf), (0.25, 0.75, 0.25, 0.75), PIXEL_ROWS, PIXEL_COLS).agg(F.count("*").alias("n"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


@query(f"""WITH {PTS}, r AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts), n AS (SELECT *, CAST(ceil((x1 + 50 - x0) / 50) AS BIGINT) AS nx, CAST(ceil((y1 + 50 - y0) / 50) AS BIGINT) AS ny FROM r)
SELECT i * ny + j AS spot_id, round(x0 + i * 50, 6) + 0 AS x, round(y0 + j * 50, 6) + 0 AS y FROM n, range(1000) a(i), range(1000) b(j) WHERE i < nx AND j < ny""")
def synthetic_spots(spark, sf):
    s = I.synthetic_spots(points(spark, sf), 50, ["S0", "S1", "S2"])
    return s.select("spot_id", r6("x").alias("x"), r6("y").alias("y"))


LIN = "CASE WHEN {0} / 255.0e0 <= 0.04045e0 THEN {0} / 255.0e0 / 12.92e0 ELSE power(({0} / 255.0e0 + 0.055e0) / 1.055e0, 2.4e0) END"
LUM = f"0.2126e0 * {LIN.format('r')} + 0.7152e0 * {LIN.format('g')} + 0.0722e0 * {LIN.format('b')}"


@query(f"""WITH c AS (SELECT p_partkey, p_partkey % 256 AS r, (p_partkey * 7) % 256 AS g, (p_partkey * 13) % 256 AS b FROM part), l AS (SELECT *, {LUM} AS lum FROM c)
SELECT p_partkey, round(lum, 6) + 0 AS luminance, round((lum + 0.05e0) / 0.05e0, 6) + 0 AS contrast, printf('#%02x%02x%02x', r, g, b) AS hex FROM l""")
def luminance_contrast(spark, sf):
    k = F.col("p_partkey")
    c = table(spark, sf, "part").select("p_partkey", (k % 256).alias("r"), (k * 7 % 256).alias("g"), (k * 13 % 256).alias("b"))
    c = c.withColumn("lum", K.luminance_column(F.col("r"), F.col("g"), F.col("b")))
    return c.select("p_partkey", r6("lum").alias("luminance"), r6(K.contrast_column(F.col("lum"), F.lit(0.0))).alias("contrast"), K.hex_column(F.col("r"), F.col("g"), F.col("b")).alias("hex"))


@query("SELECT p_partkey, CAST(p_partkey % 256 AS INTEGER) AS r, CAST((p_partkey * 7) % 256 AS INTEGER) AS g, CAST((p_partkey * 13) % 256 AS INTEGER) AS b FROM part")
def hex_parse(spark, sf):
    k = F.col("p_partkey")
    code = K.hex_column(k % 256, k * 7 % 256, k * 13 % 256)
    return table(spark, sf, "part").select("p_partkey", *[c.alias(n) for n, c in zip("rgb", K.rgb_columns(code), strict=True)])


def _hsl(offset: int) -> str:
    k = f"(({offset} + h * 12) % 12)"
    return f"CAST(floor((0.4e0 - 0.8e0 * least(0.4e0, 1 - 0.4e0) * greatest(-1, least({k} - 3, least(9 - {k}, 1)))) * 255 + 1e-9) AS INTEGER)"


@query(f"WITH c AS (SELECT p_partkey, CAST(p_partkey % 97 AS DOUBLE) / 97 AS h FROM part) SELECT p_partkey, {_hsl(0)} AS r, {_hsl(8)} AS g, {_hsl(4)} AS b FROM c")
def hsl_to_rgb(spark, sf):
    h = (F.col("p_partkey") % 97).cast("double") / 97
    r, g, b = K.hsl_columns(h, F.lit(0.8), F.lit(0.4))
    return table(spark, sf, "part").select("p_partkey", r.alias("r"), g.alias("g"), b.alias("b"))


@query(f"WITH {PIX} SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, v AS r, CASE WHEN x % 2 = 0 THEN v ELSE y END AS g, CASE WHEN x % 2 = 0 THEN v ELSE x END AS b FROM pix")
def rgb_coerced(spark, sf):
    """Gray pixels three times, and the first three of four channels."""
    c = F.when(F.col("x") % 2 == 0, F.array("v")).otherwise(F.array("v", F.col("y").cast("bigint"), F.col("x").cast("bigint"), F.lit(0).cast("bigint")))
    p = pixels(spark, sf).select("y", "x", I.to_rgb(c).alias("c"))
    return p.select("y", "x", *[F.col("c")[i].alias(n) for i, n in enumerate("rgb")])


@query()
def palette(spark, sf):
    return K.palette_table(spark, K.palette(30))


@query()
def label_colors(spark, sf):
    r, g, b = K.label_colors(F.col("label"))
    return pixels(spark, sf).select("label").distinct().select("label", r.alias("r"), g.alias("g"), b.alias("b"))


@query()
def embedded_crops(spark, sf):
    """Vectors of crops by the stand-in model."""
    c = spark.range(7).select("id", (F.col("id") * 8).cast("double").alias("y"), (F.col("id") * 10).cast("double").alias("x"))
    return I.embed(I.crops(pixels(spark, sf), c, 4), I.mean_pool(4)).select("id", "v")
