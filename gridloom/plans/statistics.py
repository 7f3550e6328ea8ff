"""Queries of aggregates, agreement, spatial statistics, clustering quality and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import aggregates as A
from gridloom.operators import clustering as C
from gridloom.operators import filters as L
from gridloom.operators import spatial as S
from gridloom.operators.agreement import agreement, ari_bootstrap, band_by_strength, band_by_thirds, cramers_v, nmi_permutation
from gridloom.operators.joins import knn_edges
from gridloom.plans import ranking as R
from gridloom.plans.base import DIMS, DIST, PTS, SPOTS, nuclei, points, query, r6, spots, table
from gridloom.plans.matching import AGREE, AGREE_OUT, KNN, VOTES, agreement_out, voted
from gridloom.sources.writers import cluster_statistics as size_table
from gridloom.sources.writers import metric_rows

BOUNDS = "min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max"
WIDTH = HEIGHT = 400.0


def shifted(spark, sf):
    """Points moved so that all coordinates are in a frame of WIDTH by HEIGHT around its middle."""
    p = points(spark, sf)
    return p.withColumn("x", F.col("x") + WIDTH / 2).withColumn("y", F.col("y") + HEIGHT / 2)


@query(f"WITH {PTS} SELECT sample, round(min(x), 6) + 0 AS x_min, round(max(x), 6) + 0 AS x_max, round(min(y), 6) + 0 AS y_min, round(max(y), 6) + 0 AS y_max, round((min(x) + max(x)) / 2, 6) + 0 AS x_center, round((min(y) + max(y)) / 2, 6) + 0 AS y_center, count(*) AS n_points FROM pts GROUP BY sample")
def sample_bounds(spark, sf):
    b = A.bounds(points(spark, sf))
    return b.select("sample", *[r6(c).alias(c) for c in ("x_min", "x_max", "y_min", "y_max", "x_center", "y_center")], "n_points")


@query(f"""WITH {SPOTS}, a AS (SELECT sample, {BOUNDS} FROM nuclei GROUP BY sample), b AS (SELECT sample, {BOUNDS} FROM spots GROUP BY sample),
o AS (SELECT a.sample, greatest(0, least(a.x_max, b.x_max) - greatest(a.x_min, b.x_min)) AS xo, greatest(0, least(a.y_max, b.y_max) - greatest(a.y_min, b.y_min)) AS yo, greatest(a.x_max - a.x_min, b.x_max - b.x_min) AS xm, greatest(a.y_max - a.y_min, b.y_max - b.y_min) AS ym FROM a JOIN b USING (sample))
SELECT sample, round(xo, 6) + 0 AS x_overlap, round(yo, 6) + 0 AS y_overlap, round(CASE WHEN xm > 0 THEN xo / xm * 100 ELSE 0 END, 6) + 0 AS x_pct, round(CASE WHEN ym > 0 THEN yo / ym * 100 ELSE 0 END, 6) + 0 AS y_pct,
 CASE WHEN xm > 0 THEN xo / xm * 100 ELSE 0 END > 50 AND CASE WHEN ym > 0 THEN yo / ym * 100 ELSE 0 END > 50 AS good FROM o""")
def coord_overlap(spark, sf):
    o = A.coordinate_overlap(nuclei(spark, sf), spots(spark, sf))
    return o.select("sample", *[r6(c).alias(c) for c in ("x_overlap", "y_overlap", "x_pct", "y_pct")], "good")


@query(f"WITH {SPOTS} SELECT round((SELECT max(x) - min(x) FROM nuclei) / (SELECT max(x) - min(x) FROM spots), 6) + 0 AS x_ratio, round((SELECT max(y) - min(y) FROM nuclei) / (SELECT max(y) - min(y) FROM spots), 6) + 0 AS y_ratio")
def scale_ratios(spark, sf):
    return A.scale_ratios(nuclei(spark, sf), spots(spark, sf)).select(r6("x_ratio").alias("x_ratio"), r6("y_ratio").alias("y_ratio"))


@query("SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY 1, 2")
def contingency(spark, sf):
    return A.contingency(table(spark, sf, "labels"), "quality", "toxic")


@query("WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY 1, 2) SELECT a, b, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY a), 6) + 0 AS share FROM c")
def row_proportions(spark, sf):
    return A.row_proportions(A.contingency(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")).withColumn("share", r6("share"))


@query("""WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rn, CAST(sum(n) OVER (PARTITION BY a) AS BIGINT) AS total FROM c)
SELECT a, total, b AS best_b, n AS best_n, round(CAST(n AS DOUBLE) / total, 6) + 0 AS fraction FROM r WHERE rn = 1""")
def best_match(spark, sf):
    return A.best_match(A.contingency(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")).withColumn("fraction", r6("fraction"))


@query(f"WITH cells AS (SELECT 0 AS g, quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY 2, 3), {AGREE} SELECT {AGREE_OUT}")
def label_agreement(spark, sf):
    return agreement_out(agreement(table(spark, sf, "labels"), "quality", "toxic"))


@query(f"""WITH {VOTES}, cells AS (SELECT coalesce(sample, 'all') AS g, vote AS a, label AS b, count(*) AS n FROM votes WHERE vote >= 0 GROUP BY GROUPING SETS ((sample, vote, label), (vote, label))), {AGREE}
SELECT g AS part, {AGREE_OUT} WHERE g = 'all' OR n > 10""")
def pooled_and_per_sample(spark, sf):
    """Agreement of all rows together, and of each sample with more than ten."""
    v = voted(spark, sf).filter("vote >= 0")
    both = v.withColumn("part", F.explode(F.array(F.lit("all"), F.col("sample"))))
    a = agreement(both, "vote", "label", ["part"]).filter("part = 'all' OR n > 10")
    return agreement_out(a, "part")


CRAMER = """m AS (SELECT (SELECT count(DISTINCT a) FROM c) AS k, (SELECT count(DISTINCT b) FROM c) AS l, (SELECT CAST(sum(n) AS DOUBLE) FROM c) AS t),
g AS (SELECT ra.a, rb.b, CAST(ra.n AS DOUBLE) * rb.n / t AS e, coalesce(CAST(c.n AS DOUBLE), 0) AS o FROM (SELECT a, sum(n) AS n FROM c GROUP BY a) ra CROSS JOIN (SELECT b, sum(n) AS n FROM c GROUP BY b) rb CROSS JOIN m LEFT JOIN c ON c.a = ra.a AND c.b = rb.b),
x AS (SELECT sum(CASE WHEN k = 2 AND l = 2 THEN power(greatest(abs(o - e) - least(CAST(0.5 AS DOUBLE), abs(o - e)), 0), 2) ELSE power(o - e, 2) END / e) AS chi2 FROM g, m)
SELECT round(CASE WHEN least(k, l) > 1 THEN chi2 END, 6) + 0 AS chi2, round(sqrt(CASE WHEN least(k, l) > 1 THEN chi2 END / nullif(t * (least(k, l) - 1), 0)), 6) + 0 AS cramers_v FROM x, m"""


@query(f"WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY 1, 2), {CRAMER}")
def cramers_v_wide(spark, sf):
    v = cramers_v(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")
    return v.select(r6("chi2").alias("chi2"), r6("cramers_v").alias("cramers_v"))


@query(f"WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY 1, 2), {CRAMER}")
def cramers_v_yates(spark, sf):
    v = cramers_v(table(spark, sf, "labels"), "quality", "toxic")
    return v.select(r6("chi2").alias("chi2"), r6("cramers_v").alias("cramers_v"))


@query()
def resampled_agreement(spark, sf):
    """ARI with its bootstrap interval, NMI with its permutation p; seeded."""
    cells = A.contingency(table(spark, sf, "labels"), "quality", "toxic")
    a, n = ari_bootstrap(cells, 1000, 7), nmi_permutation(cells, 1000, 7)
    return spark.createDataFrame([(a["ari"], a["low"], a["high"], a["std"], n["nmi"], n["p_value"])], "ari double, low double, high double, std double, nmi double, p_value double")


@query("""WITH s AS (SELECT l_discount * 10 AS s FROM lineitem), b AS (SELECT CASE WHEN s > 0.7e0 THEN 'high' WHEN s > 0.3e0 THEN 'moderate' ELSE 'low' END AS thirds, CASE WHEN s > 0.5e0 THEN 'strong' WHEN s > 0.3e0 THEN 'moderate' WHEN s > 0.1e0 THEN 'weak' ELSE 'very weak' END AS strength FROM s)
SELECT thirds, strength, count(*) AS n FROM b GROUP BY 1, 2""")
def interpretation_bands(spark, sf):
    s = F.col("l_discount") * 10
    return table(spark, sf, "lineitem").groupBy(band_by_thirds(s).alias("thirds"), band_by_strength(s).alias("strength")).agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT CAST(s_nationkey AS INTEGER) AS label, count(*) AS n FROM supplier GROUP BY 1) SELECT CAST(r.i AS INTEGER) AS label, coalesce(n, 0) AS n FROM range((SELECT max(label) + 1 FROM c)) r(i) LEFT JOIN c ON c.label = r.i")
def label_histogram(spark, sf):
    return A.label_histogram(table(spark, sf, "supplier"), "s_nationkey")


@query("SELECT label, n, round(CAST(n AS DOUBLE) / sum(n) OVER () * 100, 6) + 0 AS pct FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label)")
def cluster_statistics(spark, sf):
    return size_table(points(spark, sf), "label").withColumn("pct", r6("pct"))


@query("""SELECT l_returnflag, count(l_extendedprice) AS "count", round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS "min", round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, max(l_extendedprice) AS "max" FROM lineitem GROUP BY 1""")
def describe(spark, sf):
    d = A.describe(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return d.select("l_returnflag", "count", *[F.round(c, 4).alias(c) for c in ("mean", "std")], "min", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p75")], "max")


@query(f"WITH {SPOTS} SELECT a.sample, count(*) AS n FROM nuclei a JOIN (SELECT sample FROM spots GROUP BY sample HAVING count(*) >= 15) b USING (sample) GROUP BY 1")
def large_groups(spark, sf):
    keep = L.large_groups(spots(spark, sf), ["sample"], 15).select("sample").distinct()
    return nuclei(spark, sf).join(keep, "sample", "left_semi").groupBy("sample").agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def complement(spark, sf):
    hit = table(spark, sf, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").join(hit, "p_partkey", "left_anti").select("p_partkey")


MORAN = f"""{PTS}, {KNN}, dev AS (SELECT id, sample, label - avg(label) OVER (PARTITION BY sample) AS dev, count(*) OVER (PARTITION BY sample) AS n FROM pts),
lag AS (SELECT i, sum(CAST(1 AS DOUBLE) / 8 * dev) AS lag, sum(CAST(1 AS DOUBLE) / 8) AS w FROM knn JOIN dev ON knn.j = dev.id GROUP BY i)"""


@query(f"""WITH {MORAN}, s AS (SELECT sample, count(*) AS n_points, CAST(count(*) AS DOUBLE) AS n, sum(w) AS ws, sum(dev * lag) AS num, sum(dev * dev) AS den FROM dev JOIN lag ON dev.id = lag.i WHERE n >= 10 GROUP BY sample),
m AS (SELECT sample, n_points, n, n / ws * num / den AS i, -1 / (n - 1) AS e FROM s), v AS (SELECT *, (n * n - 3 * n + 3) / ((n - 1) * (n - 2) * (n - 3)) - e * e AS var FROM m)
SELECT sample, n_points, round(i, 6) + 0 AS morans_i, round(e, 6) + 0 AS expected_i, round((i - e) / sqrt(var), 6) + 0 AS z_score FROM v""")
def moran_i(spark, sf):
    p = points(spark, sf)
    return S.morans_i(p, knn_edges(p, 8), "label").select("sample", "n_points", *[r6(c).alias(c) for c in ("morans_i", "expected_i", "z_score")])


@query(f"WITH {MORAN} SELECT sample, id, round(dev * lag, 6) + 0 AS local_i, CAST(1 AS DOUBLE) AS p_value, CAST(0 AS DOUBLE) AS z_score, CAST(1 AS INTEGER) AS quadrant FROM dev JOIN lag ON dev.id = lag.i WHERE n >= 10")
def lisa(spark, sf):
    p = points(spark, sf)
    return S.local_morans_i(p, knn_edges(p, 8), "label").withColumn("local_i", r6("local_i"))


@query(f"WITH {PTS} SELECT sample, count(*) AS n_points, CAST(0 AS DOUBLE) AS global_g, CAST(1 AS DOUBLE) AS global_p_value, CAST(0 AS BIGINT) AS n_hotspots FROM pts GROUP BY sample HAVING count(*) >= 10")
def getis_ord(spark, sf):
    return S.getis_ord_g(points(spark, sf))


@query(f"""WITH {PTS}, {KNN}, t AS (SELECT id, sample, CAST(label AS DOUBLE) AS v, sum(CAST(label AS DOUBLE)) OVER (PARTITION BY sample) AS total FROM pts), s AS (SELECT i, sum(CAST(1 AS DOUBLE) / 8 * v) AS s FROM knn JOIN t ON knn.j = t.id GROUP BY i)
SELECT t.sample, id, round(s / nullif(total - v, 0), 6) + 0 AS g FROM t JOIN s ON t.id = s.i""")
def local_g(spark, sf):
    p = points(spark, sf)
    return S.local_g(p, knn_edges(p, 8), "label").withColumn("g", r6("g"))


#: 2 (1 - Phi(|z|)) by Simpson's rule, which SQL has no function for; |z| is taken up to 12.
P_OF_Z = """(SELECT greatest(0, 1 - 2 * sum((CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-power(least(abs({z}), 12) * i / 2000, 2) / 2)) * least(abs({z}), 12) / 6000 / sqrt(2 * pi())) FROM range(2001) t(i))"""
SUMMARY = """i6 AS (SELECT *, CASE WHEN den > 0 AND ws > 0 THEN n / ws * num / den ELSE 0 END AS i, -1 / (n - 1) AS e FROM s), v6 AS (SELECT *, (n * n - 3 * n + 3) / ((n - 1) * (n - 2) * (n - 3)) - e * e AS var FROM i6), z6 AS (SELECT *, CASE WHEN var > 0 THEN (i - e) / sqrt(var) ELSE 0 END AS z FROM v6),
p6 AS (SELECT *, """ + P_OF_Z.format(z="z6.z") + """ AS p FROM z6), g6 AS (SELECT *, CASE WHEN p >= 0.05e0 THEN 'random' WHEN i > e THEN 'clustering' ELSE 'dispersion' END AS pattern, CAST(sum(CASE WHEN p < 0.05e0 THEN 1 ELSE 0 END) OVER () AS BIGINT) AS sig, count(*) OVER () AS total FROM p6)
SELECT g6.sample, n_points, round(i, 6) + 0 AS morans_i, round(e, 6) + 0 AS expected_i, round(var, 6) + 0 AS variance, round(z, 6) + 0 AS z_score, round(p, 5) + 0 AS p_value, k AS n_clusters, pattern, sig AS n_significant, total AS n_samples,
 CASE WHEN sig * 2 > total THEN 'strong' WHEN sig > 0 THEN 'moderate' ELSE 'limited' END AS evidence FROM g6 JOIN (SELECT sample, count(DISTINCT label) AS k FROM pts GROUP BY sample) USING (sample)"""


def summed_up(df):
    return df.withColumns({**{c: r6(c) for c in ("morans_i", "expected_i", "variance", "z_score")}, "p_value": F.round("p_value", 5) + F.lit(0.0)})


@query(f"""WITH {MORAN}, s AS (SELECT sample, count(*) AS n_points, CAST(count(*) AS DOUBLE) AS n, sum(w) AS ws, sum(dev * lag) AS num, sum(dev * dev) AS den FROM dev JOIN lag ON dev.id = lag.i WHERE n >= 10 GROUP BY sample), {SUMMARY}""")
def spatial_summary(spark, sf):
    """Moran's I per sample with p, pattern and the overall evidence."""
    return summed_up(S.summary(S.analyse(points(spark, sf), "label", "knn", 8)))


@query(f"""WITH {PTS}, near AS (SELECT a.id AS i, b.id AS j FROM pts a JOIN pts b ON a.sample = b.sample AND a.id <> b.id WHERE {DIST} > 0 AND {DIST} <= 60), wts AS (SELECT i, j, CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY i) AS w FROM near),
dev AS (SELECT id, sample, label - avg(label) OVER (PARTITION BY sample) AS dev, count(*) OVER (PARTITION BY sample) AS n FROM pts), lag AS (SELECT i, sum(w * dev) AS lag, sum(w) AS w FROM wts JOIN dev ON wts.j = dev.id GROUP BY i),
s AS (SELECT sample, count(*) AS n_points, CAST(count(*) AS DOUBLE) AS n, sum(coalesce(w, 0)) AS ws, sum(dev * coalesce(lag, 0)) AS num, sum(dev * dev) AS den FROM dev LEFT JOIN lag ON dev.id = lag.i WHERE n >= 10 GROUP BY sample), {SUMMARY}""")
def spatial_band_summary(spark, sf):
    return summed_up(S.summary(S.analyse(points(spark, sf), "label", "distance", threshold=60.0)))


@query(f"""WITH {PTS}, {KNN.replace('<= 8', '<= 9')}, p AS (SELECT i, a.label, avg(CASE WHEN a.label = b.label THEN CAST(1 AS DOUBLE) ELSE 0 END) AS purity FROM knn JOIN pts a ON knn.i = a.id JOIN pts b ON knn.j = b.id GROUP BY i, a.label)
SELECT label, count(*) AS n, round(avg(purity), 6) + 0 AS mean, round(stddev_pop(purity), 6) + 0 AS std FROM p GROUP BY label""")
def nn_purity(spark, sf):
    p = S.neighbour_purity(points(spark, sf), "label")
    return p.groupBy("label").agg(F.count("*").alias("n"), r6(F.avg("purity")).alias("mean"), r6(F.stddev_pop("purity")).alias("std"))


@query(f"""WITH {PTS}, b AS (SELECT label, CASE WHEN x + 200 <= 50 OR x + 200 >= 350 OR y + 200 <= 50 OR y + 200 >= 350 THEN CAST(1 AS DOUBLE) ELSE 0 END AS b FROM pts), c AS (SELECT label, avg(b) AS share, count(*) AS n, sum(b) AS nb FROM b GROUP BY label),
s AS (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(nb) AS BIGINT) AS border, max(share) AS mx, avg(share) AS mean, stddev_pop(share) AS sd, count(CASE WHEN share > 0.7e0 THEN 1 END) AS high, count(*) AS k FROM c)
SELECT total, border, total - border AS interior, round(CAST(border AS DOUBLE) / total, 6) + 0 AS border_fraction, round(mx, 6) + 0 AS max_concentration, round(mean, 6) + 0 AS mean_concentration, round(sd, 6) + 0 AS imbalance, high AS high_clusters, round(CAST(high AS DOUBLE) / k, 6) + 0 AS high_fraction, round(mean * 0.6e0 + CAST(high AS DOUBLE) / k * 0.4e0, 6) + 0 AS quality FROM s""")
def border_quality(spark, sf):
    b = A.border_quality(shifted(spark, sf), "label", WIDTH, HEIGHT, 50)
    r = ("border_fraction", "max_concentration", "mean_concentration", "imbalance", "high_fraction", "quality")
    return b.select(*[r6(c).alias(c) if c in r else F.col(c) for c in b.columns])


@query(f"""WITH {PTS}, d AS (SELECT a.label, avg({DIST}) AS md FROM pts a JOIN pts b ON a.label = b.label AND a.id < b.id GROUP BY a.label), s AS (SELECT 1 / (1 + md) AS c FROM d), z AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM pts GROUP BY label)
SELECT round(avg(c), 6) + 0 AS mean_coherence, round(stddev_pop(c), 6) + 0 AS std_coherence, round(min(c), 6) + 0 AS min_coherence, (SELECT round(stddev_pop(n) / avg(n), 6) + 0 FROM z) AS size_cv, (SELECT count(*) FROM z) AS k FROM s""")
def coherence(spark, sf):
    p = points(spark, sf)
    c = C.pair_distances(p, "label").select((1.0 / (1.0 + F.col("mean_distance"))).alias("c"))
    s = c.agg(r6(F.avg("c")).alias("mean_coherence"), r6(F.stddev_pop("c")).alias("std_coherence"), r6(F.min("c")).alias("min_coherence"))
    return s.crossJoin(A.size_balance(p, "label").select(r6("size_cv").alias("size_cv"), "k"))


@query(f"WITH {PTS}, z AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM pts GROUP BY label) SELECT count(*) AS k, min(n) AS min_size, max(n) AS max_size, round(max(n) / min(n), 6) + 0 AS size_ratio, round(stddev_pop(n) / avg(n), 6) + 0 AS size_cv FROM z")
def size_balance(spark, sf):
    b = A.size_balance(points(spark, sf), "label")
    return b.withColumn("size_ratio", r6("size_ratio")).withColumn("size_cv", r6("size_cv"))


SEP = "c AS (SELECT label, pos, avg(val) AS m FROM dims GROUP BY 1, 2), sep AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM c a JOIN c b ON a.pos = b.pos AND a.label < b.label GROUP BY 1, 2)"


@query(f"WITH {DIMS}, {SEP} SELECT round(min(d), 6) + 0 AS min_separation, round(avg(d), 6) + 0 AS mean_separation, round(max(d) / min(d), 6) + 0 AS separation_ratio FROM sep")
def center_separation(spark, sf):
    c = A.center_separation(points(spark, sf), "label")
    return c.select(*[r6(x).alias(x) for x in c.columns])


SIL = f"""{PTS}, d AS (SELECT a.id, a.label, b.label AS other, sum({DIST}) AS s, count(*) AS n FROM pts a, pts b GROUP BY 1, 2, 3),
ab AS (SELECT id, label, max(CASE WHEN other = label AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN other <> label THEN s / n END) AS b FROM d GROUP BY id, label),
sil AS (SELECT id, label, coalesce((b - a) / greatest(a, b), 0) AS s FROM ab)"""


@query(f"WITH {SIL} SELECT CAST(label AS BIGINT) AS label, round(avg(s), 6) + 0 AS mean, round(stddev_pop(s), 6) + 0 AS std, count(*) AS n FROM sil GROUP BY label")
def silhouette(spark, sf):
    p = points(spark, sf).withColumn("xy", F.array("x", "y"))
    s = C.silhouette_by_cluster(C.silhouette(p, "id", "xy", "label"))
    return s.select("label", r6("mean").alias("mean"), r6("std").alias("std"), "n")


@query(f"""WITH {DIMS}, c AS (SELECT label, pos, avg(val) AS m, count(*) AS n FROM dims GROUP BY 1, 2), g AS (SELECT pos, avg(val) AS m FROM dims GROUP BY pos), w AS (SELECT sum((val - m) * (val - m)) AS w FROM dims JOIN c USING (label, pos)), b AS (SELECT sum(n * (c.m - g.m) * (c.m - g.m)) AS b FROM c JOIN g USING (pos)), k AS (SELECT count(DISTINCT label) AS k, count(*) AS n FROM pts)
SELECT round((b / (k - 1)) / (w / (n - k)), 5) + 0 AS calinski_harabasz FROM w, b, k""")
def calinski_harabasz(spark, sf):
    return C.calinski_harabasz(points(spark, sf), "v", "label").select((F.round("calinski_harabasz", 5) + 0).alias("calinski_harabasz"))


@query(f"""WITH {DIMS}, c AS (SELECT label, pos, avg(val) AS m FROM dims GROUP BY 1, 2), s AS (SELECT label, avg(d) AS s FROM (SELECT id, dims.label, sqrt(sum((val - m) * (val - m))) AS d FROM dims JOIN c ON dims.label = c.label AND dims.pos = c.pos GROUP BY 1, 2) GROUP BY label),
p AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM c a JOIN c b ON a.pos = b.pos AND a.label <> b.label GROUP BY 1, 2), r AS (SELECT i, max((x.s + y.s) / d) AS r FROM p JOIN s x ON x.label = i JOIN s y ON y.label = j GROUP BY i) SELECT round(avg(r), 6) + 0 AS davies_bouldin FROM r""")
def davies_bouldin(spark, sf):
    return C.davies_bouldin(points(spark, sf), "v", "label").select(r6("davies_bouldin").alias("davies_bouldin"))


VSIL = f"""d AS (SELECT a.id, a.label, b.label AS other, sum(list_distance(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[]))) AS s, count(*) AS n FROM pts a, pts b GROUP BY 1, 2, 3),
ab AS (SELECT id, label, max(CASE WHEN other = label AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN other <> label THEN s / n END) AS b FROM d GROUP BY id, label),
sil AS (SELECT avg(coalesce((b - a) / greatest(a, b), 0)) AS s FROM ab)"""


@query(f"""WITH {DIMS}, {SEP}, {VSIL}, z AS (SELECT label, CAST(count(*) AS DOUBLE) AS n FROM pts GROUP BY label), g AS (SELECT pos, avg(val) AS m FROM dims GROUP BY pos),
w AS (SELECT sum((val - m) * (val - m)) AS w FROM dims JOIN c USING (label, pos)), b AS (SELECT sum(n * (c.m - g.m) * (c.m - g.m)) AS b FROM c JOIN g USING (pos) JOIN z USING (label)), k AS (SELECT count(*) AS k, sum(n) AS n FROM z),
e AS (SELECT label, avg(d) AS s FROM (SELECT id, dims.label, sqrt(sum((val - m) * (val - m))) AS d FROM dims JOIN c ON dims.label = c.label AND dims.pos = c.pos GROUP BY 1, 2) GROUP BY label),
r AS (SELECT x.label, max((x.s + y.s) / d) AS r FROM sep JOIN e x ON x.label = i OR x.label = j JOIN e y ON y.label = CASE WHEN x.label = i THEN j ELSE i END GROUP BY 1)
SELECT (SELECT round(s, 5) + 0 FROM sil) AS silhouette, (SELECT round((b / (k - 1)) / (w / (n - k)), 5) + 0 FROM w, b, k) AS calinski_harabasz, (SELECT round(avg(r), 5) + 0 FROM r) AS davies_bouldin, (SELECT k FROM k) AS k,
 (SELECT min(n) FROM z) AS min_size, (SELECT max(n) FROM z) AS max_size, (SELECT round(max(n) / min(n), 5) + 0 FROM z) AS size_ratio, (SELECT round(stddev_pop(n) / avg(n), 5) + 0 FROM z) AS size_cv,
 (SELECT round(min(d), 5) + 0 FROM sep) AS min_separation, (SELECT round(avg(d), 5) + 0 FROM sep) AS mean_separation, (SELECT round(max(d) / min(d), 5) + 0 FROM sep) AS separation_ratio""")
def quality_bundle(spark, sf):
    """All cluster quality figures of one labeling, on its vectors."""
    q = C.quality_bundle(points(spark, sf), "id", "v", "label")
    return q.select(*[F.col(c) if c in ("k", "min_size", "max_size") else (F.round(c, 5) + 0).alias(c) for c in q.columns])


@query(f"""WITH {SIL}, p2 AS (SELECT *, CAST(id % 3 AS BIGINT) AS l2 FROM pts), e AS (SELECT a.id, a.l2, b.l2 AS other, sum({DIST}) AS s, count(*) AS n FROM p2 a, p2 b GROUP BY 1, 2, 3),
f AS (SELECT id, l2, max(CASE WHEN other = l2 AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN other <> l2 THEN s / n END) AS b FROM e GROUP BY id, l2),
m AS (SELECT (SELECT avg(s) FROM sil) AS x, (SELECT avg(coalesce((b - a) / greatest(a, b), 0)) FROM f) AS y) SELECT round(x, 6) + 0 AS first_silhouette, round(y, 6) + 0 AS second_silhouette, round(CASE WHEN y = 0 THEN 0 ELSE (x - y) / y END, 4) + 0 AS effect FROM m""")
def coherence_effect(spark, sf):
    """How much more coherent one labeling is than another, by mean silhouettes on the coordinates."""
    p = points(spark, sf).withColumn("xy", F.array("x", "y")).withColumn("other", F.col("id") % 3)
    a, b = (C.silhouette(p, "id", "xy", c).agg(F.avg("silhouette").alias(n)) for c, n in (("label", "a"), ("other", "b")))
    return a.crossJoin(b).select(r6("a").alias("first_silhouette"), r6("b").alias("second_silhouette"), (F.round(C.coherence_effect(F.col("a"), F.col("b")), 4) + 0).alias("effect"))


@query(f"""WITH {PTS}, m AS (SELECT var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c FROM pts), e AS (SELECT (a + b) / 2 AS h, sqrt((a - b) * (a - b) / 4 + c * c) AS r FROM m)
SELECT CAST(i AS INTEGER) AS component, round((h + CASE WHEN i = 0 THEN r ELSE -r END) / (2 * h), 6) + 0 AS share FROM e, range(2) t(i)""")
def pca_plane(spark, sf):
    """Principal components of the coordinates; two by two, their eigenvalues are a formula."""
    _, shares = C.pca(points(spark, sf).withColumn("xy", F.array("x", "y")), "xy", 2)
    return spark.createDataFrame([(i, round(s, 6) + 0.0) for i, s in enumerate(shares)], "component int, share double")


@query(f"""WITH {DIMS}, s AS (SELECT pos, var_pop(val) AS v FROM dims GROUP BY pos), r AS (SELECT avg(abs(c)) AS c FROM (SELECT corr(a.val, b.val) AS c FROM dims a JOIN dims b ON a.id = b.id AND a.pos < b.pos GROUP BY a.pos, b.pos))
SELECT round(avg(v), 8) + 0 AS variance_mean, round(stddev_pop(v) / avg(v), 5) + 0 AS variance_cv, (SELECT round(c, 5) + 0 FROM r) AS mean_abs_correlation FROM s""")
def feature_spread(spark, sf):
    q = C.feature_quality(points(spark, sf), "v")
    return spark.createDataFrame([(round(q["variance_mean"], 8), round(q["variance_cv"], 5), round(q["mean_abs_correlation"], 5))], "variance_mean double, variance_cv double, mean_abs_correlation double")


@query(f"""WITH {SIL}, z AS (SELECT label, avg(x) AS x, avg(y) AS y, CAST(count(*) AS DOUBLE) AS n FROM pts GROUP BY label), t AS (SELECT avg(x) AS x, avg(y) AS y, CAST(count(*) AS DOUBLE) AS n FROM pts),
w AS (SELECT sum((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS w FROM pts a JOIN z b USING (label)), b AS (SELECT sum(a.n * ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS b FROM z a, t b),
e AS (SELECT label, avg({DIST}) AS s FROM pts a JOIN z b USING (label) GROUP BY label), r AS (SELECT a.label, max((p.s + q.s) / {DIST}) AS r FROM z a JOIN z b ON a.label <> b.label JOIN e p ON p.label = a.label JOIN e q ON q.label = b.label GROUP BY a.label)
SELECT 'labels' AS labeling, (SELECT round(avg(s), 5) + 0 FROM sil) AS silhouette, (SELECT round((b / ((SELECT count(*) FROM z) - 1)) / (w / (n - (SELECT count(*) FROM z))), 5) + 0 FROM w, b, t) AS calinski_harabasz, (SELECT round(avg(r), 5) + 0 FROM r) AS davies_bouldin
UNION ALL SELECT 'one', CAST(-1 AS DOUBLE), CAST(0 AS DOUBLE), CAST('Infinity' AS DOUBLE)""")
def cluster_scores(spark, sf):
    """The evaluator on the coordinates: of the labels, and of one cluster for all, which has fixed values."""
    p = points(spark, sf).withColumn("xy", F.array("x", "y")).withColumn("one", F.lit(0))
    both = [C.quality(p, "id", "xy", c).withColumn("labeling", F.lit(n)) for c, n in (("label", "labels"), ("one", "one"))]
    return both[0].unionByName(both[1]).select("labeling", *[(F.round(c, 5) + 0).alias(c) for c in ("silhouette", "calinski_harabasz", "davies_bouldin")])


@query(f"""WITH {PTS}, c AS (SELECT label AS l, avg(x) AS x, avg(y) AS y FROM pts GROUP BY label), d AS (SELECT a.id, a.label, max(CASE WHEN l = a.label THEN {DIST} END) AS own, min(CASE WHEN l <> a.label THEN {DIST} END) AS other FROM pts a, c b GROUP BY 1, 2)
SELECT CAST(label AS BIGINT) AS label, round(avg(coalesce((other - own) / nullif(greatest(other, own), 0), 0)), 6) + 0 AS mean, count(*) AS n FROM d GROUP BY label""")
def silhouette_by_centers(spark, sf):
    """The silhouette by distances to the clusters' means, which is linear in the points."""
    s = C.simplified_silhouette(points(spark, sf).withColumn("xy", F.array("x", "y")), "id", "xy", "label")
    return s.groupBy("label").agg(r6(F.avg("silhouette")).alias("mean"), F.count("*").alias("n"))


@query(f"""WITH {PTS}, seed AS (SELECT row_number() OVER (ORDER BY id) - 1 AS c, x, y FROM (SELECT * FROM pts ORDER BY id LIMIT 5)), a1 AS (SELECT * FROM (SELECT a.id, a.x, a.y, b.c, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.c) AS rn FROM pts a, seed b) WHERE rn = 1),
m1 AS (SELECT c, avg(x) AS x, avg(y) AS y FROM a1 GROUP BY c) SELECT id, CAST(c AS BIGINT) AS cluster FROM (SELECT a.id, b.c, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.c) AS rn FROM pts a, m1 b) WHERE rn = 1""")
def lloyd_kmeans(spark, sf):
    p = points(spark, sf).withColumn("xy", F.array("x", "y"))
    return C.lloyd(p, "xy", 5, rounds=1).select("id", F.col("cluster").cast("bigint").alias("cluster"))


BATCHED = """seed AS (SELECT row_number() OVER (ORDER BY id) - 1 AS c, x, y, CAST(0 AS DOUBLE) AS n FROM (SELECT * FROM pts ORDER BY id LIMIT 4))"""


def _batch_sql(k: int, before: str) -> str:
    """The centres after mini-batch k: each is the mean of all it has been given."""
    return f"""a{k} AS (SELECT * FROM (SELECT a.id, a.x, a.y, b.c, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.c) AS rn FROM pts a, {before} b WHERE a.id % 3 = {k}) WHERE rn = 1),
g{k} AS (SELECT c, count(*) AS m, sum(x) AS sx, sum(y) AS sy FROM a{k} GROUP BY c), b{k} AS (SELECT c, (x * n + coalesce(sx, 0)) / greatest(n + coalesce(m, 0), 1e-300) * (CASE WHEN n + coalesce(m, 0) > 0 THEN 1 ELSE 0 END) + CASE WHEN n + coalesce(m, 0) > 0 THEN 0 ELSE x END AS x,
 (y * n + coalesce(sy, 0)) / greatest(n + coalesce(m, 0), 1e-300) * (CASE WHEN n + coalesce(m, 0) > 0 THEN 1 ELSE 0 END) + CASE WHEN n + coalesce(m, 0) > 0 THEN 0 ELSE y END AS y, n + coalesce(m, 0) AS n FROM {before} LEFT JOIN g{k} USING (c))"""


@query(f"""WITH {PTS}, {BATCHED}, {_batch_sql(0, 'seed')}, {_batch_sql(1, 'b0')}, {_batch_sql(2, 'b1')}
SELECT id, CAST(c AS INTEGER) AS cluster FROM (SELECT a.id, b.c, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.c) AS rn FROM pts a, b2 b) WHERE rn = 1""")
def minibatch_clusters(spark, sf):
    """One pass of three mini-batches from the first four points, then every point's nearest centre."""
    p = points(spark, sf).withColumn("xy", F.array("x", "y"))
    return C.minibatch_kmeans(p, "xy", 4, batches=3, scale=False).assign(p, "xy").select("id", "cluster")


@query()
def ensemble_clusters(spark, sf):
    return C.ensemble(points(spark, sf), "v", 5, sample=300).select("id", "cluster")


@query()
def chosen_k_by_criteria(spark, sf):
    return spark.createDataFrame([(C.choose_k_by_criteria(points(spark, sf).withColumn("xy", F.array("x", "y")), "xy", 5, sample=1000),)], "k int")


@query()
def kmeans_clusters(spark, sf):
    """k-means on standardised vectors, best of three restarts."""
    return C.kmeans(points(spark, sf), "v", 10, seed=42, restarts=3).select("id", "cluster")


@query()
def kmeans_per_sample(spark, sf):
    return C.kmeans_per_sample(points(spark, sf), "v", 6)


@query()
def bisected_clusters(spark, sf):
    return C.bisecting(points(spark, sf), "v", 6).select("id", "cluster")


@query()
def spectral_clusters(spark, sf):
    """Power iteration on the nearest-neighbour graph."""
    return C.spectral(knn_edges(points(spark, sf), 8), 5)


@query()
def labelings_compared(spark, sf):
    p = points(spark, sf).withColumn("xy", F.array("x", "y"))
    return C.compare_labelings(C.lloyd(p, "xy", 5, rounds=2), "id", "xy", "label", "cluster")


@query()
def chosen_k(spark, sf):
    best, scores = C.choose_k(points(spark, sf).withColumn("xy", F.array("x", "y")), "xy", 5)
    return spark.createDataFrame([(k, s, k == best) for k, s in scores.items()], "k int, silhouette double, chosen boolean")


@query()
def pca_variance(spark, sf):
    _, shares = C.pca(points(spark, sf), "v", 2)
    return spark.createDataFrame([(i, round(s, 8)) for i, s in enumerate(shares)], "component int, share double")


@query()
def feature_quality(spark, sf):
    q = C.feature_quality(points(spark, sf), "v")
    return spark.createDataFrame([(k, float(v)) for k, v in q.items()], "metric string, value double")


RANKED = """c AS (SELECT o_orderpriority AS configuration, avg(o_totalprice) / 1000000 AS border, avg(o_custkey) / 100000 AS coherence, CAST(count(*) AS DOUBLE) / 100000 AS silhouette, max(o_totalprice) AS ch, min(o_totalprice) AS db FROM orders GROUP BY 1),
s AS (SELECT configuration, border, coherence, silhouette, (ch - min(ch) OVER ()) / (max(ch) OVER () - min(ch) OVER () + 1e-8) AS ch, 1 / (1 + db) AS db FROM c),
t AS (SELECT configuration, (border - min(border) OVER ()) / (max(border) OVER () - min(border) OVER () + 1e-8) + (coherence - min(coherence) OVER ()) / (max(coherence) OVER () - min(coherence) OVER () + 1e-8) + (silhouette - min(silhouette) OVER ()) / (max(silhouette) OVER () - min(silhouette) OVER () + 1e-8)
 + (ch - min(ch) OVER ()) / (max(ch) OVER () - min(ch) OVER () + 1e-8) + (db - min(db) OVER ()) / (max(db) OVER () - min(db) OVER () + 1e-8) AS composite FROM s)"""


def configurations(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("configuration"))
    return o.agg((F.avg("o_totalprice") / 1000000).alias("border"), (F.avg("o_custkey") / 100000).alias("coherence"), (F.count("*").cast("double") / 100000).alias("silhouette"), F.max("o_totalprice").alias("calinski_harabasz"), F.min("o_totalprice").alias("davies_bouldin"))


@query(f"WITH {RANKED} SELECT configuration, round(composite, 6) + 0 AS composite, row_number() OVER (ORDER BY composite DESC, configuration) = 1 AS best FROM t")
def composite_rank(spark, sf):
    return R.composite(configurations(spark, sf)).select("configuration", r6("composite").alias("composite"), "best")


@query()
def recommended(spark, sf):
    return R.recommendations(configurations(spark, sf))


@query("""WITH m AS (SELECT l_returnflag, CAST(count(*) AS DOUBLE) AS n, round(avg(l_quantity), 6) + 0 AS quantity FROM lineitem GROUP BY 1) SELECT l_returnflag, metric, value FROM (UNPIVOT m ON n, quantity INTO NAME metric VALUE value)""")
def metric_table(spark, sf):
    m = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").cast("double").alias("n"), r6(F.avg("l_quantity")).alias("quantity"))
    return metric_rows(m, ["l_returnflag"], ["n", "quantity"])


@query("""SELECT l_returnflag, round(avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 6) + 0 AS F, round(avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 6) + 0 AS O FROM lineitem GROUP BY 1""")
def pivoted_summary(spark, sf):
    """A column per sample, as the comparison table has it."""
    return table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(r6(F.avg("l_quantity")))
