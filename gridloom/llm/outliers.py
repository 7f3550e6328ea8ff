"""Quality rules: base counts per document, and robust multivariate outliers.

The base counts come from array functions within a row. For the verdict, each document's counts are
turned into a vector (shrunk rates, so that short texts do not stand out by chance), and each
(language, source) gets a minimum-covariance-determinant estimate. Three starts give a first order
of the rows: medians and median deviations alone, and with them the covariance of the directions or
of the squashed deviations. Concentration steps keep the three quarters nearest and re-estimate mean
and covariance from these; after FIRST_STEPS the start of least determinant goes on, until its
determinant falls no more. A document is rejected where its squared Mahalanobis distance, scaled by
its group's median, is beyond the cutoff. A group with few rows takes its language's estimate, and a
language with few rows that of all rows; these are fitted on all rows of the language, or of the table.

Quantiles within a group come from its histogram, so no task has a group's rows, and reruns agree.

Defined results: a null text has no words; null languages and sources are values of their own; rows
with the same id are rows of their own; an empty table gives an empty result. Rows that fail the
base rule are neither kept nor used for the estimates. The covariance has a floor on its diagonal,
so groups whose rows are all alike have one too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import let, pick, small, stage, table, words

#: Coordinates of the vector and the least standard deviation that each counts with.
COORDS = {"word_length": 0.05, "symbols": 0.05, "dup_lines": 0.10, "repeats": 0.10, "capitals": 0.05}
CHI2_MEDIAN = {1: 0.455, 2: 1.386, 3: 2.366, 4: 3.357, 5: 4.351, 6: 5.348}
#: Steps of a histogram of distances in an octave, and of one of a coordinate in its least deviation.
OCTAVE, FINE = 64, 20
#: The 0.9999 quantile of chi-square at 5 degrees of freedom, one for each coordinate.
CUTOFF = 25.745
NEAREST, FIRST_STEPS, LEAST_ROWS = 0.75, 2, 200
#: A determinant that falls by less than this, as a logarithm, falls no more.
STILL = 1e-4
WINDOW = 5


def repeat_words(w: Column, width: int = WINDOW) -> Column:
    """Words of w that lie in a window of `width` words found twice or more in w."""
    n = F.size(w) - (width - 1)
    # Each word is hashed once, then each window of hashes.
    hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.when(
        n > 1, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(ranked, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(s, i + 1)["h"]).eqNullSafe(True)),
            lambda x: x["i"])))
        return let(twice, lambda p: F.aggregate(
            F.sequence(F.lit(1), F.size(p) - 1), F.lit(width), lambda a, i: a + F.least(F.lit(width), F.get(p, i) - F.get(p, i - 1))))

    return let(hashes, lambda h: F.when(h.isNotNull() & (F.size(F.array_distinct(h)) < F.size(h)), covered(h)).otherwise(F.lit(0)))


def counts(docs: DataFrame) -> DataFrame:
    """_row, doc_id, lang, source and the counts of each text."""
    rows = pick(docs, "doc_id", "lang", "source", "text").withColumn("text", F.coalesce("text", F.lit("")))
    w = F.col("w")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("w", words(F.col("text"))).withColumn("lines", lines)
    plain = F.array_join(w, "")
    out = rows.select(
        "_row", "doc_id", "lang", "source",
        F.size(w).cast("long").alias("n_words"),
        F.length(plain).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(w).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("text", r"[^A-Z]+", "")).cast("long").alias("n_capitals"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def vectors(rows: DataFrame) -> DataFrame:
    """Adds the coordinates: rates with a prior of about 30 words, on a square-root or log scale."""
    c = F.col
    return rows.withColumns({
        "word_length": F.log((c("word_chars") + 150) / (c("n_words") + 30)),
        "symbols": F.sqrt(c("n_symbols") / (c("word_chars") + 150)),
        "dup_lines": F.sqrt(c("n_dup_lines") / (c("n_lines") + 5)),
        "repeats": F.sqrt(c("n_repeat_words") / (c("n_words") + 30)),
        "capitals": F.sqrt(c("n_capitals") / (c("word_chars") + 150)),
    })


def grouped(rows: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """Adds g, the group whose estimate holds for a row, and into, the groups whose estimates the row counts in.

    Groups are a language and source, a language, or all; the latter two only where a row needs them.
    """
    def name(level: int, *values):
        lang, source = (*values, *[F.lit(None).cast("string")] * (2 - len(values)))
        return F.to_json(F.struct(F.lit(level).alias("level"), lang.alias("lang"), source.alias("source")))

    cells = stage(rows.groupBy(F.col("lang").alias("_l"), F.col("source").alias("_s")).agg(F.count("*").alias("n")), "cells")
    langs = cells.groupBy("_l").agg(F.sum("n").alias("n_lang"), F.min("n").alias("n_least"))
    few = langs.filter(F.col("n_lang") < least).limit(1).count() > 0
    langs = langs.withColumnRenamed("_l", "_lang")
    cells = cells.join(small(stage(langs, "langs"), 100_000), F.col("_l").eqNullSafe(F.col("_lang")))
    own, lang, every = name(2, F.col("_l"), F.col("_s")), name(1, F.col("_l")), name(0)
    large, spoken = F.col("n") >= least, F.col("n_lang") >= least
    into = F.array(F.when(large, own), F.when(spoken & (F.col("n_least") < least), lang), every if few else F.lit(None).cast("string"))
    cells = stage(cells.select("_l", "_s", F.when(large, own).when(spoken, lang).otherwise(every).alias("g"), F.array_compact(into).alias("into")), "groups")
    same = rows["lang"].eqNullSafe(F.col("_l")) & rows["source"].eqNullSafe(F.col("_s"))
    return rows.join(small(cells, 100_000), same).drop("_l", "_s")


def quantile(rows: DataFrame, group: list[str], value: str, place: Column, share: float, name: str) -> DataFrame:
    """group, name: the largest value of the histogram cell (by place) in which the group's quantile lies."""
    cells = rows.groupBy(*group, place.alias("_cell")).agg(F.count("*").alias("_n"), F.max(value).alias("_top"))
    whole, upto = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("_cell")
    cells = cells.withColumn("_far", F.sum("_n").over(upto) >= F.sum("_n").over(whole) * share)
    return cells.filter("_far").groupBy(*group).agg(F.min_by("_top", "_cell").alias(name))


def _octave(d: str) -> Column:
    return F.floor(F.log2(F.col(d) + 2.0**-20) * OCTAVE)


def _names(d: int) -> list[str]:
    return [*(f"m{i}" for i in range(d)), *(f"w{i}{j}" for i in range(d) for j in range(i + 1))]


def _inverse_root(out: DataFrame, d: int, cov, least: list[float], by: str | None = None) -> DataFrame:
    """Adds w_ij, the inverse of the Cholesky factor of cov(i, j), and logdet; least are the least deviations.

    cov gives SQL, as all is here: one projection whose columns build on one another. With `by`, the
    coordinates are divided by the columns of that name.
    """
    cols = []
    for i in range(d):
        for j in range(i + 1):
            rest = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            cols.append(f"sqrt(greatest({cov(i, j)}{rest}, {least[i] ** 2 / 4}D)) AS l{i}{i}" if i == j else f"({cov(i, j)}{rest}) / l{j}{j} AS l{i}{j}")
    for j in range(d):
        for i in range(j, d):
            sums = " + ".join(f"l{i}{k} * v{k}{j}" for k in range(j, i))
            cols.append(f"1D / l{i}{i} AS v{i}{i}" if i == j else f"-({sums}) / l{i}{i} AS v{i}{j}")
    cols += [f"v{i}{j}{f' / {by}{j}' if by else ''} AS w{i}{j}" for i in range(d) for j in range(i + 1)]
    cols.append(" + ".join(f"2 * ln(l{i}{i})" for i in range(d)) + " AS logdet")
    return out.selectExpr("*", *cols)


def _distance(xs: list[str]) -> Column:
    rows = [" + ".join(f"w{i}{j} * (`{xs[j]}` - m{j})" for j in range(i + 1)) for i in range(len(xs))]
    return F.expr(" + ".join(f"({r}) * ({r})" for r in rows))


def _covariance(s: str, q: str, floors: list[float]):
    """cov(i, j) from the columns n, sums and sums of products, with a floor on the diagonal."""

    def cov(i: int, j: int) -> str:
        plain = f"{q}{i}{j} / n - {s}{i} / n * {s}{j} / n"
        return f"greatest({plain}, 0D) + {floors[i] ** 2}D" if i == j else plain

    return cov


def _sums(cols: list[str], s: str, q: str) -> list[Column]:
    d = len(cols)
    return [*(F.expr(f"sum({c}) AS {s}{i}") for i, c in enumerate(cols)), *(F.expr(f"sum({cols[i]} * {cols[j]}) AS {q}{i}{j}") for i in range(d) for j in range(i + 1))]


def starts(rows: DataFrame, xs: list[str], floors: list[float], hint) -> DataFrame:
    """g, start, m_i, w_ij: three whitenings about the medians of each group."""
    d = len(xs)
    long = rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(x).alias("x"), F.lit(floors[i] / FINE).alias("step")) for i, x in enumerate(xs)])).alias("c")).select("g", "c.*")
    mid = stage(quantile(long, ["g", "i"], "x", F.floor(F.col("x") / F.col("step")), 0.5, "mid"), "medians")
    off = long.join(hint(mid), ["g", "i"]).withColumn("x", F.abs(F.col("x") - F.col("mid")))
    dev = quantile(off, ["g", "i"], "x", F.floor(F.col("x") / F.col("step")), 0.5, "dev")
    wide = mid.join(dev, ["g", "i"]).groupBy("g").agg(
        *[F.max(F.when(F.col("i") == i, F.col("mid"))).alias(f"m{i}") for i in range(d)],
        *[F.max(F.when(F.col("i") == i, F.greatest(F.col("dev") * 1.4826, F.lit(floors[i])))).alias(f"a{i}") for i in range(d)],
    )
    wide = stage(wide, "deviations")
    z = rows.join(hint(wide), "g").selectExpr("g", *[f"(`{x}` - m{i}) / a{i} AS z{i}" for i, x in enumerate(xs)])
    z = z.selectExpr("*", "sqrt(" + " + ".join(f"z{i} * z{i}" for i in range(d)) + " + 1e-12D) AS r")
    z = z.selectExpr("g", *[f"z{i} / r AS z{i}" for i in range(d)], *[f"tanh(z{i}) AS t{i}" for i in range(d)])
    turned, squashed = [f"z{i}" for i in range(d)], [f"t{i}" for i in range(d)]
    sums = stage(z.groupBy("g").agg(F.count("*").alias("n"), *_sums(turned, "s", "q"), *_sums(squashed, "t", "p")).join(wide, "g"), "moments")
    found, ones = [], [0.05] * d
    shapes = (lambda i, j: f"{float(i == j)}D", lambda i, j: f"q{i}{j} / n + {0.0025 * (i == j)}D", _covariance("t", "p", ones))
    for k, cov in enumerate(shapes):
        found.append(_inverse_root(sums, d, cov, ones, "a").select("g", F.lit(k).alias("start"), *_names(d)))
    return stage(found[0].unionByName(found[1]).unionByName(found[2]), "starts")


def concentrated(rows: DataFrame, fit: DataFrame, xs: list[str], floors: list[float], nearest: float, hint) -> DataFrame:
    """One step: g, start, m_i, w_ij and logdet from the rows nearest to each estimate in fit."""
    d, key = len(xs), ["g", "start"]
    far = rows.join(hint(fit), "g").select(*key, _distance(xs).alias("d"))
    limit = stage(fit.drop("logdet").join(quantile(far, key, "d", _octave("d"), nearest, "limit"), key), "limits")
    near = rows.join(hint(limit), "g").filter(_distance(xs) <= F.col("limit"))
    sums = near.groupBy(*key).agg(F.count("*").alias("n"), *_sums([f"`{x}`" for x in xs], "s", "q"))
    out = _inverse_root(sums, d, _covariance("s", "q", floors), floors).selectExpr("*", *[f"s{i} / n AS m{i}" for i in range(d)])
    return stage(out.select(*key, *_names(d), "logdet"), "fit")


def mcd(rows: DataFrame, coords: dict[str, float] = COORDS, nearest=NEAREST) -> DataFrame:
    """g, m_i, w_ij and scale: an estimate for each group of rows, which have g and the coordinates."""
    xs, floors = list(coords), list(coords.values())
    n_groups = rows.select("g").distinct().count()
    hint = F.broadcast if n_groups <= 10_000 else lambda df: df  # a few numbers for each group
    fit = starts(rows, xs, floors, hint)
    for _ in range(FIRST_STEPS):
        fit = concentrated(rows, fit, xs, floors, nearest, hint)
    best = Window.partitionBy("g").orderBy("logdet", "start")
    going = fit.withColumn("_k", F.row_number().over(best)).filter("_k = 1").drop("_k")
    done = []
    while True:
        after = concentrated(rows, stage(going, "going"), xs, floors, nearest, hint)
        both = going.join(after.select("g", F.col("logdet").alias("_after")), "g")
        done.append(stage(both.filter(F.col("_after") >= F.col("logdet") - STILL).drop("_after"), "still"))
        going = stage(after.join(both.filter(F.col("_after") < F.col("logdet") - STILL).select("g"), "g"), "falling")
        if going.isEmpty():
            break
    fit = done[0]
    for more in done[1:]:
        fit = fit.unionByName(more)
    far = rows.join(hint(fit), "g").select("g", _distance(xs).alias("d"))
    scale = quantile(far, ["g"], "d", _octave("d"), 0.5, "scale").withColumn("scale", F.col("scale") / CHI2_MEDIAN[len(xs)])
    return stage(fit.drop("start", "logdet").join(scale, "g"), "estimates")


def verdicts(docs: DataFrame, coords: dict[str, float] = COORDS, least=LEAST_ROWS, cutoff=CUTOFF) -> DataFrame:
    """The counts of each document with distance (null where base_failed) and kept."""
    rows = stage(counts(docs), "counts")
    good = stage(grouped(vectors(rows.filter(~F.col("base_failed"))), least).select("_row", "g", "into", *coords), "vectors")
    fit = mcd(good.select(F.explode("into").alias("g"), *coords), coords)
    far = good.join(small(fit, 10_000), "g").select("_row", (_distance(list(coords)) / F.greatest("scale", F.lit(1.0))).alias("distance"))
    return rows.join(far, "_row", "left").withColumn("kept", F.coalesce(~F.col("base_failed") & (F.col("distance") <= cutoff), F.lit(False)))


def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
