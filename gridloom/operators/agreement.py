"""How well two labelings agree: everything from the contingency table, in DOUBLE.

The table is one aggregate over the data; all statistics are aggregates over its cells.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.aggregates import contingency


def _pairs(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / F.lit(2.0)


def _x_log_x(p: Column) -> Column:
    return F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0))


def agreement(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Per group: n, n_a, n_b (distinct labels), ari, nmi, accuracy, kappa."""
    return from_cells(contingency(df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b, by), by)


def from_cells(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    part = Window.partitionBy(*by)
    # Labels by labels: dealt by group once, after which all windows and joins below need no shuffle.
    cells = cells.repartition(*by) if by else cells.coalesce(1)
    c = cells.withColumn("ra", F.sum("n").over(Window.partitionBy(*by, "a"))).withColumn("rb", F.sum("n").over(Window.partitionBy(*by, "b")))
    c = c.withColumn("total", F.sum("n").over(part).cast("double"))
    # Each margin is counted once, on the first cell of its row or column.
    c = c.withColumn("fa", F.row_number().over(Window.partitionBy(*by, "a").orderBy("b")) == 1).withColumn("fb", F.row_number().over(Window.partitionBy(*by, "b").orderBy("a")) == 1)
    p, pa, pb = F.col("n").cast("double") / F.col("total"), F.col("ra").cast("double") / F.col("total"), F.col("rb").cast("double") / F.col("total")
    once = lambda flag, x: F.sum(F.when(F.col(flag), x).otherwise(F.lit(0.0)))
    s = c.groupBy(*by).agg(
        F.max("total").alias("total"), F.sum(_pairs(F.col("n"))).alias("index"), once("fa", _pairs(F.col("ra"))).alias("sa"), once("fb", _pairs(F.col("rb"))).alias("sb"),
        F.sum(p * F.log(p / (pa * pb))).alias("mi"), (-once("fa", _x_log_x(pa))).alias("ha"), (-once("fb", _x_log_x(pb))).alias("hb"),
        F.sum(F.when(F.col("a") == F.col("b"), p).otherwise(F.lit(0.0))).alias("po"), F.sum(F.when(F.col("fa"), 1).otherwise(0)).alias("n_a"), F.sum(F.when(F.col("fb"), 1).otherwise(0)).alias("n_b"))
    chance = _chance(c, by)
    s = s.join(chance, by) if by else s.crossJoin(chance)
    expected = F.col("sa") * F.col("sb") / F.nullif(_pairs(F.col("total")), F.lit(0.0))
    most = (F.col("sa") + F.col("sb")) / F.lit(2.0)
    ari = F.coalesce((F.col("index") - expected) / F.nullif(most - expected, F.lit(0.0)), F.lit(1.0))
    mean_h = (F.col("ha") + F.col("hb")) / F.lit(2.0)
    nmi = F.when((F.col("n_a") == 1) & (F.col("n_b") == 1), F.lit(1.0)).when(F.col("mi") <= 1e-15, F.lit(0.0)).otherwise(F.col("mi") / F.nullif(mean_h, F.lit(0.0)))
    kappa = F.coalesce((F.col("po") - F.col("pe")) / F.nullif(F.lit(1.0) - F.col("pe"), F.lit(0.0)), F.lit(1.0))
    return s.select(*by, F.col("total").cast("bigint").alias("n"), "n_a", "n_b", ari.alias("ari"), nmi.alias("nmi"), F.col("po").alias("accuracy"), kappa.alias("kappa"))


def _chance(c: DataFrame, by: list[str]) -> DataFrame:
    """by, pe: the sum over labels of the product of both sides' shares."""
    a = c.filter("fa").select(*by, F.col("a").cast("string").alias("label"), (F.col("ra").cast("double") / F.col("total")).alias("share"), F.lit(0).alias("side"))
    b = c.filter("fb").select(*by, F.col("b").cast("string").alias("label"), (F.col("rb").cast("double") / F.col("total")).alias("share"), F.lit(1).alias("side"))
    both = a.unionByName(b).groupBy(*by, "label").agg(F.sum(F.when(F.col("side") == 0, F.col("share")).otherwise(F.lit(0.0))).alias("p"), F.sum(F.when(F.col("side") == 1, F.col("share")).otherwise(F.lit(0.0))).alias("q"))
    return both.groupBy(*by).agg(F.sum(F.col("p") * F.col("q")).alias("pe"))


def cramers_v(df: DataFrame, a: str, b: str, yates: bool = True) -> DataFrame:
    """One row: chi2, cramers_v, over the full grid of labels; 2 x 2 tables get the continuity correction.

    Both are null where a margin is one label only.
    """
    cells = contingency(df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b)
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("ra")), cells.groupBy("b").agg(F.sum("n").alias("rb"))
    grid = rows.crossJoin(F.broadcast(cols)).join(cells, ["a", "b"], "left")  # labels by labels
    total, k, m = (F.sum("n").over(Window.partitionBy()).cast("double"), F.size(F.collect_set("a").over(Window.partitionBy())), F.size(F.collect_set("b").over(Window.partitionBy())))
    grid = grid.withColumn("total", total).withColumn("k", k).withColumn("m", m)
    expected = F.col("ra").cast("double") * F.col("rb").cast("double") / F.col("total")
    off = F.abs(F.coalesce(F.col("n").cast("double"), F.lit(0.0)) - expected)
    if yates:
        off = F.when((F.col("k") == 2) & (F.col("m") == 2), F.greatest(off - F.least(F.lit(0.5), off), F.lit(0.0))).otherwise(off)
    s = grid.agg(F.sum(off * off / expected).alias("chi2"), F.max("total").alias("total"), F.max("k").alias("k"), F.max("m").alias("m"))
    least = F.least("k", "m").cast("double") - 1
    return s.select(F.when(least > 0, F.col("chi2")).alias("chi2"), F.sqrt(F.when(least > 0, F.col("chi2")) / F.nullif(F.col("total") * least, F.lit(0.0))).alias("cramers_v"))


def band_by_thirds(score: Column) -> Column:
    return F.when(score > 0.7, "high").when(score > 0.3, "moderate").otherwise("low")


def band_by_strength(score: Column) -> Column:
    return F.when(score > 0.5, "strong").when(score > 0.3, "moderate").when(score > 0.1, "weak").otherwise("very weak")


def _table(cells: DataFrame) -> np.ndarray:
    """The contingency table as an array: labels by labels."""
    rows = cells.toPandas().pivot_table(index="a", columns="b", values="n", fill_value=0, aggfunc="sum")
    return rows.to_numpy().astype(np.int64)


def ari_of(table: np.ndarray) -> float:
    c2 = lambda x: (x * (x - 1.0) / 2).sum()
    n = table.sum()
    sa, sb, index = c2(table.sum(1)), c2(table.sum(0)), c2(table)
    expected = sa * sb / c2(np.array([n])) if n > 1 else 0.0
    return 1.0 if (sa + sb) / 2 == expected else float((index - expected) / ((sa + sb) / 2 - expected))


def nmi_of(table: np.ndarray) -> float:
    p = table / table.sum()
    pa, pb = p.sum(1), p.sum(0)
    entropy = lambda q: -(q[q > 0] * np.log(q[q > 0])).sum()
    mi = entropy(pa) + entropy(pb) - entropy(p.ravel())
    if (pa > 0).sum() == 1 and (pb > 0).sum() == 1:
        return 1.0
    return 0.0 if mi <= 1e-15 else float(2 * mi / (entropy(pa) + entropy(pb)))


def ari_bootstrap(cells: DataFrame, times: int = 1000, seed: int = 0) -> dict[str, float]:
    """Confidence interval of the ARI. Drawing rows again is drawing a table from the cells' shares: the data are not read again."""
    table = _table(cells)
    rng, n = np.random.default_rng(seed), int(table.sum())
    draws = rng.multinomial(n, (table / n).ravel(), size=times).reshape(times, *table.shape)
    values = np.array([ari_of(t) for t in draws])
    low, high = np.percentile(values, [2.5, 97.5])
    return {"ari": ari_of(table), "low": float(low), "high": float(high), "std": float(values.std())}


def nmi_permutation(cells: DataFrame, times: int = 1000, seed: int = 0) -> dict[str, float]:
    """NMI and the share of permuted labelings that reach it: permuting is drawing a table with the same margins."""
    table = _table(cells)
    rng, a, b = np.random.default_rng(seed), table.sum(1), table.sum(0)
    seen = nmi_of(table)
    hits = 0
    for _ in range(times):
        left, drawn = b.copy(), []
        for n in a[:-1]:
            drawn.append(rng.multivariate_hypergeometric(left, n))
            left = left - drawn[-1]
        hits += nmi_of(np.array([*drawn, left])) >= seen
    return {"nmi": seen, "p_value": hits / times}
