"""Each point's nearest among others, without the pairs that are merely close.

The right side is dealt into tiles, about equally full, by a tree of boxes over a bounded sample of it; whichever tile
a point goes to, the tiles' boxes are then taken from all their points, so results do not depend on the sample. A left
point meets the tile whose box is nearest, and after that only those other tiles that could hold a point as near as
the one found. Within a tile a tree of boxes gives the nearest. Work is in proportion to the points (times the depth
of the trees), however many lie within the distance. `z` is a group's code: points of different groups never meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import cleared, scratch, small, with_ids, written

#: Points of the sample that tiles are drawn from; the most points of a tile, up to TILES of them; points of a box at the least.
PROBE, TILE, TILES, LEAF = 1 << 17, 8192, 4096, 16
#: Queries that are answered at a time, and pairs of a query and a box or point beyond which they are halved.
QUERIES, PAIRS = 4096, 1 << 21


def _gap(q, lo, hi):
    """Distance from points to boxes, row by row; never more than that to a point in the box, rounding included."""
    g = np.maximum(np.maximum(lo - q, q - hi), 0)
    return np.where(g[:, 0] > 0, np.inf, np.sqrt(g[:, 1] * g[:, 1] + g[:, 2] * g[:, 2]))


def tree(p, leaf: int):
    """order, cuts, levels: points z, x, y halved by place along the wider axis (z first) while leaves have so many; each level's boxes."""
    n = len(p)
    deep, order, levels = int(np.log2(max(n // leaf, 1))), np.arange(n), []
    for level in range(deep + 1):
        cuts = (np.arange((1 << level) + 1) * n) >> level
        s = p[order]
        lo, hi = np.minimum.reduceat(s, cuts[:-1]), np.maximum.reduceat(s, cuts[:-1])
        levels.append((lo, hi))
        if level < deep:
            wide, node = hi - lo, np.repeat(np.arange(1 << level), np.diff(cuts))
            axis = np.where(wide[:, 0] > 0, 0, 1 + (wide[:, 2] > wide[:, 1]))
            order = order[np.lexsort((s[np.arange(n), axis[node]], node))]
    return order, cuts, levels


def above(lo, hi):
    """The levels over a power of two of boxes."""
    levels = [(lo, hi)]
    while len(lo) > 1:
        lo, hi = np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2])
        levels.insert(0, (lo, hi))
    return levels


def _descend(levels, q):
    node = np.zeros(len(q), dtype=np.int64)
    for lo, hi in levels[1:]:
        a, b = 2 * node, 2 * node + 1
        node = np.where(_gap(q, lo[b], hi[b]) < _gap(q, lo[a], hi[a]), b, a)
    return node


def _within(levels, q, most):
    """i, leaf, gap: the leaves within each query's distance, by query."""
    i, node, gap = np.arange(len(q)), np.zeros(len(q), dtype=np.int64), np.zeros(len(q))
    for level, (lo, hi) in enumerate(levels):
        if level:
            i, node = np.repeat(i, 2), np.repeat(2 * node, 2)
            node[1::2] += 1
        gap = _gap(q[i], lo[node], hi[node])
        ok = (gap <= most[i]) & (gap < np.inf)
        i, node, gap = i[ok], node[ok], gap[ok]
        if len(i) > PAIRS and len(q) > 1:
            half = len(q) // 2
            (a, b, c), (d, e, f) = _within(levels, q[:half], most[:half]), _within(levels, q[half:], most[half:])
            return np.concatenate([a, d + half]), np.concatenate([b, e]), np.concatenate([c, f])
    return i, node, gap


def _least(i, value, n: int, none):
    """The least value of each of n queries; pairs are ordered by query."""
    out = np.full(n, none, dtype=value.dtype)
    if len(i):
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        out[i[starts]] = np.minimum.reduceat(value, starts)
    return out


def home(levels, q, most):
    """The leaf whose box is nearest to each query; -1 where none is within its distance."""
    at = _descend(levels, q)
    i, node, gap = _within(levels, q, np.minimum(most, _gap(q, levels[-1][0][at], levels[-1][1][at])))
    best = _least(i, gap, len(q), np.inf)
    ok = gap == best[i]
    return _least(i[ok], node[ok], len(q), -1)


def closest(p, q, most):
    """dist, place: the nearest of the points to each query within its distance, of equally near ones the first; inf, -1 without one."""
    order, cuts, levels = tree(p, LEAF)

    def reach(q, most, i, node):
        sizes = cuts[node + 1] - cuts[node]
        k = np.repeat(i, sizes)
        at = order[np.arange(len(k)) + np.repeat(cuts[node] - (np.cumsum(sizes) - sizes), sizes)]
        g = q[k] - p[at]
        d = np.where(g[:, 0] == 0, np.sqrt(g[:, 1] * g[:, 1] + g[:, 2] * g[:, 2]), np.inf)
        ok = (d <= most[k]) & (d < np.inf)
        return k[ok], at[ok], d[ok]

    def answer(q, most):
        n = len(q)
        k, _, d = reach(q, most, np.arange(n), _descend(levels, q))
        bound = np.minimum(most, _least(k, d, n, np.inf))
        i, node, _ = _within(levels, q, bound)
        if len(i) * 2 * LEAF > PAIRS and n > 1:
            half = n // 2
            return [np.concatenate(x) for x in zip(answer(q[:half], bound[:half]), answer(q[half:], bound[half:]), strict=True)]
        k, at, d = reach(q, bound, i, node)
        best = _least(k, d, n, np.inf)
        ok = d == best[k]
        return best, _least(k[ok], at[ok], n, -1)

    parts = [answer(q[s : s + QUERIES], most[s : s + QUERIES]) for s in range(0, len(q), QUERIES)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0), np.zeros(0, dtype=np.int64))


def _zxy(t, side: str):
    return np.column_stack([np.asarray(t[c]).astype(float) for c in ("_z", f"{side}_x", f"{side}_y")])


def _finite(side: str) -> Column:
    return (F.abs(f"{side}_x") < float("inf")) & (F.abs(f"{side}_y") < float("inf"))


def _dealt(df: DataFrame, levels, side: str) -> DataFrame:
    """df with the _tile nearest to each point; without those that have none within _most."""

    def run(batches):
        for b in batches:
            q = _zxy(b, side)
            most = b["_most"].to_numpy() if side == "l" else np.full(len(q), np.inf)
            at = home(levels, q, most)
            yield b.append_column("_tile", pa.array(at.astype("int32"))).filter(pa.array(at >= 0))

    return df.mapInArrow(run, df.withColumn("_tile", F.lit(0)).schema)


def _others(met: DataFrame, levels) -> DataFrame:
    """Left points again with each further tile within the distance found (dist, else _most)."""
    kept = [c for c in met.columns if c != "dist" and not c.startswith("r_")]

    def run(batches):
        for b in batches:
            most = np.fmin(b["dist"].to_numpy(zero_copy_only=False).astype(float), b["_most"].to_numpy())
            i, node, _ = _within(levels, _zxy(b, "l"), most)
            more = node != b["_tile"].to_numpy()[i]
            i, node, most = i[more], node[more].astype("int32"), most[i[more]]
            out = b.select(kept).take(pa.array(i))
            for c, x in (("_most", most), ("_tile", node)):
                out = out.set_column(kept.index(c), c, pa.array(x))
            yield out

    return met.select(*kept, "dist").mapInArrow(run, met.select(*kept).schema)


def _meet(left: DataFrame, tiles: DataFrame, rows: int) -> DataFrame:
    """Left points with dist and the columns of the nearest point of their _tile within _most (null: none); at most so many meet a tile in one group."""
    shares = F.broadcast(written(left.groupBy("_tile").agg(F.ceil(F.count("*") / rows).cast("int").alias("_shares")), "shares"))  # a row per tile
    a = left.join(shares, "_tile").withColumn("_share", F.pmod(F.xxhash64("l_id", "l_x", "l_y"), "_shares").cast("int"))
    b = tiles.join(shares, "_tile").withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    l_cols, r_cols = left.columns, [c for c in tiles.columns if c.startswith("r_")]
    schema = tiles.select(*r_cols).schema
    out = left.withColumn("dist", F.lit(0.0)).schema
    for f in schema.fields:
        out = out.add(f.name, f.dataType, True)
    for f in out.fields:
        f.nullable = True

    def run(met, r):
        r = r.sort_by("r_id")
        dist, place = np.full(len(met), np.inf), np.full(len(met), -1)
        if len(met) and len(r):
            dist, place = closest(_zxy(r, "r"), _zxy(met, "l"), np.asarray(met["_most"]))
        got = r.select(r_cols).take(pa.array(place, mask=place < 0))
        met = met.select(l_cols).append_column("dist", pa.array(dist, mask=place < 0))
        for c in r_cols:
            met = met.append_column(c, got[c])
        return met

    keys = ["_tile", "_share"]
    return a.drop("_shares").groupBy(*keys).cogroup(b.drop("_shares").groupBy(*keys)).applyInArrow(run, out)


def _tiled(right: DataFrame, n: int, per: int) -> tuple[DataFrame, list]:
    """The right points, each place once, with their _tile, and the levels of boxes over the tiles; n: how many there are about."""
    part = min(1.0, PROBE / n)
    some = right.filter(F.pmod(F.xxhash64("r_id", "r_x", "r_y"), F.lit(1 << 30)) < int(part * (1 << 30))) if part < 1 else right
    probe = np.unique(_zxy(some.select("_z", "r_x", "r_y").toArrow(), "r"), axis=0)
    probe = probe if len(probe) else np.zeros((1, 3))
    tiles = min(TILES, -(-n // per))
    levels = tree(probe, max(1, len(probe) // tiles))[2]
    cols = [c for c in right.columns if c.startswith("r_") and c not in ("r_id", "r_x", "r_y")]
    places = right.groupBy("_z", "r_x", "r_y").agg(F.min(F.struct("r_id", *cols)).alias("_r")).select("_z", "r_x", "r_y", "_r.*")
    dealt = written(_dealt(places, levels, "r"), "tiles")
    ends = dealt.groupBy("_tile").agg(*[f(c) for f in (F.min, F.max) for c in ("_z", "r_x", "r_y")]).toArrow()  # a row per tile
    lo, hi = np.full((len(levels[-1][0]), 3), np.inf), np.full((len(levels[-1][0]), 3), -np.inf)
    at, ends = np.asarray(ends["_tile"]), np.column_stack([np.asarray(c) for c in ends.columns[1:]]).astype(float)
    lo[at], hi[at] = ends[:, :3], ends[:, 3:]
    return dealt, above(lo, hi)


def nearest(left: DataFrame, right: DataFrame, max_distance: float, on: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Each left point's nearest right point within max_distance (below it, if strict); of equally near ones the lowest id.

    Left points without one are left out. Columns get the prefixes l_ and r_; those of `on` stay as they are.
    """
    spark = left.sparkSession
    path = scratch(spark, "nearest")
    with cleared(spark):
        best = _nearest(left, right, float(np.nextafter(max_distance, -np.inf)) if strict else float(max_distance), on or [])
        best.write.parquet(path)
    return spark.read.schema(best.schema).parquet(path)


def _nearest(left: DataFrame, right: DataFrame, most: float, on: list[str]) -> DataFrame:
    a = left.select(*on, *[F.col(c).alias(f"l_{c}") for c in left.columns if c not in on]).filter(_finite("l"))
    b = right.select(*on, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in on]).filter(_finite("r"))
    l_cols, r_cols = ([c for c in df.columns if c not in [*on, f"{s}_id"]] for df, s in ((a, "l"), (b, "r")))
    n = b.count()
    if not n:
        return a.join(b, on or F.lit(True)).withColumn("dist", F.lit(0.0)).select(*on, "l_id", *l_cols, "dist", "r_id", *r_cols)
    if on:
        code = small(written(with_ids(b.select(*on).dropna().distinct(), on, "_z").withColumn("_z", F.col("_z").cast("double")), "groups"))
        a, b = a.join(code, on), b.join(code, on).drop(*on)
    else:
        a, b = a.withColumn("_z", F.lit(0.0)), b.withColumn("_z", F.lit(0.0))
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles, levels = _tiled(b, n, min(TILE, max(TILE // 32, n // (2 * parts))))
    placed = written(_dealt(a.withColumn("_most", F.lit(most)), levels, "l"), "placed")
    rows = max(TILE // 32, 2 * placed.count() // len(levels[-1][0]))
    met = written(_meet(placed, tiles, rows), "met")
    again = written(_others(met, levels), "again")
    found = met.unionByName(_meet(again, tiles, rows)).filter(F.col("dist").isNotNull())
    best = found.groupBy("l_id").agg(F.min(F.struct("dist", "r_id", *r_cols)).alias("_best"), *[F.first(c).alias(c) for c in [*on, *l_cols]])
    return best.select(*on, "l_id", *l_cols, "_best.*")
