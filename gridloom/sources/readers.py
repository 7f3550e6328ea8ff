"""Reading label maps, rasters, features, coordinates and reports.

All readers go through Spark, so a path can be in any store that Spark reads; .npy and uncompressed
TIFF files are decoded on the executors from the binaryFile source.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.vectors import detect_scales
from gridloom.operators.filters import in_samples, match_samples
from gridloom.operators.joins import nearest, nearest_or_fail
from gridloom.session import require, same_length
from gridloom.sources import tiff


def _arrays(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def _image(content: bytes) -> np.ndarray:
    return tiff.decode(content) if tiff.is_tiff(content) else np.load(io.BytesIO(content), allow_pickle=False)


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """y, x, label of an .npy or TIFF file, without background: a 2-D integer array, or a stack packed so that later planes win."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                a = _image(content)
                if a.ndim == 3:
                    out = np.zeros(a.shape[1:], np.int32)
                    for i, plane in enumerate(a, 1):
                        out[plane.astype(bool)] = i
                elif a.ndim == 2 and np.issubdtype(a.dtype, np.integer):
                    out = a
                else:
                    raise ValueError(f"not a label map: {a.ndim} dimensions of {a.dtype}")
                y, x = np.nonzero(out)
                yield pd.DataFrame({"y": y.astype("int32"), "x": x.astype("int32"), "label": out[y, x].astype("int32")})

    return _arrays(spark, path).mapInPandas(decode, "y int, x int, label int")


def binary_mask(spark: SparkSession, path: str) -> DataFrame:
    """y, x, v of an .npy or TIFF file: any plane of a stack, a boolean map as it is, an integer one where positive."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                a = _image(content)
                a = a.astype(bool).any(0) if a.ndim == 3 else a > 0
                y, x = np.indices(a.shape)
                yield pd.DataFrame({"y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "v": a.ravel()})

    return _arrays(spark, path).mapInPandas(decode, "y int, x int, v boolean")


def raster(spark: SparkSession, path: str, region: tuple[int, int, int, int] | None = None) -> DataFrame:
    """y, x, c, v of an .npy or TIFF image, gray or with channels; region (y0, y1, x0, x1) reads a part."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                a = _image(content)
                y0, y1, x0, x1 = region or (0, a.shape[0], 0, a.shape[1])
                a = a[y0:y1, x0:x1]
                a = a[:, :, None] if a.ndim == 2 else a
                y, x, c = np.indices(a.shape)
                yield pd.DataFrame({"y": (y + y0).ravel().astype("int32"), "x": (x + x0).ravel().astype("int32"), "c": c.ravel().astype("int32"), "v": a.ravel().astype(float)})

    return _arrays(spark, path).mapInPandas(decode, "y int, x int, c int, v double")


def raster_tiles(spark: SparkSession, folder: str, tile: int) -> DataFrame:
    """y, x, c, v of a folder of tiles as writers.tiff_tiles() leaves them, with places in the whole image."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                ty, tx = map(int, re.search(r"tile_(\d+)_(\d+)\.tif$", path).groups())
                a = _image(content)
                a = a[:, :, None] if a.ndim == 2 else a
                y, x, c = np.indices(a.shape)
                yield pd.DataFrame({"y": (y + ty * tile).ravel().astype("int32"), "x": (x + tx * tile).ravel().astype("int32"), "c": c.ravel().astype("int32"), "v": a.ravel().astype(float)})

    return spark.read.format("binaryFile").load(f"{folder}/*.tif").select("path", "content").mapInPandas(decode, "y int, x int, c int, v double")


def image_size(spark: SparkSession, path: str, default: tuple[int, int] = (1000, 1000)) -> tuple[int, int]:
    """(width, height) of an .npy or TIFF image from its header; the default if it can't be read."""

    def shape(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                if tiff.is_tiff(content):
                    w, h = tiff.size(content)
                    yield pd.DataFrame({"w": [w], "h": [h]})
                    continue
                f = io.BytesIO(content)
                version = np.lib.format.read_magic(f)
                got = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)[0]
                yield pd.DataFrame({"w": [got[1]], "h": [got[0]]})

    try:
        r = _arrays(spark, path).mapInPandas(shape, "w int, h int").first()
        return (r["w"], r["h"]) if r else default
    except Exception:  # noqa: BLE001  a probe: whatever is wrong with the file, there is a default
        return default


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def features(spark: SparkSession, parquet: str, fallback_csv: str) -> DataFrame:
    """Features from Parquet, or else from CSV."""
    try:
        return spark.read.parquet(parquet)
    except AnalysisException:
        return csv(spark, fallback_csv)


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """nucleus_id (the row), v of an .npy matrix."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                a = np.load(io.BytesIO(content), allow_pickle=False).astype("float32")
                for i in range(0, len(a), 10_000):
                    yield pd.DataFrame({"nucleus_id": np.arange(i, min(i + 10_000, len(a))), "v": list(a[i : i + 10_000])})

    return _arrays(spark, path).mapInPandas(decode, "nucleus_id bigint, v array<float>")


def aligned(points: DataFrame, spots: DataFrame, samples: list[str], max_distance: float = 50.0) -> DataFrame:
    """Each point of the samples with its nearest spot of the same sample; an error if none is near enough."""
    return nearest_or_fail(in_samples(points, samples), in_samples(spots, samples), max_distance, ["sample"])


def matched(points: DataFrame, spots: DataFrame, samples: list[str], max_distance: float = 100.0) -> DataFrame:
    """Each spot of the samples with its nearest point nearer than the distance."""
    return nearest(in_samples(spots, samples), in_samples(points, samples), max_distance, ["sample"], strict=True)


def features_of_scales(df: DataFrame, scales: list[int], prefix: str = "vit") -> DataFrame:
    """Only the columns of these scales, in file order, as FLOAT; an error if there is none. The scan reads no others."""
    ranges = detect_scales(df.columns, prefix)
    wanted = [c for s in scales if s in ranges for c in df.columns[slice(*ranges[s])]]
    chosen = [c for c in df.columns if c in set(wanted) and c.startswith(prefix)]
    if not chosen:
        raise ValueError(f"no columns of the scales {scales}")
    return df.select(*[F.col(c).cast("float") for c in chosen])


def triple(coords: DataFrame, vectors: DataFrame, spots: DataFrame, samples: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Coordinates and vectors of equal length, and the spots of the samples."""
    same_length(coords, vectors)
    return coords, vectors, in_samples(spots, samples) if samples else spots


def validated_pair(points: DataFrame, spots: DataFrame, samples: list[str], column: str, point_label: str = "cluster") -> tuple[DataFrame, DataFrame]:
    """Both tables after column checks, in the samples (by exact or loose name), without missing labels."""
    require(points, "x", "y", "sample", point_label)
    require(spots, "x", "y", "sample", column)
    return match_samples(points, samples).dropna(subset=[point_label]), match_samples(spots, samples).dropna(subset=[column])


def metrics_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def discover(spark: SparkSession, pattern: str) -> DataFrame:
    """configuration, path: the folder and path of each file of a glob pattern, by listing only."""
    files = spark.read.format("binaryFile").load(pattern).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("configuration"), "path").distinct()


def patch_sizes(name: Column) -> Column:
    """primary_size, sizes, is_combination of a configuration name, the most specific pattern first; 32 otherwise."""
    # The pattern in a name, its primary size and its sizes.
    rules = (("_16_32_64px", 37, (16, 32, 64)), ("_16_32px", 24, (16, 32)), ("_32_64px", 48, (32, 64)), ("_16px", 16, (16,)), ("_32px", 32, (32,)), ("_64px", 64, (64,)))

    def entry(primary: int, sizes: tuple[int, ...]) -> Column:
        return F.struct(F.lit(primary).alias("primary_size"), F.array(*map(F.lit, sizes)).alias("sizes"), F.lit(len(sizes) > 1).alias("is_combination"))

    out = F.when(F.contains(name, F.lit(rules[0][0])), entry(*rules[0][1:]))
    for pattern, primary, sizes in rules[1:]:
        out = out.when(F.contains(name, F.lit(pattern)), entry(primary, sizes))
    return out.otherwise(entry(32, (32,)))


def validate_inputs(points: DataFrame, spots: DataFrame, columns: tuple[list[str], list[str]], samples: list[str]) -> list[str]:
    """Names of expected samples that a table lacks (not an error); missing columns are one."""
    require(points, *columns[0])
    require(spots, *columns[1])
    want = points.sparkSession.createDataFrame([(s,) for s in samples], "sample string")
    missing = [want.join(t.select("sample").distinct(), "sample", "left_anti") for t in (points, spots)]
    return sorted({r["sample"] for m in missing for r in m.collect()})
