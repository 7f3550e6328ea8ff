"""Writing results. Tables are Parquet or CSV folders; small reports are JSON or text through Spark too."""

from __future__ import annotations

import io
import json
import logging
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.clustering import ClusterModel
from gridloom.sources import tiff


def _text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def plain(value):
    """numpy values as plain ones, for JSON."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, np.ndarray):
        return plain(value.tolist())
    return value.item() if isinstance(value, np.generic) else value


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    _text(spark, json.dumps(plain(value), indent=2), path)


def labels_by_pass(metrics: DataFrame, folder: str) -> None:
    """passed and failed labels, their counts, and the metrics table. metrics: label, passed, and more."""
    spark = metrics.sparkSession
    metrics.filter("passed").select("label").write.mode("overwrite").parquet(f"{folder}/passed")
    metrics.filter("NOT passed").select("label").write.mode("overwrite").parquet(f"{folder}/failed")
    n = metrics.agg(F.count(F.when(F.col("passed"), 1)).alias("passed"), F.count(F.when(~F.col("passed"), 1)).alias("failed")).first()
    write_json(spark, n.asDict(), f"{folder}/counts")
    metrics.write.mode("overwrite").option("header", True).csv(f"{folder}/metrics")


def mask_stack(pixels: DataFrame, passed: DataFrame, path: str) -> None:
    """Pixels of passed labels, a folder per label."""
    pixels.join(passed.select("label").distinct(), "label", "left_semi").write.mode("overwrite").partitionBy("label").parquet(path)


def features(vectors: DataFrame, coords: DataFrame, meta: DataFrame, folder: str, by_scale: bool = False) -> None:
    """Vectors (a folder per scale, if asked), coordinates and the fusion's settings."""
    writer = vectors.write.mode("overwrite")
    (writer.partitionBy("scale") if by_scale else writer).parquet(f"{folder}/features")
    coords.write.mode("overwrite").parquet(f"{folder}/coords")
    meta.write.mode("overwrite").json(f"{folder}/fusion")


def clusters(points: DataFrame, centers: DataFrame, folder: str, model: ClusterModel | None = None) -> None:
    """Clusters and centres, and the model (scaler and centres) by which further vectors find theirs."""
    points.write.mode("overwrite").option("header", True).csv(f"{folder}/clusters")
    centers.write.mode("overwrite").parquet(f"{folder}/centers")
    if model is not None:
        model.save(points.sparkSession, f"{folder}/model")


def report_text(metrics: dict) -> str:
    """What the figures of a comparison of two labelings say; parts without figures are left out.

    metrics: ari (score, low, high, std), nmi (score, p_value, mean, std), silhouettes (first, second),
    effects (kappa, cramers_v, coherence) and matches (accuracy, n, rows of label, best, fraction).
    """
    out = ["Agreement of two labelings", ""]

    def part(title: str, *lines: str) -> None:
        out.extend([title, *(f"  {x}" for x in lines), ""])

    if m := metrics.get("ari"):
        band = "strong" if m["score"] > 0.7 else "moderate" if m["score"] > 0.3 else "weak"
        part("Adjusted Rand index", f"{m['score']:.4f}, 95 % interval {m['low']:.4f} to {m['high']:.4f}, bootstrap error {m['std']:.4f}", f"{band} alignment")
    if m := metrics.get("nmi"):
        verdict = "significant" if m["p_value"] < 0.05 else "not significant"
        part("Normalised mutual information", f"{m['score']:.4f}, p = {m['p_value']:.4f} by permutation", f"by chance {m['mean']:.4f}, deviation {m['std']:.4f}", verdict)
    if m := metrics.get("silhouettes"):
        part("Silhouettes", f"first {m['first']:.4f}, second {m['second']:.4f}, difference {m['first'] - m['second']:.4f}", f"the {'first' if m['first'] > m['second'] else 'second'} is more coherent in space")
    if m := metrics.get("effects"):
        part("Effects", f"kappa {m['kappa']:.4f}", f"Cramer's V {m['cramers_v']:.4f}", f"coherence {m['coherence']:.4f}")
    if m := metrics.get("matches"):
        part("Best matches", f"accuracy {m['accuracy']:.4f} over {m['n']:,} points", *(f"{r['label']} -> {r['best']} ({r['fraction']:.2%})" for r in m["rows"]))
    return "\n".join(out)


def metrics_bundle(spark: SparkSession, metrics: dict, silhouettes: dict[str, DataFrame], cells: DataFrame, folder: str) -> None:
    """Metrics as JSON, silhouettes of all labelings as one table, the contingency table with its labels, and a summary."""
    write_json(spark, metrics, f"{folder}/metrics")
    parts = [df.withColumn("labeling", F.lit(name)) for name, df in silhouettes.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every.write.mode("overwrite").option("header", True).csv(f"{folder}/silhouettes")
    cells.groupBy("a").pivot("b").agg(F.first("n")).na.fill(0).write.mode("overwrite").option("header", True).csv(f"{folder}/confusion")
    _text(spark, report_text(plain(metrics)) if isinstance(metrics.get("ari"), dict) else "\n".join(f"{k}: {v}" for k, v in plain(metrics).items()), f"{folder}/summary")


def spatial_bundle(analysed: DataFrame, local: DataFrame, folder: str) -> None:
    """The analysis per sample as JSON and CSV, and the local statistics as CSV."""
    analysed.write.mode("overwrite").json(f"{folder}/spatial")
    analysed.write.mode("overwrite").option("header", True).csv(f"{folder}/autocorrelation")
    local.write.mode("overwrite").option("header", True).csv(f"{folder}/local")


def comparison_report(results: DataFrame, folder: str) -> None:
    """results: scales, K, sample, and metrics. A folder per scales and K, and the best row by mean ari."""
    results.write.mode("overwrite").partitionBy("scales", "K").option("header", True).csv(f"{folder}/by_k")
    means = results.groupBy("scales", "K").agg(F.avg("ari").alias("ari"))
    means.orderBy(F.desc("ari"), "scales", "K").limit(1).write.mode("overwrite").json(f"{folder}/best")


def metric_rows(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, value: a row per metric."""
    return df.unpivot(keys, metrics, "metric", "value")


def quality_report(assessed: DataFrame, recommendations: DataFrame, folder: str) -> None:
    assessed.write.mode("overwrite").option("header", True).csv(f"{folder}/quality")
    recommendations.write.mode("overwrite").json(f"{folder}/recommendations")


def cluster_statistics(points: DataFrame, label: str) -> DataFrame:
    """label, n, pct: cluster sizes as counts and per cent."""
    n = points.groupBy(label).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_t"))
    return n.crossJoin(F.broadcast(total)).select(label, "n", (F.col("n").cast("double") / F.col("_t") * 100).alias("pct"))


def _store(path: str):
    """The store of a path, as executors see it, and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def image(pixels: DataFrame, path: str, height: int, width: int, values: list[str], dtype: str = "uint8", strip_rows: int = 256) -> None:
    """One image file (.npy, or else TIFF) of the values of pixels (y, x); 0 where there is no pixel.

    A file has one writer, which takes the pixels in row order and holds one strip; a finished file
    takes its name at once, so a task that is tried again leaves no half of one. Large images are
    better written by tiff_tiles().
    """
    kind, npy = np.dtype(dtype).newbyteorder("<"), path.endswith(".npy")
    shape = (height, width) if len(values) == 1 else (height, width, len(values))
    if npy:
        head = io.BytesIO()
        np.lib.format.write_array_header_1_0(head, {"descr": np.lib.format.dtype_to_descr(kind), "fortran_order": False, "shape": shape})
        first = head.getvalue()
    else:
        first = tiff.header(height, width, len(values), kind, strip_rows)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = _store(path)
        store.create_dir(place.rsplit("/", 1)[0], recursive=True)
        part = f"{place}.{uuid.uuid4().hex}"
        blank = np.zeros((strip_rows, width, len(values)), kind)
        strip, at = blank.copy(), 0
        with store.open_output_stream(part) as out:
            out.write(first)

            def flush(upto: int) -> None:
                nonlocal at, strip
                while at < upto:
                    out.write(np.ascontiguousarray(strip[: min(strip_rows, height - at * strip_rows)]).tobytes())
                    strip, at = blank.copy(), at + 1

            for batch in batches:
                y, x = (batch.column(c).to_numpy() for c in (0, 1))
                v = np.stack([batch.column(2 + c).to_numpy() for c in range(len(values))], 1).astype(kind)
                for k in np.unique(y // strip_rows):
                    flush(int(k))
                    mine = y // strip_rows == k
                    strip[y[mine] - k * strip_rows, x[mine]] = v[mine]
            flush(-(-height // strip_rows))
        store.move(part, place)
        yield pa.record_batch([pa.array([place])], ["path"])

    rows = pixels.filter((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width)).select("y", "x", *[F.col(v).cast("double") for v in values])
    rows.repartition(1).sortWithinPartitions("y", "x").mapInArrow(write, "path string").collect()


def tiff_tiles(pixels: DataFrame, folder: str, height: int, width: int, values: list[str], dtype: str = "uint8", tile: int = 512) -> None:
    """An image as TIFF files of tile * tile pixels, tile_<row>_<column>.tif, written side by side; tiles without pixels are left out."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(pdf["tile_y"].iloc[0]), int(pdf["tile_x"].iloc[0])
        a = np.zeros((min(tile, height - ty * tile), min(tile, width - tx * tile), len(values)), dtype)
        a[pdf["y"].to_numpy() - ty * tile, pdf["x"].to_numpy() - tx * tile] = pdf[values].to_numpy().astype(dtype)
        store, place = _store(f"{folder}/tile_{ty}_{tx}.tif")
        store.create_dir(place.rsplit("/", 1)[0], recursive=True)
        part = f"{place}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(tiff.encode(a))
        store.move(part, place)
        return pd.DataFrame({"path": [place]})

    rows = pixels.filter((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width)).select("y", "x", *values)
    rows = rows.withColumn("tile_y", F.floor(F.col("y") / tile).cast("int")).withColumn("tile_x", F.floor(F.col("x") / tile).cast("int"))
    rows.groupBy("tile_y", "tile_x").applyInPandas(write, "path string").collect()  # a name per tile


def image_tiles(pixels: DataFrame, path: str, tile: int = 512) -> None:
    """Pixels as Parquet, a folder per tile row, for encoders that take one tile at a time."""
    pixels.withColumn("tile_y", F.floor(F.col("y") / tile)).withColumn("tile_x", F.floor(F.col("x") / tile)).write.mode("overwrite").partitionBy("tile_y", "tile_x").parquet(path)


def setup_logging(path: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """A fresh console handler, and a file one if there is a path."""
    root = logging.getLogger()
    for h in list(root.handlers):
        root.removeHandler(h)
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        handlers.append(logging.FileHandler(path))
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s: %(message)s", handlers=handlers)
    return logging.getLogger("gridloom")
