"""Sources: file catalogues, prototypes, images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.scalars import RECOVERY
from curatrix.sources.folders import list_entries, once


def scan_catalog(spark: SparkSession, roots: list[str], recursive: bool = True, glob: str | None = None, recovery_dir: str = RECOVERY) -> DataFrame:
    """The regular files below the roots, in order of path, one per path key even where roots overlap: path, name, extension, size (and as
    length), created_at, modified_at, accessed_at (ms), hidden, readonly. Contents are for Spark's binaryFile; what can't be read is told by scan_totals."""
    files = list_entries(spark, roots, recursive, glob, recovery_dir).where("kind = 'file'").where("error is null")
    return once(files).drop("kind", "error").withColumn("length", F.col("size")).orderBy("path")


def scan_totals(spark: SparkSession, roots: list[str], recursive: bool = True, glob: str | None = None, recovery_dir: str = RECOVERY) -> DataFrame:
    """How many files there are below the roots, their bytes, and how many files and folders can't be read; one row."""
    found = once(list_entries(spark, roots, recursive, glob, recovery_dir))
    file = (F.col("kind") == "file") & F.col("error").isNull()
    return found.agg(F.count_if(file).alias("files"), F.coalesce(F.sum(F.when(file, F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(F.col("error").isNotNull()).alias("unreadable"))


def load_prototypes(spark: SparkSession, path: str, model: str, dim: int, known: list[str], most_prompts: int = 32) -> DataFrame:
    """category, prompt, vector; an error where the file's model, a category or a vector is invalid."""
    rows = spark.read.schema("model string, categories array<struct<id:string,embeddings:array<array<double>>>>").json(path, multiLine=True)
    each = rows.select("model", F.posexplode("categories").alias("at", "c")).select("model", "at", F.col("c.id").alias("category"), F.size("c.embeddings").alias("n"), F.posexplode_outer("c.embeddings").alias("prompt", "vector"))
    bad_vector = (F.size("vector") != dim) | F.exists("vector", lambda x: x.isNull() | F.isnan(x)) | (F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x) < 1e-16)
    first = each.groupBy("category").agg(F.count_distinct("at").alias("times"))
    error = F.when(F.col("model") != model, "INVALID_MODEL").when(~F.col("category").isin(known) | (F.col("times") > 1), "INVALID_CATEGORY").when((F.col("n") < 1) | (F.col("n") > most_prompts) | F.coalesce(bad_vector, F.lit(True)), "INVALID_VECTOR")
    return each.join(first, "category").select("category", "prompt", "vector", error.alias("error"))


def read_images(spark: SparkSession, path: str, heads: DataFrame | None = None) -> DataFrame:
    """path, height, width, channels, data (BGR bytes); undecodable ones have height -1.

    With heads (of image_heads, for a folder's files) only images without an error are decoded. Where some are refused, the driver holds
    the names of the others in that folder, since Spark's image source takes paths, not filters."""
    where: str | list[str] = path
    if heads is not None and not heads.where("error is not null").isEmpty():
        where = [r["path"] for r in heads.where("error is null").select("path").collect()]
        if not where:
            return spark.createDataFrame([], "path string, height int, width int, channels int, data binary")
    return spark.read.format("image").option("dropInvalid", False).load(where).select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def image_guard(images: DataFrame, max_pixels: int = 40_000_000, max_axis: int = 16_384, max_bytes: int = 256 << 20, files: DataFrame | None = None, max_file_bytes: int = 64 << 20) -> DataFrame:
    """Decoded images with error: too many pixels or bytes, of the file too where files (path, length) tells them; undecodable. A second look:
    image_heads refuses by the header, before anything is decoded."""
    if files is not None:
        long = files.where(F.col("length") > max_file_bytes).select("path", F.lit(True).alias("_long"))
        out = image_guard(images, max_pixels, max_axis, max_bytes).join(long, "path", "left")
        return out.withColumn("error", F.when(F.col("_long"), "IMAGE_TOO_LARGE").otherwise(F.col("error"))).drop("_long")
    big = (F.col("height").cast("long") * F.col("width") > max_pixels) | (F.greatest("height", "width") > max_axis) | (F.octet_length("data") > max_bytes)
    return images.withColumn("error", F.when(F.col("height") < 0, "UNSUPPORTED_IMAGE").when(big, "IMAGE_TOO_LARGE"))


def weights(size: int, to: int) -> np.ndarray:
    """A triangle filter that resizes an axis, as a matrix."""
    scale = size / to
    reach = max(scale, 1.0)
    centre = (np.arange(to) + 0.5) * scale - 0.5
    w = np.maximum(0, 1 - np.abs(np.arange(size)[None, :] - centre[:, None]) / reach)
    return w / w.sum(1, keepdims=True)


def cubic_weights(size: int, to: int) -> np.ndarray:
    """A Catmull-Rom filter that resizes an axis, as a matrix."""
    scale = size / to
    centre = (np.arange(to) + 0.5) * scale - 0.5
    t = np.abs(np.arange(size)[None, :] - centre[:, None]) / max(scale, 1.0)
    w = np.where(t < 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0))
    return w / w.sum(1, keepdims=True)


def resized(x: np.ndarray, height: int, width: int, kernel: Callable[[int, int], np.ndarray] = weights) -> np.ndarray:
    rows = np.tensordot(kernel(x.shape[0], height), x, (1, 0))
    return np.tensordot(rows, kernel(x.shape[1], width), (1, 1)).transpose(0, 2, 1)


def _cosines(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * i + 1) * k / (2 * n))


def _packed(bits: np.ndarray) -> int:
    v = sum(1 << k for k, b in enumerate(bits) if b)
    return v - (1 << 64) if v >= 1 << 63 else v


def fingerprint_of(rgb: np.ndarray) -> tuple[int, int, list[int], float]:
    """phash (63 low frequencies against their median), dhash (9 x 8 gradient), 16 x 16 colours, aspect."""
    luma = np.array([0.299, 0.587, 0.114])
    grey = resized(rgb, 32, 32) @ luma
    c = _cosines(32)
    low = (c @ grey @ c.T)[:8, :8].ravel()[1:]
    grad = resized(rgb, 8, 9) @ luma
    return _packed(low > np.sort(low)[31]), _packed((grad[:, :-1] > grad[:, 1:] + 1e-9).ravel()), np.clip(np.rint(resized(rgb, 16, 16)), 0, 255).astype(int).ravel().tolist(), rgb.shape[1] / rgb.shape[0]


def pixels(row) -> np.ndarray:
    """RGB floats; transparent pixels over white."""
    x = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels).astype(float)
    if row.channels == 1:
        return np.repeat(x, 3, 2)
    rgb = x[:, :, 2::-1]
    return (rgb * x[:, :, 3:] + 255 * (255 - x[:, :, 3:])) / 255 if row.channels == 4 else rgb


def fingerprint(images: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(r.path, *fingerprint_of(pixels(r))) for r in pdf.itertuples()], columns=["path", "phash", "dhash", "colors", "aspect"])

    return images.where("height > 0").mapInPandas(run, "path string, phash long, dhash long, colors array<int>, aspect double")


def preprocess(rgb: np.ndarray, view: tuple[int, int, int] | None, size: int, mean: list[float], std: list[float]) -> np.ndarray:
    """Channels first: a square crop, or the whole on a square of the mean colour; resized by cubics and normalised."""
    if view:
        x, y, edge = view
        rgb = rgb[y : y + edge, x : x + edge]
    else:
        edge = max(rgb.shape[:2])
        whole = np.empty((edge, edge, 3))
        whole[:] = np.array(mean) * 255
        top, left = (edge - rgb.shape[0]) // 2, (edge - rgb.shape[1]) // 2
        whole[top : top + rgb.shape[0], left : left + rgb.shape[1]] = rgb
        rgb = whole
    return ((np.clip(resized(rgb, size, size, cubic_weights), 0, 255) / 255 - np.array(mean)) / np.array(std)).transpose(2, 0, 1)


def embed(images: DataFrame, encoder: Callable[[], Callable[[np.ndarray], np.ndarray]], size: int, mean: list[float], std: list[float]) -> DataFrame:
    """path, embedding by a user's encoder: encoder() gives, once per task, a function of a batch of images."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for pdf in batches:
            if not pdf.empty:
                x = np.stack([preprocess(pixels(r), None, size, mean, std) for r in pdf.itertuples()])
                yield pd.DataFrame({"path": pdf["path"], "embedding": [v.tolist() for v in encode(x)]})

    return images.where("height > 0").mapInPandas(run, "path string, embedding array<double>")


__all__ = ["embed", "fingerprint", "fingerprint_of", "image_guard", "load_prototypes", "preprocess", "read_images", "scan_catalog", "scan_totals"]
