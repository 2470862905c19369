"""Image scans through Spark's image source, and image sinks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import paths as P
from verdigris.schema import IMAGE

#: Bytes of a file's head that are searched for its orientation; the tag stands in one of a JPEG's first segments, of 64 KB at most.
HEAD = 128 * 1024


def scan_images(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = P.EXTRACT_SUFFIXES, missing_ok: bool = False) -> DataFrame:
    """image (struct; height -1 if it can't be decoded) and image_path of all files below folder with these suffixes.

    A missing folder is a ValueError, or no rows with missing_ok (the preprocessing scan).
    """
    try:
        rows = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(folder)
    except AnalysisException as e:
        if missing_ok:
            return spark.createDataFrame([], "image_path string").withColumn("image", F.lit(None).cast(IMAGE))
        raise ValueError(f"{folder} is not a folder") from e
    path = F.regexp_replace(F.col("image.origin"), "^file:/+", "/")
    return rows.withColumn("image_path", F.coalesce(F.expr("try_url_decode(regexp_replace(image.origin, '^file:/+', '/'))"), path)).filter(P.has_suffix(F.col("image_path"), suffixes))


def with_orientation(spark: SparkSession, images: DataFrame, folder: str) -> DataFrame:
    """Adds orientation (EXIF tag, 1 if none): only file heads are read and joined, by path."""
    from verdigris.kernels.preprocess import exif_orientation

    heads = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_replace("path", "^file:/+", "/").alias("image_path"), F.substring("content", 1, HEAD).alias("head"))
    heads = heads.filter(P.suffix(F.col("image_path")).isin("jpg", "jpeg"))

    def tags(frames: Iterator[pd.DataFrame]):
        for pdf in frames:
            yield pd.DataFrame({"image_path": pdf["image_path"], "orientation": [exif_orientation(bytes(b)) for b in pdf["head"]]})

    found = heads.mapInPandas(tags, "image_path string, orientation int")
    return images.join(found, "image_path", "left").withColumn("orientation", F.coalesce("orientation", F.lit(1)))


def decode(height: int, width: int, channels: int, data: bytes) -> tuple[np.ndarray, np.ndarray | None] | None:
    """RGB pixels and alpha mask (alpha above 127) of an image struct in BGR order; None for other forms."""
    if height < 1 or width < 1 or channels not in (1, 3, 4):
        return None
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(x, 3, axis=2), None
    rgb = np.ascontiguousarray(x[..., 2::-1])
    return rgb, None if channels == 3 else np.where(x[..., 3] > 127, 255, 0).astype(np.uint8)


def load_image(spark: SparkSession, path: str) -> np.ndarray:
    """RGB pixels of one image file; FileNotFoundError if there is none, ValueError if it can't be decoded."""
    try:
        row = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*").first()
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    found = decode(row["height"], row["width"], row["nChannels"], bytes(row["data"])) if row else None
    if found is None:
        raise ValueError(f"{path} can't be decoded")
    return found[0]


def placeholder(width: int = 400, height: int = 300, colour: tuple[int, int, int] = (45, 45, 60)) -> np.ndarray:
    """What is shown for an image that can't be found."""
    return np.full((height, width, 3), colour, dtype=np.uint8)


def encode_png(img: np.ndarray) -> bytes:
    """PNG of a grey (H, W) or RGB (H, W, 3) uint8 array."""
    h, w = img.shape[:2]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(img).reshape(h, -1)], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if img.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def save_png_files(df: DataFrame, folder: str, column: str = "png", path: str = "relative_path") -> None:
    """Writes each row's PNG below folder (any file system that pyarrow opens). The full relative path names the file."""

    def write(rows):
        import posixpath

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for r in rows:
            target = posixpath.join(root, r[path])
            system.create_dir(posixpath.dirname(target), recursive=True)
            with system.open_output_stream(target) as out:
                out.write(bytes(r[column]))

    df.select(path, column).rdd.foreachPartition(write)


def save_results_json(df: DataFrame, path: str) -> None:
    """Extraction results as JSON lines."""
    df.write.mode("overwrite").json(path)
