"""Feature extraction: one kernel call per image inside one mapInPandas; errors are columns, not failed tasks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import paths as P
from verdigris.kernels import features as K
from verdigris.kernels import image as I  # noqa: E741
from verdigris.operators.normalize import Normalizer
from verdigris.schema import EXTRACTED, GROUPS, feature_names
from verdigris.sources.images import decode, scan_images

SIZE = (256, 256)
ALPHA_SHARE = 0.01


def features_of(rgb: np.ndarray, alpha: np.ndarray | None, groups: tuple[str, ...] = GROUPS, size: tuple[int, int] = SIZE, extractors: dict[str, Callable] | None = None) -> tuple[dict[str, float], dict[str, str]]:
    """Features and errors by group of one image; the mask is made once, from alpha where that covers enough."""
    calls = K.EXTRACTORS | (extractors or {})
    rgb = I.resize(rgb, *size)
    mask = None
    if alpha is not None:
        mask = I.resize_nearest(alpha, *size)
    if mask is None or K.share(mask) < ALPHA_SHARE:
        mask = K.tree_mask(rgb)
    out, errors = {}, {}
    for g in groups:
        try:
            out |= {f"{g}_{k}": float(v) for k, v in calls[g](rgb, mask).items()}
        except Exception as e:  # one group's failure leaves the others
            errors[g] = f"{type(e).__name__}: {e}"
    return out, errors


def _row(path: str, found, started: float, groups: tuple[str, ...], size: tuple[int, int]) -> dict:
    if found is None:
        return {"image_path": path, "success": False, "n_features": 0, "processing_time_ms": 0.0, "feature_names": [], "features": {}, "vector": [], "errors": {"general": "the image can't be decoded"}}
    feats, errors = features_of(*found, groups, size)
    names = [n for n in feature_names(list(groups)) if n in feats]
    return {"image_path": path, "success": True, "n_features": len(names), "processing_time_ms": (time.time() - started) * 1000, "feature_names": names, "features": feats, "vector": [np.float32(feats[n]) for n in names], "errors": errors or None}


def extract(images: DataFrame, groups: tuple[str, ...] | list[str] | None = None, size: tuple[int, int] = SIZE, normalizer: Normalizer | None = None) -> DataFrame:
    """The extraction table of images (image, image_path). With a fitted normalizer also vector_normalized, clipped to
    [-3, 3] under zscore; without one it is null."""
    feature_names(list(groups or ()))  # unknown groups raise here
    chosen = tuple(g for g in GROUPS if g in (groups or GROUPS))

    def run(frames: Iterator[pd.DataFrame]):
        for pdf in frames:
            rows = []
            for path, h, w, c, data in zip(pdf["image_path"], pdf["h"], pdf["w"], pdf["c"], pdf["data"], strict=True):
                started = time.time()
                try:
                    rows.append(_row(path, decode(int(h), int(w), int(c), bytes(data)) if h and h > 0 else None, started, chosen, size))
                except Exception as e:  # an image's failure is its row's
                    rows.append(_row(path, None, started, chosen, size) | {"errors": {"general": f"{type(e).__name__}: {e}"}})
            yield pd.DataFrame(rows, columns=[f.name for f in EXTRACTED.fields if f.name != "label"])

    flat = images.select("image_path", F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("c"), F.col("image.data").alias("data"))
    out_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EXTRACTED.fields if f.name != "label")
    out = flat.mapInPandas(run, out_schema).withColumn("label", P.build_label(F.col("image_path")))
    if normalizer is None or not normalizer.is_fitted:
        return out.withColumn("vector_normalized", F.lit(None).cast("array<float>"))
    fits = F.size("vector") == (normalizer.n_features or -1)
    x = normalizer.expression(F.when(fits, F.col("vector")))
    if normalizer.method == "zscore":
        x = F.transform(x, lambda v: F.greatest(F.lit(-3.0), F.least(F.lit(3.0), v)))
    return out.withColumn("vector_normalized", F.when(F.col("success"), x.cast("array<float>")))


def extract_folder(spark: SparkSession, folder: str, **options) -> DataFrame:
    """extract over all images below folder, in path order."""
    return extract(scan_images(spark, folder), **options).orderBy(P.sort_key(F.col("image_path")))
