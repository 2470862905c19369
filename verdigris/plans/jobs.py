"""Build a store from images, query it, evaluate it, and preprocess image folders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import paths as P
from verdigris.kernels import preprocess as C
from verdigris.operators import evaluate as E
from verdigris.operators import knn
from verdigris.operators.normalize import Normalizer
from verdigris.operators.store import VectorStore, modal_dimension
from verdigris.plans.extract import extract, extract_folder
from verdigris.sources.images import decode, encode_png, scan_images, with_orientation


def build_from_features(spark: SparkSession, features: DataFrame, method: str = "zscore", distance: str = "cosine", clip_stored: bool = False) -> tuple[Normalizer, VectorStore]:
    """Successful rows of the modal dimension, normalised, labelled by path, inserted in path order. Stored vectors
    aren't clipped unless asked for."""
    good = modal_dimension(features.filter("success and size(vector) > 0").select("image_path", "vector"))
    norm = Normalizer(method).fit(good)
    rows = norm.transform(good, clip=3.0 if clip_stored else None).withColumn("label", P.build_label(F.col("image_path")))
    return norm, VectorStore(spark, distance).insert_batch(rows, "image_path").build()


def build(spark: SparkSession, image_dir: str, out: str, method: str = "zscore", distance: str = "cosine") -> tuple[Normalizer, VectorStore]:
    """Extracts, keeps the feature table, fits, stores and saves."""
    extract_folder(spark, image_dir).write.mode("overwrite").parquet(f"{out}/features")
    norm, store = build_from_features(spark, spark.read.parquet(f"{out}/features"), method, distance)
    norm.save(spark, f"{out}/normalizer")
    store.save(f"{out}/store")
    return norm, store


def load(spark: SparkSession, out: str) -> tuple[Normalizer, VectorStore]:
    return Normalizer.load(spark, f"{out}/normalizer"), VectorStore.load(spark, f"{out}/store")


def query_vector(spark: SparkSession, image: str, norm: Normalizer, preprocess_first: bool = False) -> list[float]:
    """The clipped normalised vector of an image file, or its raw one. Preprocessing that fails leaves the image as it is."""
    images = scan_images(spark, image)
    if preprocess_first:
        cleaned = preprocess(images).select("is_valid", "png").first()
        if cleaned and cleaned["is_valid"]:
            images = cleaned_images(spark, images)
    row = extract(images, normalizer=norm).first()
    if row is None or not row["success"]:
        raise ValueError(f"no features for {image}")
    return list(row["vector_normalized"] or row["vector"])


def cleaned_images(spark: SparkSession, images: DataFrame, **options) -> DataFrame:
    """Valid images after preprocessing, as image structs."""
    rows = preprocess(images, **options).filter("is_valid")
    image = F.struct(F.col("image_path").alias("origin"), "height", "width", F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), F.col("bgr").alias("data"))
    return rows.select(image.alias("image"), "image_path")


def query(spark: SparkSession, out: str, image: str, k: int = 5) -> DataFrame:
    norm, store = load(spark, out)
    return store.query(query_vector(spark, image, norm), k)


def evaluate(store: VectorStore, k: int = 5, sample: int | None = None, distances: bool = True, seed: int = 42, pair_rows: int = 300) -> dict[str, DataFrame]:
    """quality, labels, buckets, queries and distances of a store; pairs are analysed on pair_rows records at most."""
    named = store.records.withColumn("label", P.eval_label(F.col("image_path"), F.col("label")))
    n = named.count()
    ids = E.sample_ids(n, sample, seed)
    asked = named if ids is None else _only(named, ids)
    scored = E.per_query(E.hits(named, k, asked), named, k)
    if distances:
        some = E.sample_ids(n, pair_rows, 0)
        pairs = knn.pairwise(named if some is None else _only(named, some), keep=["label"])
        pairs = pairs.withColumn("same", F.col("label_i").eqNullSafe(F.col("label_j")))
    else:
        pairs = named.sparkSession.createDataFrame([(True, 0.0), (False, 1.0)], "same boolean, distance double")
    return {"quality": E.summary(scored, len(ids) if ids else n), "labels": E.per_label(scored), "buckets": E.ap_buckets(scored), "queries": scored, "distances": E.separation(pairs)}


def _only(records: DataFrame, ids: list[int]) -> DataFrame:
    """The sampled records; the ids are a table, not a list in the plan."""
    return records.join(records.sparkSession.createDataFrame([(i,) for i in ids], "record_idx long"), "record_idx", "left_semi")


_CLEANED = "image_path string, is_valid boolean, reason string, issues array<string>, metadata map<string,string>, height int, width int, bgr binary, png binary, mask_png binary"


def preprocess(images: DataFrame, size: tuple[int, int] = (512, 512), method: str = "rembg", denoiser: str = "nlmeans", augmented: bool = False, seed: int | None = None, min_size: int = 64) -> DataFrame:
    """One row per image (image, image_path and, if there, orientation): verdict, metadata and, if valid, pixels and PNGs.
    A failing image is an invalid row."""
    if "orientation" not in images.columns:
        images = images.withColumn("orientation", F.lit(1))

    def one(path, h, w, c, data, orientation) -> tuple:
        found = decode(int(h), int(w), int(c), bytes(data)) if h and h > 0 else None
        if found is None:
            return (path, False, "the image can't be decoded", [], {"error": "decode"}, None, None, None, None, None)
        r = C.run(found[0], int(orientation), size, method, denoiser, augmented, seed, min_size)
        if not r.is_valid:
            return (path, False, r.validation.reason, r.validation.issues, r.metadata, None, None, None, None, None)
        x = r.image
        return (path, True, r.validation.reason, r.validation.issues, r.metadata, x.shape[0], x.shape[1], np.ascontiguousarray(x[..., ::-1]).tobytes(), encode_png(x), encode_png(r.mask))

    def run(frames: Iterator[pd.DataFrame]):
        for pdf in frames:
            rows = []
            for args in pdf.itertuples(index=False):
                try:
                    rows.append(one(*args))
                except Exception as e:  # an image's failure is its row's
                    rows.append((args[0], False, "error", [], {"error": f"{type(e).__name__}: {e}"}, None, None, None, None, None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _CLEANED.split(", ")]).astype({"height": "Int32", "width": "Int32"})

    flat = images.select("image_path", F.col("image.height"), F.col("image.width"), F.col("image.nChannels"), F.col("image.data"), "orientation")
    return flat.mapInPandas(run, _CLEANED)


def preprocess_folder(spark: SparkSession, folder: str, out: str, save_masks: bool = True, **options) -> DataFrame:
    """Preprocesses all images below folder, writes valid ones and their masks as PNG under their relative paths, and
    returns the verdicts."""
    from verdigris.sources.images import save_png_files

    images = scan_images(spark, folder, P.PREPROCESS_SUFFIXES, missing_ok=True)
    done = preprocess(with_orientation(spark, images, folder) if images.limit(1).count() else images, **options)
    done.write.mode("overwrite").parquet(f"{out}/results")
    done = spark.read.parquet(f"{out}/results")
    root = folder.rstrip("/") + "/"
    name = F.concat(F.regexp_replace(F.expr(f"substring(image_path, {len(root) + 1})"), r"\.[^./]+$", ""), F.lit(".png"))
    good = done.filter("is_valid").withColumn("relative_path", name)
    save_png_files(good, f"{out}/images")
    if save_masks:
        save_png_files(good, f"{out}/masks", "mask_png")
    return done.select("image_path", "is_valid", "reason", "issues", "metadata")
