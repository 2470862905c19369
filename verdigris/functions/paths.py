"""Labels, suffixes and candidate places of image paths as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Suffixes of the two scans, and directory names that are not class names.
EXTRACT_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tiff")
PREPROCESS_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tiff", "webp")
GENERIC_PARENTS = ("", "res", "tree", "batch")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(.)\.[^.]*$", "$1")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".\.([^.]+)$", 1))


def has_suffix(path: Column, suffixes: tuple[str, ...] = EXTRACT_SUFFIXES) -> Column:
    return suffix(path).isin(*suffixes)


def build_label(path: Column) -> Column:
    """Label given when a store is built: the parent directory, or the stem before its first _, or null."""
    generic = parent(path).isin(*GENERIC_PARENTS)
    return F.when(~generic, parent(path)).when(F.instr(stem(path), "_") > 0, F.substring_index(stem(path), "_", 1))


def eval_label(path: Column, stored: Column) -> Column:
    """Label used by evaluation: the parent directory, or what stands before _tree_ and then before _, or the stored label."""
    generic = parent(path).isin(*GENERIC_PARENTS)
    marked = F.trim(F.substring_index(F.substring_index(stem(path), "_tree_", 1), "_", 1))
    return F.when(~generic, parent(path)).when(F.instr(stem(path), "_tree_") > 0, marked).otherwise(F.coalesce(stored, parent(path)))


def labels_of_paths(paths: DataFrame, records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """path, label of every row of paths, repeated paths included: the evaluation label of the first record (record_idx,
    image_path, label) with that path, else its parent. by: columns of both sides that must be equal beside the path."""
    first = records.groupBy(F.col("image_path").alias("r_path"), *[F.col(c).alias(f"r_{c}") for c in by]).agg(F.min_by("label", "record_idx").alias("stored"))
    at = F.col("path").eqNullSafe(F.col("r_path"))
    for c in by:
        at &= F.col(c).eqNullSafe(F.col(f"r_{c}"))
    both = paths.select("path", *by).join(first.withColumn("found", F.lit(True)), at, "left")
    label = F.when(F.col("found"), eval_label(F.col("path"), F.col("stored"))).otherwise(parent(F.col("path")))
    return both.select("path", label.alias("label"))


def sort_key(path: Column) -> Column:
    """Path parts: the extractor sorts by parts, the preprocessing scan by the whole string."""
    return F.split(path, "/")


# Suffix order of a lookup; "" stands for the path's own suffix.
RESOLVE_SUFFIXES = (".jpg", ".jpeg", "", ".png")


def candidates(paths: DataFrame, roots: tuple[str, str]) -> DataFrame:
    """path, candidate, priority: the places where a stored path may be found, first best. roots: application and image folder.
    Under the image folder, a leading res/ or tree/ is dropped."""
    app, images = roots
    p = F.col("path")
    bare = F.regexp_replace(p, r"^((res|tree)/)+", "")
    bases = F.when(p.startswith("/"), F.array(p)).otherwise(F.array(F.concat(F.lit(app + "/"), p), F.concat(F.lit(images + "/"), bare)))
    each = paths.select("path", F.posexplode(bases).alias("b", "base"))
    cut = F.regexp_replace("base", r"\.[^./]*$", "")
    tries = F.array(*[F.concat(cut, F.lit(s)) if s else F.col("base") for s in RESOLVE_SUFFIXES])
    each = each.select("path", "b", F.posexplode(tries).alias("s", "candidate"))
    return each.select("path", "candidate", (F.col("b") * len(RESOLVE_SUFFIXES) + F.col("s")).alias("priority"))


def resolve(paths: DataFrame, existing: DataFrame, roots: tuple[str, str]) -> DataFrame:
    """path, resolved: the first candidate that is in existing (column file); null if none is."""
    found = candidates(paths, roots).join(existing.select(F.col("file").alias("candidate")).distinct(), "candidate")
    best = found.groupBy("path").agg(F.min_by("candidate", "priority").alias("resolved"))
    return paths.select("path").distinct().join(best, "path", "left")


def renamed_classes(listing: DataFrame) -> DataFrame:
    """Files with their place in their class (0-based, by path): the offset for appending crawls is one more than the last."""
    return listing.withColumn("idx", F.row_number().over(Window.partitionBy("class_dir").orderBy("file")) - 1)
