"""Table schemas and the fixed order of feature names."""

from __future__ import annotations

from pyspark.sql import types as T

# The groups in vector order, and each group's names; a vector sorts names inside a group.
GROUPS = ("color", "shape", "texture", "canopy")
GROUP_NAMES = {
    "color": [f"hue_hist_{i}" for i in range(8)] + ["h_mean", "h_std", "s_mean", "s_std", "v_mean", "v_std"] + [f"dom_{c}{i}" for i in (1, 2, 3) for c in "rgb"] + ["green_ratio"],
    "shape": ["aspect_ratio", "extent_ratio", "area_ratio", "solidity", "centroid_x_norm", "centroid_y_norm", "symmetry", "crown_ratio", "hu_0", "hu_1", "hu_2", "hu_3"],
    "texture": [f"lbp_{i}" for i in range(10)] + ["contrast", "homogeneity", "energy", "correlation", "grad_mean", "grad_std", "roughness"],
    "canopy": ["peak_row_norm", "top25_ratio", "bottom25_ratio", "contour_complexity", "convexity", "width_mean", "width_std", "max_width_norm", "n_components"],
}


def feature_names(groups: tuple[str, ...] | list[str] | None = None) -> list[str]:
    """Prefixed names in vector order; an empty choice means all groups."""
    chosen = list(groups) if groups else list(GROUPS)
    unknown = sorted(set(chosen) - set(GROUPS))
    if unknown:
        raise ValueError(f"unknown feature groups: {unknown}; known: {list(GROUPS)}")
    return [f"{g}_{n}" for g in GROUPS if g in chosen for n in sorted(GROUP_NAMES[g])]


FEATURE_NAMES = feature_names()

IMAGE = T.StructType([T.StructField("origin", T.StringType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("nChannels", T.IntegerType()), T.StructField("mode", T.IntegerType()), T.StructField("data", T.BinaryType())])

EXTRACTED = T.StructType([
    T.StructField("image_path", T.StringType()), T.StructField("label", T.StringType()), T.StructField("success", T.BooleanType()),
    T.StructField("n_features", T.IntegerType()), T.StructField("processing_time_ms", T.DoubleType()), T.StructField("feature_names", T.ArrayType(T.StringType())),
    T.StructField("features", T.MapType(T.StringType(), T.DoubleType())), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("errors", T.MapType(T.StringType(), T.StringType())),
])

RECORDS = T.StructType([T.StructField("record_idx", T.LongType()), T.StructField("image_path", T.StringType()), T.StructField("label", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("meta", T.MapType(T.StringType(), T.StringType()))])
