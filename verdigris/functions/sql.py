"""Vector functions for SQL text: temporary SQL functions that Catalyst expands in place."""

from __future__ import annotations

from pyspark.sql import SparkSession

_V = "ARRAY<DOUBLE>"
FUNCTIONS = {
    "l2_norm": (f"v {_V}", "DOUBLE", "sqrt(aggregate(v, 0D, (s, x) -> s + x * x))"),
    "l2_distance": (f"a {_V}, b {_V}", "DOUBLE", "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"),
    "dot_product": (f"a {_V}, b {_V}", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "l2_normalize": (f"v {_V}", _V, "transform(v, y -> y / (sqrt(aggregate(v, 0D, (s, x) -> s + x * x)) + 1e-8D))"),
}


def register(spark: SparkSession) -> None:
    """Makes FUNCTIONS known to spark.sql in this session."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
