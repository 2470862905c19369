"""Vector normalisation: a fit is one aggregation, a transform one projection."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import vector as V

METHODS = ("l2", "zscore", "minmax")
_STATE = "method string, eps double, is_fitted boolean, n_features int, n_samples_fitted long, mean array<double>, std array<double>, min array<double>, max array<double>"


def dimension_stats(df: DataFrame, column: str = "vector") -> DataFrame:
    """pos, mean, std (population), min, max, n of every dimension; combined map-side."""
    each = df.select(F.posexplode(V.doubles(column)).alias("pos", "x"))
    return each.groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), F.count("x").alias("n"))


@dataclass
class Normalizer:
    """fit and transform by l2, zscore or minmax. zscore and minmax keep one number per dimension on the driver."""

    method: str = "zscore"
    eps: float = V.EPS
    n_features: int | None = None
    n_samples_fitted: int = 0
    mean: list[float] | None = None
    std: list[float] | None = None
    min: list[float] | None = None
    max: list[float] | None = None
    is_fitted: bool = False

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}, not {self.method!r}")

    def fit(self, df: DataFrame, column: str = "vector") -> Normalizer:
        sizes = df.select(F.size(column).alias("d")).groupBy("d").count().collect()
        if len(sizes) != 1:
            raise ValueError(f"fit needs vectors of one dimension, found {sorted(r['d'] for r in sizes)}")
        self.n_features, self.n_samples_fitted = sizes[0]["d"], sizes[0]["count"]
        if self.method != "l2":
            rows = sorted(dimension_stats(df, column).collect(), key=lambda r: r["pos"])
            if self.method == "zscore":
                self.mean, self.std = [r["mean"] for r in rows], [r["std"] for r in rows]
            else:
                self.min, self.max = [r["min"] for r in rows], [r["max"] for r in rows]
        self.is_fitted = True
        return self

    def _array(self, values: list[float]) -> Column:
        return F.array(*[F.lit(float(x)) for x in values])

    def expression(self, column: str | Column = "vector") -> Column:
        """The transformed array<double>; a vector of another dimension is an error where the dimension is known."""
        if self.method != "l2" and not self.is_fitted:
            raise RuntimeError("the normalizer is not fitted")
        v = F.col(column) if isinstance(column, str) else column
        if self.method == "l2":
            out = V.l2_normalize(v, self.eps)
        elif self.method == "zscore":
            out = V.zscore(v, self._array(self.mean), self._array(self.std), self.eps)
        else:
            out = V.minmax(v, self._array(self.min), self._array(self.max), self.eps)
        if self.n_features is None:
            return out
        wrong = F.raise_error(F.concat(F.lit(f"expected {self.n_features} dimensions, got "), F.size(v).cast("string")))
        return F.when(v.isNull() | (F.size(v) == self.n_features), out).otherwise(wrong.cast("array<double>"))

    def transform(self, df: DataFrame, column: str = "vector", out: str | None = None, clip: float | None = None) -> DataFrame:
        """df with the float32 result in out (default: in place); clip bounds it to [-clip, clip] first."""
        x = self.expression(column)
        if clip is not None:
            x = V.clip(x, -clip, clip)
        return df.withColumn(out or column, x.cast("array<float>"))

    def fit_transform(self, df: DataFrame, column: str = "vector", out: str | None = None) -> DataFrame:
        return self.fit(df, column).transform(df, column, out)

    def transform_one(self, values: list[float]) -> list[float]:
        """One vector on the driver (no job)."""
        import numpy as np

        x = np.asarray(values, dtype=np.float64)
        if x.ndim != 1:
            raise ValueError("transform_one takes one vector")
        if self.method != "l2" and not self.is_fitted:
            raise RuntimeError("the normalizer is not fitted")
        if self.n_features is not None and len(x) != self.n_features:
            raise ValueError(f"expected {self.n_features} dimensions, got {len(x)}")
        if self.method == "l2":
            x = x / (np.sqrt((x * x).sum()) + self.eps)
        elif self.method == "zscore":
            x = (x - np.array(self.mean)) / (np.array(self.std) + self.eps)
        else:
            x = (x - np.array(self.min)) / (np.array(self.max) - np.array(self.min) + self.eps)
        return [float(v) for v in x.astype(np.float32)]

    def state(self, spark: SparkSession) -> DataFrame:
        """The state as a one-row table."""
        row: tuple[Any, ...] = (self.method, self.eps, self.is_fitted, self.n_features, self.n_samples_fitted, self.mean, self.std, self.min, self.max)
        return spark.createDataFrame([row], _STATE)

    def info(self, spark: SparkSession) -> DataFrame:
        return self.state(spark).select("method", "eps", "is_fitted", "n_features", "n_samples_fitted")

    def save(self, spark: SparkSession, path: str) -> None:
        self.state(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Normalizer:
        r = spark.read.schema(_STATE).parquet(path).first()
        return cls(r["method"], r["eps"], r["n_features"], r["n_samples_fitted"], r["mean"], r["std"], r["min"], r["max"], r["is_fitted"])
