"""A vector store as a table: insert, exact queries, statistics, save and load."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.functions import paths as P
from verdigris.functions import vector as V
from verdigris.operators import knn
from verdigris.operators.ordinal import with_ordinal
from verdigris.schema import RECORDS

METRICS = ("euclidean", "cosine")
DECIMALS = 6


def stored_vector(v: str | Column, metric: str) -> Column:
    """What a store keeps: float32, scaled to unit length under cosine."""
    return (V.l2_normalize(V.floats(v)) if metric == "cosine" else V.doubles(V.floats(v))).cast("array<float>")


def modal_dimension(df: DataFrame, vector: str = "vector") -> DataFrame:
    """Rows whose vector has the most frequent length; the smaller length on a tie."""
    top = df.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d")
    return df.join(F.broadcast(top), F.size(vector) == F.col("d"), "left_semi")


@dataclass
class VectorStore:
    """Records (record_idx, image_path, label, vector, meta). Cosine distances are Euclidean ones between unit vectors.

    Queries need a built store; an insert makes it unbuilt again, and an empty store can't be built.
    """

    spark: SparkSession
    distance: str = "euclidean"
    records: DataFrame | None = None
    n_features: int | None = None
    built: bool = field(default=False)

    def __post_init__(self):
        if self.distance not in METRICS:
            raise ValueError(f"distance must be one of {METRICS}, not {self.distance!r}")
        if self.records is None:
            self.records = self.spark.createDataFrame([], RECORDS)

    def __len__(self) -> int:
        return self.records.count()

    def insert(self, path: str, vector: Sequence[float], label: str | None = None, **meta) -> int:
        """Adds one record and returns its ordinal."""
        flat = [float(x) for x in vector]
        row = self.spark.createDataFrame([(0, path, label, flat, {k: str(v) for k, v in meta.items()} or None)], "o long, image_path string, label string, vector array<double>, meta map<string,string>")
        at = len(self)
        self.insert_batch(row, "o")
        return at

    def insert_lists(self, paths: Sequence[str], vectors: Sequence[Sequence[float]], labels: Sequence[str | None] | None = None) -> VectorStore:
        if len(paths) != len(vectors):
            raise ValueError(f"{len(paths)} paths for {len(vectors)} vectors")
        rows = [(i, p, lab, [float(x) for x in v]) for i, (p, v, lab) in enumerate(zip(paths, vectors, labels or [None] * len(paths), strict=False))]
        return self.insert_batch(self.spark.createDataFrame(rows, "o long, image_path string, label string, vector array<double>"), "o")

    def insert_batch(self, df: DataFrame, *order: str) -> VectorStore:
        """Adds df (image_path, vector and, if there, label and meta) in the order of columns order (default: path)."""
        sizes = [r["d"] for r in df.select(F.size("vector").alias("d")).distinct().limit(3).collect()]
        if not sizes:
            return self
        want = self.n_features or sizes[0]
        if sizes != [want]:
            raise ValueError(f"vectors of dimensions {sorted(sizes)} in a store of {want}")
        for name, kind in (("label", "string"), ("meta", "map<string,string>")):
            if name not in df.columns:
                df = df.withColumn(name, F.lit(None).cast(kind))
        rows = with_ordinal(df, *(order or ("image_path",)), start=len(self))
        rows = rows.select("record_idx", "image_path", "label", stored_vector("vector", self.distance).alias("vector"), "meta")
        self.records, self.n_features, self.built = self.records.unionByName(rows), want, False
        return self

    def build(self) -> VectorStore:
        """Marks the store as ready; exact search needs no index."""
        self.built = bool(self.records.limit(1).count())
        return self

    def _asked(self, vector: Sequence[float]) -> list[float]:
        import numpy as np

        if not self.built:
            raise RuntimeError("the store is not built")
        x = np.asarray(vector, dtype=np.float32).reshape(-1)
        if len(x) != self.n_features:
            raise ValueError(f"expected {self.n_features} dimensions, got {len(x)}")
        if self.distance == "cosine":
            x = (x.astype(np.float64) / (np.sqrt((x.astype(np.float64) ** 2).sum()) + V.EPS)).astype(np.float32)
        return [float(v) for v in x]

    def query(self, vector: Sequence[float], k: int = 5) -> DataFrame:
        """rank, image_path, label, distance (6 decimals), record_idx, meta of the k nearest."""
        hits = knn.scan_top_k(self.records, self._asked(vector), k)
        return hits.select("rank", "image_path", "label", F.round("distance", DECIMALS).alias("distance"), "record_idx", "meta")

    def query_by_path(self, path: str, k: int = 5) -> DataFrame:
        """Neighbours of the first record with that path, without any record of that path; ranks keep their gaps."""
        own = self.records.filter(F.col("image_path") == path).orderBy("record_idx").first()
        if own is None:
            raise ValueError(f"no record has path {path!r}")
        return self.query(list(own["vector"]), k + 1).filter(F.col("image_path") != path).orderBy("rank").limit(k)

    def smoke(self, k: int = 5) -> DataFrame:
        """The neighbours of the first record, as a check that a store answers."""
        first = self.records.orderBy("record_idx").first()
        if first is None:
            raise RuntimeError("the store is empty")
        return self.query_by_path(first["image_path"], k)

    def search_like_page(self, vector: Sequence[float], path: str, k: int = 6, shown: int = 5, same: float = 1e-6) -> DataFrame:
        """The k nearest without those at distance same or less or with path's file name, the first shown of them, ranked anew."""
        hits = self.query(vector, k).filter((F.col("distance") > same) & (P.file_name(F.col("image_path")) != path.rsplit("/", 1)[-1]))
        return hits.withColumn("rank", F.row_number().over(Window.orderBy("rank"))).filter(F.col("rank") <= shown)

    def neighbours(self, k: int, queries: DataFrame | None = None) -> DataFrame:
        """qid, rid, distance, rank: the k nearest records of each record of queries (default: of all)."""
        return knn.batch_top_k(self.records, self.records if queries is None else queries, k)

    def stats(self) -> DataFrame:
        """n_records, n_features, tree_built, n_tree_nodes (a node per record once built), distance_metric, n_labels, labels
        (sorted; empty and null ones don't count)."""
        named = F.nullif("label", F.lit(""))
        return self.records.agg(F.count("*").alias("n_records"), F.count_distinct(named).alias("n_labels"), F.array_sort(F.collect_set(named)).alias("labels")).withColumn("n_features", F.lit(self.n_features)).withColumn("tree_built", F.lit(self.built)).withColumn("n_tree_nodes", F.when(F.col("tree_built"), F.col("n_records")).otherwise(0)).withColumn("distance_metric", F.lit(self.distance))

    def save(self, path: str) -> bool:
        """Writes records and settings; an empty store writes nothing. Metadata is kept."""
        if not self.records.limit(1).count():
            return False
        self.records.withColumn("label", F.coalesce("label", F.lit(""))).write.mode("overwrite").parquet(f"{path}/records")
        self.spark.createDataFrame([(self.distance, self.n_features)], "distance string, n_features int").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
        return True

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorStore:
        """A saved store, built; empty labels are null and cosine vectors are scaled again."""
        from pyspark.errors import AnalysisException

        try:
            s = spark.read.schema("distance string, n_features int").parquet(f"{path}/settings").first()
            rows = spark.read.schema(RECORDS).parquet(f"{path}/records")
        except AnalysisException as e:
            raise FileNotFoundError(path) from e
        rows = rows.withColumn("label", F.nullif("label", F.lit(""))).withColumn("vector", stored_vector("vector", s["distance"]))
        return cls(spark, s["distance"], rows.select("record_idx", "image_path", "label", "vector", "meta"), s["n_features"], True)
