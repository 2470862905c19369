"""Crawl lists as tables: which classes to fetch, and where an appending crawl continues. Fetching itself needs a network
client and is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import paths as P

FIRST_CRAWL, APPEND_CRAWL = 80, 15


def class_table(spark: SparkSession, keywords: dict[str, str], max_num: int = FIRST_CRAWL) -> DataFrame:
    """class_dir, keyword, max_num."""
    return spark.createDataFrame([(c, k, max_num) for c, k in sorted(keywords.items())], "class_dir string, keyword string, max_num int")


def append_plan(classes: DataFrame, listing: DataFrame, max_num: int = APPEND_CRAWL) -> DataFrame:
    """class_dir, keyword, file_idx_offset (files already there, of any kind), max_num: an appending crawl overwrites nothing.
    listing has column path."""
    counted = listing.groupBy(P.parent(F.col("path")).alias("class_dir")).agg(F.count("*").alias("file_idx_offset"))
    return classes.join(counted, "class_dir", "left").select("class_dir", "keyword", F.coalesce("file_idx_offset", F.lit(0)).alias("file_idx_offset"), F.lit(max_num).alias("max_num"))
