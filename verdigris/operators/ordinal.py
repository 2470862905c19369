"""Insertion ordinals without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task numbers, and ranges at most.
RANGE_ROWS, MAX_RANGES, PER_RANGE = 1_000_000, 1000, 50


def with_ordinal(df: DataFrame, *order: str, name: str = "record_idx", start: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with 0-based consecutive numbers in the order of the given columns (which should be unique).

    Ranges are cut at values of the order columns, not at physical partitions: a row's range follows from its own values, so
    counting and numbering agree however often and in whatever partitions the rows are computed. The driver sees a bounded
    sample of the order's values and one count per range.
    """
    key = F.struct(*[F.col(f"`{c}`") for c in order])
    ranges = min(MAX_RANGES, df.count() // range_rows + 1)
    if ranges == 1:
        number = F.row_number().over(Window.orderBy(*[F.col(f"`{c}`") for c in order])) - 1 + F.lit(start)
        return df.withColumn(name, number.cast("long"))
    keys = df.select(key.alias("key"))
    some = keys.orderBy(F.xxhash64("key"), "key").limit(PER_RANGE * ranges).orderBy("key").collect()
    cuts = df.sparkSession.createDataFrame([some[len(some) * i // ranges] for i in range(1, ranges)], keys.schema).agg(F.array_sort(F.collect_set("key")).alias("_cuts"))
    dealt = df.crossJoin(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= key))).drop("_cuts")  # one row
    before, pairs = start, []
    for r, n in sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect()):
        pairs += [F.lit(r), F.lit(before)]
        before += n
    own = Window.partitionBy("_range").orderBy(*[F.col(f"`{c}`") for c in order])
    return dealt.withColumn(name, (F.row_number().over(own) - 1 + F.create_map(*pairs)[F.col("_range")]).cast("long")).drop("_range")
