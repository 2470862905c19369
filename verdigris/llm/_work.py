"""Shared-folder tables, size-checked joins and partition counts for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rows that may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a folder of this machine, which only a session of one
    machine may use."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = getattr(spark.sparkContext, "_verdigris_dir", None) or tempfile.mkdtemp(prefix="verdigris-")
        spark.sparkContext._verdigris_dir = named
    return named.rstrip("/")


def owned_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what stands there is deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/verdigris-{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)  # only a path that exists can be marked
    fs.deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df computed once, as a Parquet table in the shared folder: it cuts the lineage and outlives executors."""
    path = owned_path(df.sparkSession, name)
    df.write.mode("append").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._verdigris_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that no result needs any more."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._verdigris_path)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a narrow table in one file.
FILE_ROWS = 1_000_000


def narrow(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """As written, for tables of a few narrow columns: the rows are dealt anew, so that the files follow the rows and not the
    shuffle partitions, and a small table is one file that one task reads. rows: at most so many are known to come; where
    that isn't known, the number of files is left to adaptive execution."""
    return written(df.hint("rebalance") if rows is None else df.repartition(rows // FILE_ROWS + 1), name)


def _width(name: str, kind: T.DataType) -> Column:
    """Bytes of a column's value, by its type or, where they vary, by the value."""
    col = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = F.octet_length(F.array_join(col, "")) if isinstance(kind.elementType, T.StringType) else F.lit(0)
        return F.coalesce(inner + 16 * F.size(col), F.lit(0)) + 16
    return F.lit(16)


#: An estimate above this is Catalyst's word for not knowing.
_UNKNOWN = 1 << 50


def _measured(df: DataFrame) -> int:
    size = sum((_width(f.name, f.dataType) for f in df.schema), F.lit(0))
    return int(df.agg(F.sum(size)).first()[0] or 0)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the plan's size, or the rows' own bytes where it has none; at least 1."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, size if size < _UNKNOWN else _measured(df))


def partition_count(df: DataFrame, expansion: float = 2.5, target: int = 16 << 20) -> int:
    """Shuffle partitions so that each holds about target bytes of what df's rows become."""
    return max(8, int(input_bytes(df) * expansion / target) + 1)


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df (a written table) marked for broadcast if its rows have at most that many bytes, else as it is."""
    return F.broadcast(df) if _measured(df) <= most else df


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads: extra columns, whatever their names, can't clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])
