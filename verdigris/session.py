"""Session settings for this library."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Sizes are for a cluster; local runs pass their own shuffle partition count.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "5000",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def build_session(app: str = "verdigris", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which a cluster's machines share; without it a folder of this machine, for
    sessions of one machine only. What stands there goes when the session's JVM ends."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.gettempdir()
    path = f"{root.rstrip('/')}/verdigris-{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)  # only a path that exists can be marked
    fs.deleteOnExit(at)
    return path
