"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings a job needs for right or fast results. AQE splits skewed join
# partitions at run time; exact string parsing keeps nested JSON text verbatim.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Small shuffles still use every core: hashing costs more than the bytes show.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128KB",
    "spark.sql.json.enableExactStringParsing": "true",
    # Rows hold whole texts: a batch of 10,000 takes a Python worker hundreds of MB.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    # Digests are stored in hex; this codec halves them, the default one leaves them as they are.
    "spark.sql.parquet.compression.codec": "zstd",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    checkpoint_root(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_tenetlog_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "tenetlog.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(home):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(home)))
    context.addPyFile(archive)
    context._tenetlog_shipped = True


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a private one only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared scratch folder and read back: survives the loss of any executor.

    The files are columnar, so later reads prune columns and skip by statistics, and the
    plan is computed once. They go when the driver's JVM ends. A table that was just
    written has no lineage to cut.
    """
    if getattr(df, "_written", False):
        return df
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.option("compression", "zstd").parquet(path)      # also in a session that is not configured
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = True
    return out
