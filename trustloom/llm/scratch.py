"""Where the operators of this subpackage keep intermediate tables.

Intermediate results that are read more than once are written below the shared folder that the cluster
names in ``spark.checkpoint.dir``; a lost executor then costs a re-read, never a recomputation of the
whole lineage. Where that setting is absent a folder is made once per session on a local master (tests, a laptop); on a cluster
that is an error, since executors can't see each other's folders.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DIR = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """The shared folder of the session."""
    found = spark.conf.get(_DIR, None) or spark.sparkContext.getConf().get(_DIR)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_DIR} must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set(_DIR, found)
    return found.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, at: str) -> None:
    """Delete what is at a path of any file system that Spark knows."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back."""
    spark, to = df.sparkSession, path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(to)
    return spark.read.schema(df.schema).parquet(to)
