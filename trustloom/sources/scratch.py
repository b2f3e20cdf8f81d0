"""Intermediate tables of iterative operators, in the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DIR = "spark.checkpoint.dir"


def path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet. A folder of our own is made on a local master only."""
    base = spark.conf.get(_DIR, None) or spark.sparkContext.getConf().get(_DIR)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_DIR} must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set(_DIR, base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back: its lineage ends here, and a lost executor costs a re-read."""
    spark, to = df.sparkSession, path(df.sparkSession, name)
    df.write.parquet(to)
    return spark.read.schema(df.schema).parquet(to)
