"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where that is unset, a local session (tests, benches) sets a temporary one; a cluster has no such folder that all
    its machines see, so there it is an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tesserae-"))
    return sc.getCheckpointDir()


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, below this application's own, that nothing uses yet."""
    return f"{shared_dir(spark).rstrip('/')}/tesserae/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: work that several later steps use is done once."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
