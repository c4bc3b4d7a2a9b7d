"""Tables that outlive a query's stages, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources.shared import shared_dir


#: Rows to a file of a table of a few columns.
FILE_ROWS = 20_000


def _own_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/tesserae/{spark.sparkContext.applicationId}"


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """A table of at most so many rows, of a few columns, dealt to be written as files of about FILE_ROWS, not one for each task.

    On a mounted folder an executor forks for the permissions of every file that it writes.
    """
    return df.repartition(rows // FILE_ROWS + 1)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: its lineage ends there.

    The table stays until the folder is cleared, as later queries may still read it.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns that an operator reads, under names of its own, so that extra columns never clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[F.col(c) for c in more])


def clear(spark: SparkSession) -> None:
    """Deletes the tables that this application has staged; results that read them must have been written or collected before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
