"""Small helpers of the operators in this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadlab.session import shared_folder


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the place that driver and executors share."""
    return f"{shared_folder(spark)}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


# Rows that Spark hands to a Python worker at a time; texts are long, so the default is too many.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Keep what a Python worker holds at a time small, in sessions that allow more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


class Steps:
    """Tables that a job writes on its way and drops when later tables have taken up what they hold."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = folder(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        conf = self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths = []


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; a lost executor then costs a re-read."""
    return Steps(df.sparkSession).keep(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """A text column in which null is the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often it occurs there, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
