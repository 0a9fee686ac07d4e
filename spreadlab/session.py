"""Session settings and durable intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Joins are left to adaptive execution: it broadcasts only sides whose measured
# size is under the threshold, and splits the partitions of hot keys.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128m",
}


# Folders to be removed at the end.
_LEFT: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job in this package relies on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; its intermediate tables go when it ends."""
    folder = tempfile.mkdtemp(prefix="spreadlab-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spreadlab")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", folder)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session, else one in its warehouse.

    The latter is removed when a local session's program ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_steps-{context.applicationId}"
    if context.master.startswith("local") and folder.startswith("file:") and folder not in _LEFT:
        _LEFT.add(folder)
        atexit.register(shutil.rmtree, "/" + folder.removeprefix("file:").lstrip("/"), ignore_errors=True)
    return folder


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/spreadlab/{spark.sparkContext.applicationId}"


def drop_settled(spark: SparkSession) -> None:
    """Remove this application's intermediate tables; call it when its results are saved."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settle(df: DataFrame, name: str = "step", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts lineage like a checkpoint, but as a table: later reads keep
    column pruning and filter pushdown, and a lost executor costs a re-read.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
