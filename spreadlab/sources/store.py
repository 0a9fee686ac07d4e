"""Datasets as folders of Parquet tables: ``root/<dataset>/<table>``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

RAW = "raw"


class Store:
    """Save, load and list the tables of datasets under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, dataset: str, name: str) -> str:
        return f"{self.root}/{dataset}/{name}"

    def _children(self, path: str) -> list[str]:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory()]
        return sorted(n for n in names if not n.startswith((".", "_")))

    def list_datasets(self) -> list[str]:
        return [d for d in self._children(self.root) if RAW in self._children(f"{self.root}/{d}")]

    def list_tables(self, dataset: str) -> list[str]:
        return self._children(f"{self.root}/{dataset}")

    def require_dataset(self, dataset: str) -> None:
        if dataset not in self._children(self.root):
            raise LookupError(f"dataset {dataset} not found")
        if RAW not in self.list_tables(dataset):
            raise LookupError(f"dataset {dataset} has no {RAW} table")

    def save_raw(self, posts: DataFrame, dataset: str) -> None:
        self.save_table(posts, dataset, RAW)

    def save_table(self, df: DataFrame, dataset: str, name: str, cluster_by: Sequence[str] = ()) -> None:
        """Replace a table. ``cluster_by`` orders the files so that key filters skip most of them."""
        if cluster_by:
            df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
        df.write.mode("overwrite").parquet(self.path(dataset, name))

    def load_table(self, dataset: str, name: str) -> DataFrame:
        try:
            return self.spark.read.parquet(self.path(dataset, name))
        except AnalysisException as error:
            raise LookupError(f"table {name} of dataset {dataset} has not been computed yet") from error

    def raw(self, dataset: str) -> DataFrame:
        self.require_dataset(dataset)
        return self.load_table(dataset, RAW)

    def copy_table(self, other: Store, mapping: Mapping[str, str], name: str) -> dict[str, int]:
        """Append a table of each source dataset to its target dataset in another store; rows copied."""
        copied = {}
        for source, target in mapping.items():
            rows = self.load_table(source, name)
            rows.write.mode("append").parquet(other.path(target, name))
            copied[source] = rows.count()
        return copied
