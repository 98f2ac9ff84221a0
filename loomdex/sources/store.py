"""The page index on disk: versioned folders and a pointer, so that readers switch at once."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..schema import PAGE


class IndexStore:
    """``path/v=N`` folders of Parquet and ``path/current``, a one-row text table that names the version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _fs(self):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def exists(self) -> bool:
        fs, path = self._fs()
        return fs.exists(path(os.path.join(self.path, "current", "_SUCCESS")))

    def version(self) -> int:
        """Current version; 0 if there is none."""
        return int(self.spark.read.text(os.path.join(self.path, "current")).first()[0]) if self.exists() else 0

    def ensure(self) -> None:
        """Create the empty index with its schema unless it exists."""
        if not self.exists():
            self.swap(self.spark.createDataFrame([], PAGE))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.path, f"v={self.version()}"))

    def swap(self, index: DataFrame) -> int:
        """Write the next version, then point to it; the old version stays for running readers."""
        n = self.version() + 1
        index.write.mode("overwrite").parquet(os.path.join(self.path, f"v={n}"))
        self.spark.createDataFrame([(str(n),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(self.path, "current"))
        return n

    def reset(self) -> int:
        """An empty index of the full schema as the next version."""
        return self.swap(self.spark.createDataFrame([], PAGE))

    def vacuum(self, keep: int = 2) -> None:
        """Delete versions older than the last ``keep``."""
        fs, path = self._fs()
        now = self.version()
        for n in range(1, now - keep + 1):
            fs.delete(path(os.path.join(self.path, f"v={n}")), True)
