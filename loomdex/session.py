"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package: where no path that they inherit holds it, it is sent along."""
    home = os.path.dirname(_ROOT)
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    app = spark.sparkContext.applicationId
    if app in _shipped or home in known or "site-packages" in home:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="loomdex-code-"), "loomdex.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(_ROOT):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, home))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the test tables."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where it is unset (tests, local mode) a
    temporary folder is set for the session; a cluster never gets here.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="loomdex-")
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    Unlike a cached DataFrame the written table survives the loss of executors.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_built: dict[tuple, object] = {}


def built_once(spark: SparkSession, source: DataFrame, label: str, build: Callable[[], object]) -> object:
    """What ``build`` makes of the files of ``source``, made once a session as long as these files do not change.

    For tables of the shared folder that several queries use, such as a search index.
    """
    files = sorted(source.inputFiles())
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    states = []
    for f in files:
        at = hadoop(f)
        st = at.getFileSystem(conf).getFileStatus(at)
        states.append((f, st.getLen(), st.getModificationTime()))
    key = (spark.sparkContext.applicationId, label, tuple(states))
    if key not in _built:
        _built[key] = build()
    return _built[key]


def spread(df: DataFrame) -> DataFrame:
    """Give a CPU-heavy Python stage at least one task per core.

    Only an input with fewer scan partitions than cores (a small file) is repartitioned; large
    inputs keep their scan partitions and are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
