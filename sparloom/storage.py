"""Shared storage for staged results.

Long pipelines cut their lineage by writing a table to the folder the cluster
names in ``spark.checkpoint.dir`` and reading it again, so that a lost executor
costs a re-read and not a re-computation. Only where that setting is missing and
the master is local (tests, a laptop) is a temporary folder used; on a cluster
that is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: list[str] = []
_PATHS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read and write."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="sparloom-"))
    return "file://" + _FALLBACK[0]


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a path."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        fs, hpath = filesystem(spark, path)
        fs.delete(hpath, True)
    except Exception:  # the context has ended already; the folder is the cluster's to clean
        pass


@contextmanager
def released(spark: SparkSession):
    """Removes what is staged inside as soon as its user is done, not when the driver ends."""
    before = len(_PATHS)
    try:
        yield
    finally:
        for path in _PATHS[before:]:
            _remove(spark, path)
        del _PATHS[before:]


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; whoever reads one may run this package on the workers."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application.

    Workers import it by name; where it is not installed on the nodes, and not on
    their path, they get it as a zip file from the driver.
    """
    import shutil
    from pathlib import Path

    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="sparloom-package-")
    staging = Path(folder) / "tree"
    shutil.copytree(here, staging / here.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{folder}/sparloom", "zip", staging))
    shutil.rmtree(staging)
    atexit.register(shutil.rmtree, folder, True)
    _SHIPPED.add(context.applicationId)
