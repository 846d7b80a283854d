"""Session settings the library relies on."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Methods above 8000 bytes are never compiled by the JVM; wide projections are split instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def builder(app: str = "glyco", master: str | None = None) -> SparkSession.Builder:
    """A session builder with the library's settings; cluster sizing stays with the caller."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for key, value in SETTINGS.items():
        b = b.config(key, value)
    return b


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


# Sizes up to which one task may hold a series or a group of values, and up to which values are counted one by one.
LIMITS = {
    "spark.glyco.series.maxRows": 4_000_000,
    "spark.glyco.quantiles.groupRows": 2_000_000,
    "spark.glyco.quantiles.cells": 2_000_000,
}


def limit(spark: SparkSession, name: str) -> int:
    """A size limit, from the session when it sets one."""
    return int(spark.conf.get(name, str(LIMITS[name])))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession, packages: tuple[str, ...] = ("glyco",)) -> SparkSession:
    """Send the library's source to the executors, once per application, so that Python workers can import it.

    Not needed where the library is installed on every node or was passed with ``--py-files``. ``packages``
    are folders beside this package.
    """
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        with tempfile.TemporaryDirectory() as folder:  # the driver only; Spark copies the archive when it is added
            for package in packages:
                shutil.copytree(f"{root}/{package}", f"{folder}/lib/{package}", ignore=shutil.ignore_patterns("__pycache__"))
            archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="glyco-"), "glyco_lib"), "zip", f"{folder}/lib")
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` must name shared storage. Only a local
    master, as in tests, gets a temporary folder when nothing is set.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="glyco-ckpt-")
    sc.setCheckpointDir(named)
    return named


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder that ``drop_written`` knows."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4()}"
    _WRITTEN.append(path)
    return path


def write_through(df: DataFrame) -> DataFrame:
    """Write a table to the checkpoint folder as Parquet and read it back.

    Cuts the lineage like ``checkpoint`` does, and later passes read only the columns
    they need. ``drop_written`` removes the tables when their results are stored.
    """
    path = checkpoint_path(df.sparkSession, "table")
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


_WRITTEN: list[str] = []
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``write_through`` gave, once everything that reads them is stored, and the shuffle files behind them.

    Spark deletes the shuffle files of finished jobs when the driver's JVM collects what refers to them, which a driver
    with room in its heap does late; it is asked to.
    """
    for table in tables:
        path = _PATHS.pop(table)
        _WRITTEN.remove(path)
        _delete(table.sparkSession, path)
    gc.collect()
    if spark := SparkSession.getActiveSession():
        spark._jvm.System.gc()


def drop_written(spark: SparkSession) -> int:
    """Delete the tables that ``write_through`` has left so far; returns how many there were.

    Call it when the results that read them are stored: results are computed lazily.
    """
    count = len(_WRITTEN)
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())
    return count
