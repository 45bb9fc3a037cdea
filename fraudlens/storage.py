"""Tables in the shared folder: how jobs cut a lineage, and how they clean up."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _path(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, removed when the application ends.

    The setting names a folder that every executor can reach. Only where it is
    unset (tests on one machine) a folder of this machine is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="fraudlens-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/fraudlens-{uuid.uuid4().hex}"
    files, path = _path(spark, folder)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def written(frame: DataFrame, label: str = "table") -> DataFrame:
    """``frame`` as a table in the shared folder, read again.

    What follows depends on the files only, so a lost executor costs a re-read
    and not the work that led there.
    """
    spark = frame.sparkSession
    folder = f"{shared_folder(spark)}/{label}"
    frame.write.option("compression", "zstd").parquet(folder)
    out = spark.read.schema(frame.schema).parquet(folder)
    _FOLDERS[out] = folder
    return out


def selected(frame: DataFrame, *columns) -> DataFrame:
    """``frame.select`` of a table that ``written`` gave, which ``discard`` then takes instead."""
    out = frame.select(*columns)
    if frame in _FOLDERS:
        _FOLDERS[out] = _FOLDERS.pop(frame)
    return out


def discard(*frames: DataFrame | None) -> None:
    """Remove tables that ``written`` gave and that nothing will read again."""
    for frame in frames:
        folder = None if frame is None else _FOLDERS.pop(frame, None)
        if folder:
            files, path = _path(frame.sparkSession, folder)
            files.delete(path.getParent(), True)
