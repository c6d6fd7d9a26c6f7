"""Folders for what is written on the way: shared by the driver and all executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Where it is unset, a temporary folder will do
    if all runs in one process, as in tests; on a cluster that is an error, as one machine's folder would lose rows."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there goes when the interpreter ends."""
    path = f"{shared_dir(spark)}/lodestar/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read it back, so that a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = weakref.ref(out), path
    return out


_paths: dict[int, tuple] = {}


def forget(df: DataFrame) -> None:
    """Remove what ``written`` wrote for this DataFrame, when nothing reads it any more."""
    found = _paths.pop(id(df), None)
    if found and found[0]() is df:
        _drop(df.sparkSession, found[1])


def _drop(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may have ended before the interpreter does
        pass
