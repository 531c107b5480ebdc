"""Shared storage and file access for the operators of this subpackage.

Intermediate tables and output files go to a fresh folder under
``spark.checkpoint.dir``, which every executor and the driver can reach.  Without
that setting only a session on one machine has a folder (/tmp/checkpoints); on a
cluster it is an error.
Nothing here keeps state in executors: a lost executor costs a re-read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (root or "file:///tmp/checkpoints").rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A path that no other call gets, below the shared root."""
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: cuts lineage, and is shared by later steps."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._folder = path
    return table


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for table in tables:
        if folder := getattr(table, "_folder", None):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def filesystem(path: str):
    """(pyarrow file system, path in it) for a URI or plain path, usable in Python workers."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def only(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The named columns alone, so that further or clashing columns of the caller don't matter."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


_held: dict = {}


def held(key, make):
    """A worker process's one large object: kept from task to task, freed as soon as another is asked for."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Frees what ``held`` keeps and gives the memory back to the system where the C library can."""
    import ctypes
    import gc

    if _held:
        _held.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass
