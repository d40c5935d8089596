"""Session helpers."""

from __future__ import annotations

import atexit
import hashlib
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> SparkSession:
    """Lets the Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where it is unset, as in tests, a temporary folder of a local session takes its place."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quire-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/quire-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: it cuts the lineage, starts size estimates anew and survives lost executors."""
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, store = _folder(spark, path)
    return store.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if there is none."""
    where, store = _folder(spark, path)
    return [x.getPath().getName() for x in store.listStatus(where)] if store.exists(where) else []


def version(spark: SparkSession, *paths: str) -> str:
    """A name of the state of files and folders: their paths, sizes and times, as one hash."""
    told = hashlib.sha256()
    for path in paths:
        where, store = _folder(spark, path)
        files = store.listFiles(where, True)
        found = []
        while files.hasNext():
            x = files.next()
            found.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
        told.update(repr(sorted(found)).encode())
    return told.hexdigest()


def remove(spark: SparkSession, path: str) -> None:
    where, store = _folder(spark, path)
    store.delete(where, True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session has already ended
        return
