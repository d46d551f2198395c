"""Cutting lineage with written tables in the folder that all executors share, and small files beside them.

The folder is the one the session names in ``spark.checkpoint.dir``. Where that is unset, a folder of our own is used on
a local master (tests, a laptop); on a cluster that would be machine-local, so there it is an error. A written table
survives the loss of any executor and, unlike ``checkpoint()``, the plan that makes it runs once. ``drop`` deletes what
a loop has used up; the rest is deleted when the driver ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; on a local master it is set to a temporary one where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="loam-")
        spark.conf.set("spark.checkpoint.dir", at)
        atexit.register(shutil.rmtree, urlparse(at).path, ignore_errors=True)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/loam/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def written(df: DataFrame, name: str = "t", **options) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, without lineage."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes written tables that nothing reads any more."""
    for t in tables:
        if t is not None and (path := getattr(t, "_scratch", None)) and path in _WRITTEN:
            delete(_WRITTEN.pop(path), path)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it does not exist."""
    fs, p = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all: written beside its place and renamed."""
    fs, p = _path(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(aside, p):
        fs.delete(aside, False)
        raise FileExistsError(path)


def get_text(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


@atexit.register
def _clean() -> None:
    for path, spark in _WRITTEN.items():
        try:
            delete(spark, path)
        except Exception:  # the session has ended
            return
