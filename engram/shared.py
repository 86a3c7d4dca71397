"""Tables that are written once and read by several branches, in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Folders of the scopes that are open, the innermost last; each thread has its own.
_SCOPES: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())


def remove(spark: SparkSession, path: str) -> None:
    """Removes a table from the shared folder, whichever file system that is on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are written inside are removed at the end; what needs them must be computed by then."""
    path = shared_dir(spark)
    before = _SCOPES.set((*_SCOPES.get(), path))
    try:
        yield
    finally:
        _SCOPES.reset(before)
        remove(spark, path)


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-shared-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share.

    The cluster names its parent in spark.checkpoint.dir. Where that is unset, a temporary folder is only taken in
    local mode, in which driver and executors are one process.
    """
    parent = spark.conf.get("spark.checkpoint.dir", None)
    if not parent:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        parent = _local_dir()
    if _SCOPES.get():
        parent = _SCOPES.get()[-1]
    return f"{parent.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, read by several branches, safe when executors are lost."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, name: str, source: str, build) -> str:
    """The folder of what build(path) makes of the table at source, made once for as long as the table's size and time stay the same,
    and outside of all scopes: whoever owns the shared folder removes it. name: with the number of the format, so that what another
    version of the code has built isn't read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(source)
    fs = at.getFileSystem(conf)
    held = f"{source} {fs.getFileStatus(at).getModificationTime()} {fs.getContentSummary(at).getLength()}"
    opened = _SCOPES.set(())
    try:
        new = shared_dir(spark)
        path = f"{new.rpartition('/')[0]}/kept-{name}-{hashlib.sha256(held.encode()).hexdigest()[:16]}"
        to = jvm.org.apache.hadoop.fs.Path(path)
        fs = to.getFileSystem(conf)
        if not fs.exists(to):
            build(new)
            if not fs.rename(jvm.org.apache.hadoop.fs.Path(new), to) and not fs.exists(to):  # another job may have been first
                raise OSError(f"{new} can't become {path}")
    finally:
        _SCOPES.reset(opened)
    return path
