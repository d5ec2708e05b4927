"""Intermediate tables in the folder that driver and executors share.

A table written here cuts lineage and survives the loss of any executor: later
stages read files, not another executor's disk.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir as the session has it.

    Only where that is unset and the master is local is a temporary folder used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="stratafold-")
    return _LOCAL[app]


def table(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a frame over the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratafold/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Meanwhile each query's shuffle files go when it ends; else they stay until the
    driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def mark() -> int:
    """A point in the list of written tables, for :func:`release`."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the tables written after ``since`` but for those kept; only for tables
    that no result still reads."""
    kept = {df.stored_at for df in keep}
    for path in [p for p in _WRITTEN[since:] if p not in kept]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _WRITTEN.remove(path)
