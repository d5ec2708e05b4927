"""Tables that several queries share, built once and read from files after."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_AT: dict[tuple[str, ...], tuple[str, object]] = {}


def shared_dir(spark: SparkSession) -> str | None:
    """spark.checkpoint.dir as the session has it; a temporary folder only where driver
    and executors are one process; else None."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    return tempfile.mkdtemp(prefix="stratafold-") if spark.sparkContext.master.startswith("local") else None


def state_of(spark: SparkSession, path: str) -> str:
    """Length and time of the file or folder at ``path``: a changed input is built anew."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
    return f"{status.getLen()}-{status.getModificationTime()}"


def frozen(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` gives for the input at ``source``, written once an
    application.  Self-joins and later queries then read files instead of its plan;
    without a shared folder the plan itself is returned."""
    key = (spark.sparkContext.applicationId, name, source, state_of(spark, source))
    if key not in _AT:
        found, folder = build(), shared_dir(spark)
        if folder is None:
            return found
        path = f"{folder}/stratafold/{name}-{uuid.uuid4().hex}"
        found.write.parquet(path)
        _AT[key] = path, found.schema
    path, schema = _AT[key]
    return spark.read.schema(schema).parquet(path)
