"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where that is unset a local master gets a temporary folder, gone at exit; on
    a cluster, whose machines have folders of their own, that is an error.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or _own_dir.get("path")
    if not path:
        if (master := spark.sparkContext.master).partition("[")[0] != "local":
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        own = tempfile.mkdtemp(prefix="toolweave-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = _own_dir["path"] = f"file://{own}"
    return path.rstrip("/")


def _tables_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/toolweave-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for files that one step hands to the next."""
    return f"{_tables_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession) -> None:
    """Delete what this application has materialized; call it when no result that reads it is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
