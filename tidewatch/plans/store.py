"""Cutting lineage through tables in the shared checkpoint folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SETTING = "spark.checkpoint.dir"


@functools.cache
def _test_folder() -> str:
    return tempfile.mkdtemp(prefix="tidewatch-")


def shared_folder(spark: SparkSession) -> str:
    """Folder named by the session's ``spark.checkpoint.dir``; a temporary one only where it is unset and Spark runs in one process (tests)."""
    folder = spark.conf.get(_SETTING, None)
    if not folder and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError(f"{_SETTING} must name a folder that driver and executors share")
    return (folder or _test_folder()).rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """Folder of the tables that this application stores, inside the shared one."""
    return f"{shared_folder(spark)}/tidewatch-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Remove the tables stored by this application. Call it when no result that was built on them is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, most_rows: int = 10_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most_rows`` rows, else as it is, left to the planner."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def materialise(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` once as a parquet table in the run's folder and return a scan of that table. ``options`` are those of the writer.

    The table outlives lost executors, so later branches and rounds never recompute what came before it.
    """
    path = f"{run_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nullable(kind: T.DataType) -> T.DataType:
    """The same type with every field nullable, as tables that pass through Arrow functions come back."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(nullable(kind.keyType), nullable(kind.valueType), True)
    return kind
