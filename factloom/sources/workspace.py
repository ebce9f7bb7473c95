"""The shared folder in which intermediate tables and checkpoints live.

Executors may be lost at any time, so nothing here relies on storage that one
executor owns.  Lineage is cut by writing Parquet into the folder named by
``spark.checkpoint.dir``, which every machine of the cluster can read.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CREATED: list[str] = []
_WRITTEN: list[str] = []  # the tables of this process, oldest first
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_ROOT = str(Path(__file__).resolve().parents[2])


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it.

    It also lowers the bytes of an Arrow batch, where they are at Spark's default:
    64 MB a batch, which doubles while it grows, in each task is too much beside
    Python workers for small executors, and the kernels gain nothing from it.
    """
    if spark.conf.get(_BATCH) == "67108864b":
        spark.conf.set(_BATCH, "4m")
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` for functions that use this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.

    ``spark.checkpoint.dir`` decides.  Only where it is unset, and only in local
    mode, a folder of our own is made and set as the checkpoint directory.  On a
    cluster without the setting this raises: a machine-local folder would be
    unreadable for the other machines.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    present = spark.sparkContext._jsc.sc().getCheckpointDir()
    if present.isDefined():
        return present.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    own = tempfile.mkdtemp(prefix="factloom-")
    _CREATED.append(own)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


@atexit.register
def _remove_own() -> None:
    for path in _CREATED:
        shutil.rmtree(path, ignore_errors=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    The copy has exact file statistics, so the planner picks join strategies by
    its true size, and a lost executor costs only a re-read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_written() -> int:
    """How many written tables of this process there are."""
    return len(_WRITTEN)


def drop_tables(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Removes the written tables of this process, from the one numbered ``since`` on, but the last ``keep``.

    For callers who have read or written their result, as nothing that still
    depends on these tables can be read afterwards.
    """
    last = len(_WRITTEN) - keep
    for path in _WRITTEN[since:last]:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    del _WRITTEN[since:last]
