"""Incremental ingestion: appended lines, micro-batch by micro-batch, into the fact store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.model import Factory
from ..functions.text import session_of
from ..operators.transcripts import min_turn_gate
from ..plans.jobs import reconcile_records
from ..settings import Settings
from ..sources.sessions import session_lines
from ..sources.store import FactStore
from ..sources.workspace import materialize, ship_package
from .tail import TailSource


def start(spark: SparkSession, pattern: str, store: FactStore, checkpoint: str, factory: Factory, s: Settings | None = None):
    """A query that takes what is there and stops (availableNow); run it from a scheduler.

    A batch is applied once: its number is kept beside the store's version, so a
    batch that is tried again after its commit does nothing.  The lines of a
    session with too few human turns wait beside the checkpoint and are read again
    with those that follow, so a session that grows slowly loses none of its turns.
    """
    s = s or Settings()
    ship_package(spark)
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("tail").option("path", pattern).load()
    waiting = lambda number: f"{checkpoint}/waiting/{number}"

    def apply(batch: DataFrame, number: int) -> None:
        done = store._path(f"batch-{number}")
        if store._fs.exists(done):
            return
        fresh = batch.select("path", "offset", "value")
        before = _waiting(spark, waiting(number - 1))
        held = before.select("path").distinct()
        # a file whose first new line isn't its first, and that didn't wait, has passed the gate before
        resumed = fresh.groupBy("path").agg(F.min("offset").alias("first")).where("first > 0").join(held, "path", "left_anti").select(session_of("path").alias("session"))
        every = materialize(fresh.unionByName(before), "lines")
        records = session_lines(every)
        resumed = materialize(resumed, "resumed")
        turns = reconcile_records(records, store, factory, s, resumed=resumed).tables["turns"]
        passed = min_turn_gate(turns, s.min_human_turns, resumed).select("session").union(resumed).distinct()
        short = every.withColumn("session", session_of("path")).join(passed, "session", "left_anti").select("path", "offset", "value")
        short.write.mode("overwrite").parquet(waiting(number))
        store._fs.create(done, True).close()

    return lines.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _waiting(spark: SparkSession, path: str) -> DataFrame:
    """Lines that wait from the batch before."""
    schema = "path string, offset long, value string"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)
