"""Arrival time as the window clock.

Each micro-batch stamps its packets once and writes them before any window is formed. A batch that is
repeated after a failure finds its stamps and leaves them, so packets fall into the same windows
however often a query starts again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowtusk.plans.storage import path_exists

UNTIL_DONE = {"availableNow": True}


def _now() -> Column:
    return F.unix_micros(F.current_timestamp())


def stamp_arrivals(packets: DataFrame, folder: str, trigger: dict | None = None, now: Callable[[], Column] = _now) -> StreamingQuery:
    """Write the packets of a stream to `<folder>/arrivals/batch_id=…` with `ingress_us`, the time of their
    micro-batch. `now` makes the stamp."""
    def process(batch: DataFrame, batch_id: int) -> None:
        path = f"{folder}/arrivals/batch_id={batch_id}"
        if not path_exists(batch.sparkSession, f"{path}/_SUCCESS"):
            batch.withColumn("ingress_us", now()).write.mode("overwrite").parquet(path)

    return (packets.writeStream.foreachBatch(process).option("checkpointLocation", f"{folder}/arrivals-checkpoint")
            .trigger(**(trigger or UNTIL_DONE)).start())


def _by_arrival(rows: DataFrame) -> DataFrame:
    return rows.drop("batch_id").withColumnRenamed("ts_us", "sent_us").withColumnRenamed("ingress_us", "ts_us")


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """The stamped packets as a table: `ts_us` is the arrival, `sent_us` the packet's own time."""
    return _by_arrival(spark.read.parquet(f"{folder}/arrivals"))


def stream_arrivals(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same as a stream, for windows in arrival time. Needs a batch that is written."""
    schema = spark.read.parquet(f"{folder}/arrivals").schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _by_arrival(reader.parquet(f"{folder}/arrivals"))
