"""Replaying a packet table and stamping arrival times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtusk.plans.ordering import with_global_position
from flowtusk.plans.storage import store


def replay(packets: DataFrame, generations: int, replicas: int = 1, span_us: int | None = None) -> DataFrame:
    """Repeat the packets end to end `generations` times, each by `replicas` sources.

    `span_us` is the shift per generation; by default the length of the trace, found by a
    scalar subquery. Adds `gen` and `replica`.
    """
    if generations < 1 or replicas < 1:
        raise ValueError("generations and replicas must be positive")
    if span_us is None:
        span = packets.agg((F.max("ts_us") - F.min("ts_us") + 1).alias("span")).scalar()
    else:
        span = F.lit(span_us)
    copies = packets.withColumn("gen", F.explode(F.sequence(F.lit(0), F.lit(generations - 1))))
    if replicas > 1:
        copies = copies.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    else:
        copies = copies.withColumn("replica", F.lit(0))
    return copies.withColumn("ts_us", F.col("ts_us") + F.col("gen").cast("bigint") * span)


def replay_stream(packets: DataFrame, rows_per_batch: int | None = None, span_us: int | None = None,
                  generations: int | None = None, partitions: int | None = None) -> DataFrame:
    """The packets in the order of time, again and again, as an unbounded stream; adds `gen`.

    Each micro-batch takes the next `rows_per_batch` packets (by default a whole generation): its offsets are
    numbers of the built-in rate source, so that a repeated or restarted batch gives the same packets and
    none is left out. `span_us` is the shift per generation, by default the trace's length; `generations` ends the
    replay's rows, though not the stream. Stores the packets by their place first: runs jobs.
    """
    spark = packets.sparkSession
    placed = store(with_global_position(packets, ["ts_us", "pkt_id"], "__place"), "replayed")
    count, low, high = placed.agg(F.count("*"), F.min("ts_us"), F.max("ts_us")).first()
    if not count:
        raise ValueError("no packets to replay")
    span = span_us if span_us is not None else high - low + 1
    source = (spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch or count)
              .option("numPartitions", partitions or spark.sparkContext.defaultParallelism).load())
    turns = source.select(F.expr(f"value div {count}").alias("gen"), F.expr(f"value % {count}").alias("__place"))
    if generations is not None:
        turns = turns.filter(F.col("gen") < generations)
    return (turns.join(placed, "__place").drop("__place")
            .withColumn("ts_us", F.col("ts_us") + F.col("gen") * F.lit(span).cast("bigint")))


def with_ingress_time(packets: DataFrame) -> DataFrame:
    """Stamp the arrival time: one instant per batch query or micro-batch."""
    return packets.withColumn("ingress_us", F.unix_micros(F.current_timestamp()))
