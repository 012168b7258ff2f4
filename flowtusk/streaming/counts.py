"""Count windows over a stream: one result per packet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowtusk.operators.count_windows import CHUNK_ROWS, MAX_FLOW_ROWS, count_window_bytes
from flowtusk.plans.storage import delete_path, passing_tables

OUTPUT = "flow_id bigint, pkt_id bigint, dst_ip string, acc_bytes bigint, ts_us bigint"


def _moving_sum(n: int, ttl_ms: int) -> Callable:
    names = [part.split()[0] for part in OUTPUT.split(", ")]

    def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(chunks)).sort_values(["ts_us", "pkt_id"], kind="stable")
        kept = np.asarray(state.get[0] if state.exists else [], dtype="int64")
        lengths = np.concatenate([kept, rows["pkt_len"].to_numpy(dtype="int64")])
        totals = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.arange(len(kept) + 1, len(lengths) + 1)
        sums = totals[ends] - totals[np.maximum(ends - n, 0)]
        state.update((lengths[len(lengths) - min(n - 1, len(lengths)):].tolist(),))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield rows.assign(flow_id=key[0], acc_bytes=sums)[names]

    return update


def stream_count_window_bytes(tagged: DataFrame, n: int, ttl_ms: int = 0) -> DataFrame:
    """Bytes of each flow's last `n` packets, kept in the state store.

    Suits many flows of moderate rate: a task holds one flow's packets of one micro-batch, so
    bound the micro-batch (`maxFilesPerTrigger`), or use `count_window_batches` where a flow
    may dominate. Flows silent for `ttl_ms` of processing time are forgotten, if given.
    """
    if n < 1:
        raise ValueError("n must be positive")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return tagged.groupBy("flow_id").applyInPandasWithState(
        _moving_sum(n, ttl_ms), OUTPUT, "recent array<bigint>", "append", timeout)


_ARRIVAL = ("arrived", "ts_us", "pkt_id")
_SHARES = 16


def _tail(rows: DataFrame, n: int, ttl_us: int | None) -> DataFrame:
    """The last n-1 packets of each flow. Shares of a flow are cut to n-1 packets first, so a task
    never sees more than `_SHARES` times as many of one flow, whatever n is."""
    tail = rows.withColumn("share", F.pmod(F.xxhash64("pkt_id"), F.lit(_SHARES)))
    for group in (["flow_id", "share"], ["flow_id"]):
        newest = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in _ARRIVAL])
        tail = tail.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") < n).drop("rn")
    tail = tail.drop("share")
    if ttl_us is not None:
        last = F.max("ts_us").over(Window.partitionBy("flow_id"))
        now = rows.agg(F.max("ts_us").alias("now")).scalar()
        tail = tail.withColumn("last", last).filter(F.col("last") >= now - ttl_us).drop("last")
    return tail


def count_window_batches(tagged: DataFrame, n: int, folder: str, trigger: dict | None = None,
                         ttl_us: int | None = None, max_flow_rows: int = MAX_FLOW_ROWS,
                         chunk_rows: int = CHUNK_ROWS) -> StreamingQuery:
    """The same results through the batch operator, which splits dominating flows over tasks.

    Each micro-batch joins the stored last n-1 packets of the flows with its own rows. Results
    go to `<folder>/results/batch_id=…`; results and stored packets are written per batch, so
    that a repeated batch replaces its own output. Flows silent for `ttl_us` of event time are
    forgotten, if given. Returns the started query.
    """
    columns = ["flow_id", "pkt_id", "dst_ip", "pkt_len", "ts_us"]

    def tails(batch_id: int) -> str:
        return f"{folder}/tails/batch_id={batch_id}"

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        rows = batch.select(*columns).withColumn("arrived", F.lit(batch_id).cast("bigint"))
        if batch_id > 0:
            rows = spark.read.parquet(tails(batch_id - 1)).unionByName(rows)
        with passing_tables(spark):
            sums = count_window_bytes(rows, n, max_flow_rows=max_flow_rows, chunk_rows=chunk_rows, order=_ARRIVAL)
            (sums.filter(F.col("arrived") == batch_id).drop("arrived")
             .write.mode("overwrite").parquet(f"{folder}/results/batch_id={batch_id}"))
        _tail(rows, n, ttl_us).write.mode("overwrite").parquet(tails(batch_id))
        delete_path(spark, tails(batch_id - 2))  # the previous batch may still be repeated, older ones not
        batch.unpersist()

    return (tagged.writeStream.foreachBatch(process).option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start())


def count_window_results(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/results").drop("batch_id")
