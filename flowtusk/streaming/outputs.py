"""Streaming sinks: early alerts, running peaks, one result set per batch, latency rows and statistics.

All of them write per micro-batch into a folder of their own, so a batch that is repeated
after a failure replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowtusk.functions.keys import FlowKey, flow_key
from flowtusk.operators.crossings import first_crossings
from flowtusk.operators.packets import heavy_hitters
from flowtusk.operators.reports import flow_peaks, merge_sink_peaks
from flowtusk.plans.storage import child_names, delete_path, path_exists
from flowtusk.schema import SLIDE_US, THRESHOLD_BYTES, WINDOW_US

# The default micro-batch interval; pass as `trigger=`.
EVERY_BATCH = {"processingTime": "100 milliseconds"}
UNTIL_DONE = {"availableNow": True}


def _start(df: DataFrame, mode: str, process: Callable, folder: str, trigger: dict | None) -> StreamingQuery:
    return (df.writeStream.outputMode(mode).foreachBatch(process)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(**(trigger or UNTIL_DONE)).start())


def write_windows(windows: DataFrame, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Append closed windows to `<folder>/windows` as Parquet."""
    return (windows.writeStream.outputMode("append").format("parquet")
            .option("path", f"{folder}/windows").option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(**(trigger or UNTIL_DONE)).start())


def write_result_sets(hits: DataFrame, folder: str, trigger: dict | None = None, text: bool = False) -> StreamingQuery:
    """One result set per micro-batch, `<folder>/results/batch_id=…`."""
    def process(batch: DataFrame, batch_id: int) -> None:
        path = f"{folder}/results/batch_id={batch_id}"
        if text:
            line = F.concat_ws(",", "flow_id", "dst_ip", "acc_bytes", "ts_us")
            batch.select(line.alias("value")).write.mode("overwrite").text(path)
        else:
            batch.write.mode("overwrite").parquet(path)
    return _start(hits, "append", process, folder, trigger)


def alert_early(windows: DataFrame, folder: str, delay_us: int, threshold: int = THRESHOLD_BYTES,
                trigger: dict | None = None) -> StreamingQuery:
    """Report each (flow, window) in the micro-batch in which it first exceeds the threshold.

    Sums only grow, so a crossing is final. `windows` is read in update mode, with a watermark
    of `delay_us`; windows reported before are left out. Only the keys of windows that can still
    change are remembered.
    """
    keys = ["flow_id", "window_start_us", "window_end_us"]

    def seen_path(batch_id: int) -> str:
        return f"{folder}/seen/batch_id={batch_id}"

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        crossed = heavy_hitters(batch, threshold)
        seen = crossed.select(*keys)
        if batch_id > 0:
            before = spark.read.parquet(seen_path(batch_id - 1))
            crossed = crossed.join(before, keys, "left_anti")
            seen = before.unionByName(seen).distinct()
        crossed.write.mode("overwrite").parquet(f"{folder}/alerts/batch_id={batch_id}")
        newest = batch.agg(F.max("window_start_us").alias("m")).scalar()
        open_still = F.coalesce(F.col("window_end_us") > newest - delay_us, F.lit(True))
        seen.filter(open_still).write.mode("overwrite").parquet(seen_path(batch_id))
        delete_path(spark, seen_path(batch_id - 2))
        batch.unpersist()

    return _start(windows, "update", process, folder, trigger)


def alert_crossings(packets: DataFrame, folder: str, delay_us: int, threshold: int = THRESHOLD_BYTES, length_us: int = WINDOW_US,
                    slide_us: int = SLIDE_US, key: str | FlowKey = "poly17", trigger: dict | None = None) -> StreamingQuery:
    """Report each (flow, window) with the packet at which it first exceeds the threshold, in the micro-batch that
    brings it, to `<folder>/alerts`.

    `packets` is a stream of packets. Those of windows that can still change are kept between batches, with
    the windows reported; a packet more than `delay_us` older than the newest one before its batch is dropped.
    Of windows in which packets arrived out of order the crossing is that in the order of time of all
    packets there by then. With `length_us` windows this equals `operators.crossings.first_crossings`
    for input in the order of time.
    """
    keys, columns = ["flow_id", "window_start_us", "window_end_us"], ["pkt_id", "ts_us", "src_ip", "dst_ip", "pkt_len"]
    columns = list(dict.fromkeys([*columns, *flow_key(key).inputs]))

    def path(kind: str, batch_id: int) -> str:
        return f"{folder}/{kind}/batch_id={batch_id}"

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows, horizon, seen = batch.select(*columns), None, None
        if batch_id > 0:
            kept, seen = (spark.read.parquet(path(kind, batch_id - 1)) for kind in ("open", "seen"))
            newest = kept.agg(F.max("ts_us")).first()[0]
            if newest is not None:
                horizon = newest - delay_us
                rows = rows.filter(F.col("ts_us") >= horizon)
            rows = kept.unionByName(rows)
        rows = rows.persist()
        found = first_crossings(rows, threshold, length_us, slide_us, key)
        if horizon is not None:
            found = found.filter(F.col("window_end_us") > horizon)
        if seen is not None:
            found = found.join(seen, keys, "left_anti")
        found.write.mode("overwrite").parquet(path("alerts", batch_id))
        newest = rows.agg(F.max("ts_us")).first()[0]
        closed = F.lit(0 if newest is None else newest - delay_us)
        rows.filter(F.col("ts_us") >= closed - length_us).write.mode("overwrite").parquet(path("open", batch_id))
        reported = spark.read.schema(found.schema).parquet(path("alerts", batch_id)).select(*keys)
        reported = reported if seen is None else seen.unionByName(reported)
        reported.filter(F.col("window_end_us") > closed).write.mode("overwrite").parquet(path("seen", batch_id))
        for kind in ("open", "seen"):
            delete_path(spark, path(kind, batch_id - 2))
        rows.unpersist()

    return _start(packets, "append", process, folder, trigger)


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/alerts").drop("batch_id")


def _runs(batches: int) -> list[tuple[int, int]]:
    """The runs, as first and last batch, that hold the first `batches` micro-batches: sizes are the powers of two in
    that number."""
    out, begin = [], 0
    for bit in reversed(range(batches.bit_length())):
        if batches >> bit & 1:
            out.append((begin, begin + (1 << bit) - 1))
            begin += 1 << bit
    return out


def _run_path(folder: str, run: tuple[int, int]) -> str:
    return f"{folder}/peaks/run={run[0]}-{run[1]}"


def keep_flow_peaks(hits: DataFrame, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Running peaks per flow in `<folder>/peaks`, as sorted-merge runs.

    A micro-batch writes the peaks of its own flows. Like the carry of a binary counter it takes the runs before it
    along, when these are of equal size: each row is written again once per doubling, so what a batch writes
    follows the batches and not the table. Runs that went into another are deleted one batch later, when that one
    cannot be repeated any more. `current_peaks` merges the runs left, at most one per power of two.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        spark, peaks = batch.sparkSession, flow_peaks(batch)
        before, after = set(_runs(batch_id)), _runs(batch_id + 1)
        taken = sorted(before - set(after))
        if taken:
            stored = spark.read.parquet(*[_run_path(folder, run) for run in taken])
            peaks = merge_sink_peaks(stored.unionByName(peaks))
        peaks.write.mode("overwrite").parquet(_run_path(folder, after[-1]))
        if batch_id > 0:
            for run in set(_runs(batch_id - 1)) - before:
                delete_path(spark, _run_path(folder, run))

    return _start(hits, "append", process, folder, trigger)


def current_peaks(spark: SparkSession, folder: str) -> DataFrame:
    """Peaks per flow over all micro-batches written so far."""
    found = {tuple(map(int, name[4:].split("-"))) for name in child_names(spark, f"{folder}/peaks") if name.startswith("run=")}
    whole = [run for run in found if path_exists(spark, f"{_run_path(folder, run)}/_SUCCESS")]
    runs = _runs(max(last for _, last in whole) + 1)
    return merge_sink_peaks(spark.read.parquet(*[_run_path(folder, run) for run in runs]))


#: Values that a latency sketch keeps per level; ranks it gives are off by at most RANK_ERROR (99 % sure).
SKETCH_K, RANK_ERROR = 2000, 0.002


def write_latency_stats(results: DataFrame, folder: str, n_sinks: int = 1, latency: Column | None = None,
                        trigger: dict | None = None) -> StreamingQuery:
    """Per micro-batch and result group: number, sum, extremes and a mergeable quantile sketch of the latencies in
    milliseconds, in `<folder>/latency_stats/batch_id=…`: one small row per group and batch, whatever the rate.

    `latency` is an expression over the results; by default the time from the packet to the processing of its batch.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        value = (F.unix_micros(F.current_timestamp()) - F.col("ts_us")) / 1000.0 if latency is None else latency
        rows = batch.select(F.expr(f"cast(pmod(flow_id, {n_sinks}) as int)").alias("sink_id"), value.cast("double").alias("ms"))
        (rows.filter("ms IS NOT NULL").groupBy("sink_id").agg(
            F.count("*").alias("samples"), F.sum("ms").alias("sum_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"),
            F.kll_sketch_agg_double("ms", SKETCH_K).alias("sketch"))
         .write.mode("overwrite").parquet(f"{folder}/latency_stats/batch_id={batch_id}"))

    return _start(results, "append", process, folder, trigger)


def live_latency_stats(spark: SparkSession, folder: str, percentiles: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Per result group over all micro-batches so far: samples, mean, extremes (exact) and percentiles `p5_ms`, ...

    A percentile is a value whose rank is off by at most RANK_ERROR of the samples.
    """
    merged = spark.read.parquet(f"{folder}/latency_stats").groupBy("sink_id").agg(
        F.sum("samples").alias("samples"), (F.sum("sum_ms") / F.sum("samples")).alias("mean_ms"), F.min("min_ms").alias("min_ms"),
        F.max("max_ms").alias("max_ms"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))
    return merged.select("*", *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(f"p{p * 100:g}_ms")
                                for p in percentiles]).drop("sketch")


def write_live_latency(hits: DataFrame, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Milliseconds from each result's packet to the time its micro-batch is processed."""
    def process(batch: DataFrame, batch_id: int) -> None:
        now_us = F.unix_micros(F.current_timestamp())
        (batch.select("flow_id", "window_end_us", ((now_us - F.col("ts_us")) / 1000.0).alias("latency_ms"))
         .write.mode("overwrite").parquet(f"{folder}/latency/batch_id={batch_id}"))
    return _start(hits, "append", process, folder, trigger)


def progress_metrics(query: StreamingQuery) -> dict:
    """Rows read, rows per second and late rows of the last micro-batch."""
    last = query.lastProgress
    if not last:
        return {}
    return {
        "rows": last["numInputRows"],
        "processed_rows_per_second": last.get("processedRowsPerSecond"),
        "rows_dropped_by_watermark": sum(s.get("numRowsDroppedByWatermark", 0) for s in last["stateOperators"]),
    }
