"""Run metrics: latency samples and statistics, throughput, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtusk.operators.packets import with_sink
from flowtusk.operators.statistics import sample_percentile
from flowtusk.plans.ordering import with_global_position
from flowtusk.plans.storage import store
from flowtusk.schema import THRESHOLD_BYTES


def with_latency(results: DataFrame) -> DataFrame:
    """Milliseconds from the carried packet to the end of its window."""
    return results.withColumn("latency_ms", (F.col("window_end_us") - F.col("ts_us")) / 1000.0)


def latency_sample(results: DataFrame, n_sinks: int, every: int = 1, cap: int | None = None) -> DataFrame:
    """The latencies of all results in `n_sinks` result groups; a sample of them if asked for.

    `every` keeps every so many-th result of a group in order of window end, then flow, and `cap`
    that many per group. The row number within a group is taken from a global order, since a
    handful of groups would make a handful of tasks.
    """
    grouped = with_sink(with_latency(results), n_sinks).select(
        "sink_id", "window_end_us", "flow_id", "latency_ms")
    if every == 1 and cap is None:
        return grouped
    # Stored, as finding the bounds of a range partitioning reads its input twice.
    placed = with_global_position(store(grouped, "latencies"), ["sink_id", "window_end_us", "flow_id"])
    starts = placed.groupBy("sink_id").agg(F.min("position").alias("start"))  # at most n_sinks rows
    rank = F.col("position") - F.col("start")
    return (placed.join(F.broadcast(starts), "sink_id")
            .filter((F.pmod(rank, F.lit(every)) == 0) & (F.lit(True) if cap is None else rank < every * cap))
            .select("sink_id", "window_end_us", "flow_id", "latency_ms"))


# Percentiles of the latency report.
LATENCY_PERCENTILES = [0.05, 0.25, 0.5, 0.75, 0.95]


def latency_stats(samples: DataFrame, approximate: bool = False) -> DataFrame:
    """Per group: mean, minimum, percentiles (linear interpolation) and maximum.

    Exact percentiles come from an ordered table of values with running totals, so a group of any
    size is spread over tasks; this runs a job. `approximate` uses a sketch instead.
    """
    names = [f"p{round(p * 100)}_ms" for p in LATENCY_PERCENTILES]
    edges = [F.avg("latency_ms").alias("mean_ms"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms")]
    columns = ["sink_id", "mean_ms", "min_ms", *names, "max_ms"]
    if approximate:
        sketch = F.percentile_approx("latency_ms", LATENCY_PERCENTILES).alias("p")
        stats = samples.groupBy("sink_id").agg(*edges, sketch)
        return stats.withColumns({name: F.col("p")[at] for at, name in enumerate(names)}).select(columns)
    # Equal values are merged once; both parts read this smaller table.
    counts = store(samples.groupBy("sink_id", "latency_ms").agg(F.count(F.lit(1)).alias("n")), "latency-counts")
    ranks = sample_percentile(counts, "latency_ms", LATENCY_PERCENTILES, ["sink_id"], weight="n")
    stats = counts.groupBy("sink_id").agg(
        (F.sum(F.col("latency_ms") * F.col("n")) / F.sum("n")).alias("mean_ms"), *edges[1:])
    return stats.join(ranks.withColumnsRenamed({f"p{at}": name for at, name in enumerate(names)}), "sink_id").select(columns)


def mean_of_sink_means(samples: DataFrame) -> DataFrame:
    """Unweighted mean of the groups' means, and the mean over all samples."""
    groups = samples.groupBy("sink_id").agg(F.sum("latency_ms").alias("total"), F.count("latency_ms").alias("n"))
    return groups.filter(F.col("n") > 0).agg(
        F.avg(F.col("total") / F.col("n")).alias("mean_of_means_ms"),
        (F.sum("total") / F.sum("n")).alias("weighted_mean_ms"),
        F.count(F.lit(1)).alias("active_sinks"))


def throughput(packets: DataFrame, results: DataFrame, n_sinks: int) -> DataFrame:
    """Rows per second of event time: overall, at the source and at the result groups.

    The source counts over its own span, the groups over their mean span, and the overall
    figure over the time from the first packet to the last window end.
    """
    second = F.lit(1_000_000.0)
    source = packets.agg(F.count(F.lit(1)).alias("sent"), F.min("ts_us").alias("first_us"),
                         F.max("ts_us").alias("last_us"))
    groups = with_sink(results, n_sinks).groupBy("sink_id").agg(
        F.count(F.lit(1)).alias("received"),
        (F.max("window_end_us") - F.min("window_end_us")).alias("span_us"),
        F.max("window_end_us").alias("end_us"))
    sink = groups.agg(F.sum("received").alias("received"), F.avg("span_us").alias("span_us"),
                      F.max("end_us").alias("end_us"))
    # Both sides are aggregates of one row, read as scalars.
    sent, first, last = (source.select(c).scalar() for c in ("sent", "first_us", "last_us"))
    return sink.select(
        sent.alias("sent"), F.coalesce("received", F.lit(0).cast("bigint")).alias("received"),
        F.try_divide(sent, (F.greatest(F.col("end_us"), last) - first) / second).alias("overall_tps"),
        F.try_divide(sent, (last - first) / second).alias("source_tps"),
        F.try_divide(F.col("received"), F.col("span_us") / second).alias("sink_tps"))


def detector_counts(windows: DataFrame, threshold: int = THRESHOLD_BYTES) -> DataFrame:
    """Windows examined and windows above the threshold."""
    return windows.agg(F.count(F.lit(1)).alias("processed"),
                       F.count_if(F.col("acc_bytes") > threshold).alias("detected"))


def observe_detector(windows: DataFrame, name: str = "detector", threshold: int = THRESHOLD_BYTES) -> DataFrame:
    """The same counts, observed while the windows flow on to a sink, in a batch or a stream.

    A stream shows them under `name` in the `observedMetrics` of its progress.
    """
    return windows.observe(name, F.count(F.lit(1)).alias("processed"),
                           F.count_if(F.col("acc_bytes") > threshold).alias("detected"))


def generation_counts(replayed: DataFrame) -> DataFrame:
    """Packets generated and times the dataset was replayed."""
    return replayed.agg(F.count(F.lit(1)).alias("generated"), F.countDistinct("gen").alias("generations"))
