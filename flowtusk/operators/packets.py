"""Row-wise operators: projections, flow tagging and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtusk.functions.keys import FlowKey, flow_key
from flowtusk.schema import TCP, THRESHOLD_BYTES


def reorder(packets: DataFrame) -> DataFrame:
    """Time, addresses, ports, protocol and length."""
    return packets.select("ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "pkt_len")


def select_emitted(packets: DataFrame) -> DataFrame:
    """Addresses, length and time."""
    return packets.select("src_ip", "dst_ip", "pkt_len", "ts_us")


def tag_flow(packets: DataFrame, key: str | FlowKey = "poly17", key_expr: Column | None = None) -> DataFrame:
    """Attach the flow id; keep packet id, addresses, length and time."""
    flow_id = key_expr if key_expr is not None else flow_key(key).column()
    return packets.select(
        "pkt_id", flow_id.alias("flow_id"), "src_ip", "dst_ip",
        F.col("pkt_len").cast("bigint").alias("pkt_len"), F.col("ts_us").cast("bigint").alias("ts_us"),
    )


def tcp_only(packets: DataFrame) -> DataFrame:
    return packets.filter(F.col("protocol") == TCP)


def heavy_hitters(windows: DataFrame, threshold: int = THRESHOLD_BYTES,
                  predicate: Column | None = None) -> DataFrame:
    """Keep sums strictly above the threshold, or rows meeting a custom predicate."""
    return windows.filter(predicate if predicate is not None else F.col("acc_bytes") > threshold)


def non_empty_window(windows: DataFrame) -> DataFrame:
    """Drop results that carry no packet time."""
    return windows.filter(F.col("ts_us") != 0)


def with_sink(results: DataFrame, n_sinks: int) -> DataFrame:
    """Assign each flow to one of `n_sinks` result groups."""
    return results.withColumn("sink_id", F.pmod(F.col("flow_id"), F.lit(n_sinks)).cast("int"))
