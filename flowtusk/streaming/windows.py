"""Event-time window sums over a stream.

In append mode a window is emitted once, when the watermark passes its end. `finish` computes the
windows still open when the input ends.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowtusk.functions.keys import FlowKey, flow_key
from flowtusk.operators.windows import _edge, packet_order, sliding_bytes
from flowtusk.schema import SLIDE_US, WINDOW_US


def with_event_time(packets: DataFrame, delay: str) -> DataFrame:
    """Attach the watermarked event time; rows later than `delay` are dropped by the engine."""
    return packets.withColumn("event_time", F.timestamp_micros(F.col("ts_us"))).withWatermark("event_time", delay)


def _us(n: int) -> str:
    return f"{n} microseconds"


#: Bytes of an address that fit into two numbers, beside its length.
ADDRESS_BYTES = 15


def _packed(address: str, half: int) -> Column:
    """Half of the bytes of a text of up to ADDRESS_BYTES, with its length in front, as a number; NULL stays NULL."""
    digits = F.concat(F.lpad(F.hex(F.octet_length(address)), 2, "0"), F.rpad(F.hex(F.encode(address, "UTF-8")), 2 * ADDRESS_BYTES, "0"))
    number = F.conv(F.substring(digits, 1 + 16 * half, 16), 16, -10).cast("bigint")
    return F.when(F.octet_length(address) <= ADDRESS_BYTES, number).when(F.col(address).isNotNull(), F.raise_error(
        F.lit(f"an address has more than {ADDRESS_BYTES} bytes: pass long_addresses=True")).cast("bigint"))


def _unpacked(halves: list[str]) -> Column:
    digits = F.concat(*[F.lpad(F.hex(half), 16, "0") for half in halves])
    length = F.conv(F.substring(digits, 1, 2), 16, 10).cast("int")
    return F.decode(F.unhex(F.substring(digits, F.lit(3), 2 * length)), "UTF-8")


def stream_sliding_bytes(packets: DataFrame, delay: str = "1 second", length_us: int = WINDOW_US,
                         slide_us: int = SLIDE_US, key: str | FlowKey = "poly17",
                         carry: str = "first", long_addresses: bool = False) -> DataFrame:
    """Bytes per flow and window; columns as in the batch operator.

    A packet counts in every window it lies in. The carried addresses travel as numbers, so that the sums have a
    fixed width and a task hashes packets into them: it holds its flow windows, not its packets. Addresses of more than
    ADDRESS_BYTES bytes (a dotted quad never has) fail the query, unless `long_addresses` carries texts of any
    length, for which a task sorts its packets once per window.
    """
    extreme, at_extreme = _edge(carry)
    timed = with_event_time(packets, delay).withColumn("flow_id", flow_key(key).column())
    if long_addresses:
        pair = [at_extreme(F.struct("src_ip", "dst_ip"), F.struct("ts_us", "pkt_id")).alias("pair")]
        addresses = [F.col("pair.src_ip"), F.col("pair.dst_ip")]
    else:
        halves = {f"{name}_{half}": _packed(name, half) for name in ("src_ip", "dst_ip") for half in (0, 1)}
        timed = timed.withColumns({**halves, "edge": packet_order()})
        pair = [at_extreme(name, "edge").alias(name) for name in halves]
        addresses = [_unpacked([f"{name}_0", f"{name}_1"]).alias(name) for name in ("src_ip", "dst_ip")]
    return (timed.groupBy("flow_id", F.window("event_time", _us(length_us), _us(slide_us)).alias("w"))
            .agg(F.sum("pkt_len").cast("bigint").alias("acc_bytes"), extreme("ts_us").alias("ts_us"), *pair,
                 F.count(F.lit(1)).alias("packets"))
            .select("flow_id", F.unix_micros("w.start").alias("window_start_us"),
                    F.unix_micros("w.end").alias("window_end_us"), *addresses, "acc_bytes", "ts_us", "packets"))


def stream_pane_bytes(packets: DataFrame, delay: str = "1 second", batch_us: int | None = None,
                      length_us: int = WINDOW_US, slide_us: int = SLIDE_US, key: str | FlowKey = "poly17",
                      carry: str = "first") -> DataFrame:
    """Two chained aggregations: panes of `batch_us` first, then windows of panes. Append mode only.

    State holds one row per (flow, pane) and packets are not multiplied by the number of
    windows they lie in. Panes are the common divisor of length and slide unless given.
    """
    extreme, _ = _edge(carry)
    batch_us = batch_us or gcd(length_us, slide_us)
    if length_us % batch_us or slide_us % batch_us:
        raise ValueError("window length and slide must be multiples of the batch interval")
    timed = with_event_time(packets, delay).withColumn("flow_id", flow_key(key).column())
    panes = (timed.groupBy("flow_id", F.window("event_time", _us(batch_us)).alias("pane"))
             .agg(F.sum("pkt_len").cast("bigint").alias("bytes"), F.count(F.lit(1)).alias("packets"),
                  extreme(F.struct("ts_us", "pkt_id", "src_ip", "dst_ip")).alias("edge")))
    return (panes.groupBy("flow_id", F.window("pane", _us(length_us), _us(slide_us)).alias("w"))
            .agg(F.sum("bytes").alias("acc_bytes"), F.sum("packets").alias("packets"), extreme("edge").alias("edge"))
            .select("flow_id", F.unix_micros("w.start").alias("window_start_us"),
                    F.unix_micros("w.end").alias("window_end_us"), "edge.src_ip", "edge.dst_ip",
                    "acc_bytes", "edge.ts_us", "packets"))


def final_watermark_us(query: StreamingQuery) -> int | None:
    """The watermark with which a finished query emitted last; None if it never had one."""
    marks = [p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in (p["eventTime"] or {})]
    if not marks:
        return None
    last = datetime.fromisoformat(marks[-1].replace("Z", "+00:00"))
    return (last - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def finish(query: StreamingQuery, packets: DataFrame, length_us: int = WINDOW_US, slide_us: int = SLIDE_US,
           **options) -> DataFrame:
    """Wait for a query over window sums to end, then compute the windows that it left open.

    `packets` is the stream's input as a table and `options` are those of the windows. Together
    with what the query wrote this gives every window once.
    """
    query.awaitTermination()
    watermark = final_watermark_us(query)
    return closing_windows(packets, 0 if watermark is None else watermark, length_us, slide_us, **options)


def closing_windows(packets: DataFrame, watermark_us: int, length_us: int = WINDOW_US, slide_us: int = SLIDE_US,
                    **options) -> DataFrame:
    """Windows a finished stream left open: those ending after its last watermark.

    Only packets that can lie in such a window are read.
    """
    recent = packets.filter(F.col("ts_us") >= watermark_us - length_us)
    return sliding_bytes(recent, length_us, slide_us, **options).filter(F.col("window_end_us") > watermark_us)
