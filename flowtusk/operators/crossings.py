"""The packet at which each flow window first exceeds the threshold.

Lengths are never negative, so a flow's running total never falls: a window that begins after the
packets with total b crosses at the first packet whose total exceeds b + threshold. All windows that begin
between the same two packets share that search. Packets and searches of a block of window starts are sorted
by total once, and each search takes the packet next to it; nothing is expanded to the windows
that packets lie in, and a block holds a bounded stretch of time, however hot the flow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtusk.functions.keys import FlowKey, flow_key
from flowtusk.operators.windows import MIN_WINDOWS_PER_BLOCK, _check, floor_to
from flowtusk.schema import SLIDE_US, THRESHOLD_BYTES, WINDOW_US


def first_crossings(packets: DataFrame, threshold: int = THRESHOLD_BYTES, length_us: int = WINDOW_US, slide_us: int = SLIDE_US,
                    key: str | FlowKey = "poly17", windows_per_block: int | None = None) -> DataFrame:
    """Per (flow, window) whose bytes exceed `threshold`: the first packet, in the order of (ts_us, pkt_id),
    with which they do, and the bytes of the window up to and with it.

    Columns: flow_id, window_start_us, window_end_us, src_ip, dst_ip, pkt_id, ts_us, acc_bytes. NULL
    lengths count as 0. Windows that never exceed the threshold have no row.
    """
    _check(length_us, slide_us)
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    windows_per_block = windows_per_block or max(MIN_WINDOWS_PER_BLOCK, 4 * -(-length_us // slide_us))
    block_us = slide_us * windows_per_block
    ts, slide = F.col("ts_us"), F.lit(slide_us).cast("bigint")
    rows = packets.select(flow_key(key).column().alias("flow_id"), ts.cast("bigint").alias("ts_us"), F.col("pkt_id").cast("bigint").alias("pkt_id"),
                          "src_ip", "dst_ip", F.coalesce(F.col("pkt_len").cast("bigint"), F.lit(0)).alias("bytes"))
    lowest = floor_to(ts - F.lit(length_us), slide_us) + slide
    if slide_us > length_us:  # packets between two windows belong to none
        rows = rows.filter(lowest <= floor_to(ts, slide_us))
    rows = rows.withColumn("block", F.explode(F.sequence(
        floor_to(lowest, block_us), floor_to(floor_to(ts, slide_us), block_us), F.lit(block_us).cast("bigint"))))
    rows = rows.repartition("flow_id", "block")
    along = Window.partitionBy("flow_id", "block").orderBy("ts_us", "pkt_id")
    rows = rows.withColumns({
        "total": F.sum("bytes").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "at": F.row_number().over(along), "before_us": F.lag("ts_us").over(along)})
    # Windows that begin behind the packet before, and not behind this one.
    rows = rows.withColumns({
        "from_us": F.greatest(F.col("block"), F.coalesce(floor_to(F.col("before_us"), slide_us) + slide, F.col("block"))),
        "to_us": F.least(floor_to(ts, slide_us), F.col("block") + F.lit(block_us - slide_us))})
    packet = F.struct("src_ip", "dst_ip", "pkt_id", "ts_us", "total")
    begun = F.col("total") - F.col("bytes")
    search = F.when(F.col("from_us") <= F.col("to_us"), F.struct(
        (begun + F.lit(threshold)).alias("total"), F.lit(True).alias("is_search"), F.col("at"), F.lit(None).cast(
            "struct<src_ip:string,dst_ip:string,pkt_id:bigint,ts_us:bigint,total:bigint>").alias("packet"),
        "from_us", "to_us", begun.alias("begun")))
    own = F.struct(F.col("total"), F.lit(False).alias("is_search"), F.col("at"), packet.alias("packet"), "from_us", "to_us", begun.alias("begun"))
    both = rows.select("flow_id", "block", F.explode(F.array_compact(F.array(own, search))).alias("e")).select("flow_id", "block", "e.*")
    # Downwards by total: of the packets above a search, the lowest and earliest is the last before it.
    downwards = Window.partitionBy("flow_id", "block").orderBy(F.desc("total"), F.desc("is_search"), F.desc("at"))
    found = both.withColumn("crossing", F.last("packet", ignorenulls=True).over(
        downwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = found.filter(F.col("is_search") & F.col("crossing").isNotNull())
    # Of the windows of a search, those that reach the packet.
    reached = F.greatest("from_us", floor_to(F.col("crossing.ts_us") - F.lit(length_us), slide_us) + slide)
    found = found.withColumn("first_us", reached).filter(F.col("first_us") <= F.col("to_us"))
    return found.select(
        "flow_id", F.explode(F.sequence(F.col("first_us"), F.col("to_us"), slide)).alias("window_start_us"), "crossing", "begun",
    ).select("flow_id", "window_start_us", (F.col("window_start_us") + F.lit(length_us)).alias("window_end_us"),
             "crossing.src_ip", "crossing.dst_ip", "crossing.pkt_id", "crossing.ts_us",
             (F.col("crossing.total") - F.col("begun")).alias("acc_bytes"))
