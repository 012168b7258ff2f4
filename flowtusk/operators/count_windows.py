"""Bytes of the last `n` packets of a flow, one result per packet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtusk.functions.keys import FlowKey, flow_key
from flowtusk.plans.ordering import with_global_position
from flowtusk.plans.storage import store

MAX_FLOW_ROWS = 5_000_000   # above this a flow is split over tasks
CHUNK_ROWS = 1_000_000
BROADCAST_FLOWS = 1_000_000  # hot flow ids of 8 bytes each; enough for 5e12 packets

_ORDER = ("ts_us", "pkt_id")


def _columns(order: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(["flow_id", "pkt_id", "dst_ip", "acc_bytes", "ts_us", *order]))


def _last_n(rows: DataFrame, window, n: int) -> DataFrame:
    """`acc_bytes` over the last `n` rows of a window: the running total now less that of `n` rows ago.

    A frame of `n` rows would be summed again for every row; this costs the same for any `n`.
    """
    so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.withColumn("__total", F.sum("pkt_len").over(so_far))
    before = F.coalesce(F.lag("__total", n).over(window), F.lit(0))
    return totals.withColumn("acc_bytes", F.col("__total") - before).drop("__total")


def _by_flow(tagged: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return _last_n(tagged, Window.partitionBy("flow_id").orderBy(*order), n).select(*_columns(order))


def _by_chunk(tagged: DataFrame, n: int, order: Sequence[str], chunk_rows: int) -> DataFrame:
    """Equal chunks of the rows in (flow, time) order; the last n-1 rows of each chunk are
    also given to the next one, where they only complete the frames of its first rows."""
    size = max(chunk_rows, n)
    needed = dict.fromkeys(["flow_id", *order, "pkt_id", "dst_ip", "pkt_len", "ts_us"])
    placed = with_global_position(tagged.select(*needed), ["flow_id", *order])
    chunks = placed.withColumn("home", F.expr(f"position div {size}")).withColumn("chunk", F.explode(
        F.when(F.pmod(F.col("position"), F.lit(size)) >= size - (n - 1), F.array("home", F.col("home") + 1))
        .otherwise(F.array("home"))))
    window = Window.partitionBy("chunk", "flow_id").orderBy("position")
    return _last_n(chunks, window, n).filter(F.col("chunk") == F.col("home")).select(*_columns(order))


def flow_sizes(packets: DataFrame, key: str | FlowKey = "poly17") -> DataFrame:
    """Packets per flow, counted by the key's columns first so that the key is computed rarely."""
    spec = flow_key(key)
    pairs = packets.groupBy(*spec.inputs).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy(spec.column().alias("flow_id")).agg(F.sum("n").alias("packets"))


def count_window_bytes(tagged: DataFrame, n: int, strategy: str = "auto", max_flow_rows: int = MAX_FLOW_ROWS,
                       chunk_rows: int = CHUNK_ROWS, order: Sequence[str] = _ORDER,
                       sizes: DataFrame | None = None) -> DataFrame:
    """For each tagged packet, the bytes of its flow's last `n` packets including itself.

    `by_flow` is one window per flow. `by_chunk` splits all flows evenly whatever their size,
    through a stored, globally ordered table. `auto` counts packets per flow first and sends
    only the flows above `max_flow_rows` the second way; `sizes` passes counts already at hand.
    """
    if n < 1:
        raise ValueError("n must be positive")
    if strategy == "by_flow":
        return _by_flow(tagged, n, order)
    if strategy == "by_chunk":
        return _by_chunk(tagged, n, order, chunk_rows)
    if strategy != "auto":
        raise ValueError("strategy must be 'auto', 'by_flow' or 'by_chunk'")
    if sizes is None:
        sizes = tagged.groupBy("flow_id").agg(F.count(F.lit(1)).alias("packets"))
    hot = sizes.filter(F.col("packets") > max_flow_rows).select("flow_id")
    found = hot.count()
    if not found:
        return _by_flow(tagged, n, order)
    hot = store(hot, "hot")
    side = F.broadcast(hot) if found <= BROADCAST_FLOWS else hot
    cold = _by_flow(tagged.join(side, "flow_id", "left_anti"), n, order)
    # Stored once, as finding the bounds of a range partitioning reads its input twice.
    large = store(tagged.join(side, "flow_id", "left_semi"), "large-flows")
    return cold.unionByName(_by_chunk(large, n, order, chunk_rows))
