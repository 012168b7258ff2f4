"""The whole analysis, from packets to detected windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from flowtusk.functions.keys import FlowKey
from flowtusk.operators.count_windows import count_window_bytes, flow_sizes
from flowtusk.operators.packets import heavy_hitters, tag_flow
from flowtusk.operators.windows import sliding_bytes
from flowtusk.schema import SLIDE_US, THRESHOLD_BYTES, WINDOW_US
from flowtusk.streaming.clock import stamp_arrivals, stream_arrivals
from flowtusk.streaming.counts import count_window_batches
from flowtusk.streaming.outputs import write_result_sets
from flowtusk.streaming.windows import stream_pane_bytes


@dataclass(frozen=True)
class DetectionPlan:
    """Parameters of the analysis.

    `window="time"` sums over `length_us` every `slide_us`; `window="count"` sums the last
    `count` packets of a flow for every packet. `predicate` replaces the test against `threshold`.
    `clock="ingress"` forms windows in arrival time instead of packet time; it is for `run_stream`.
    """
    key: str | FlowKey = "poly17"
    window: str = "time"
    carry: str = "first"
    length_us: int = WINDOW_US
    slide_us: int = SLIDE_US
    count: int = 2000
    threshold: int = THRESHOLD_BYTES
    predicate: Column | None = None
    pkt_id_bound: int | None = None
    clock: str = "event"

    def sums(self, packets: DataFrame) -> DataFrame:
        if self.window == "time":
            return sliding_bytes(packets, self.length_us, self.slide_us, self.key, self.carry,
                                 pkt_id_bound=self.pkt_id_bound)
        if self.window == "count":
            return count_window_bytes(tag_flow(packets, self.key), self.count, sizes=flow_sizes(packets, self.key))
        raise ValueError("window must be 'time' or 'count'")

    def detect(self, packets: DataFrame) -> DataFrame:
        return heavy_hitters(self.sums(packets), self.threshold, self.predicate)

    def sums_stream(self, packets: DataFrame, delay: str = "1 second") -> DataFrame:
        """The sums over a stream of time windows; append mode. `delay` is the watermark's."""
        if self.window != "time":
            raise ValueError("count windows split large flows in each micro-batch: use run_stream")
        return stream_pane_bytes(packets, delay, None, self.length_us, self.slide_us, self.key, self.carry)

    def detect_stream(self, packets: DataFrame, delay: str = "1 second") -> DataFrame:
        return heavy_hitters(self.sums_stream(packets, delay), self.threshold, self.predicate)

    def run_stream(self, packets: DataFrame, folder: str, delay: str = "1 second", trigger: dict | None = None) -> StreamingQuery:
        """Start the analysis of a stream; `stream_hits` reads what it has found.

        Count windows go through the batch operator per micro-batch, which splits large flows over tasks and
        carries the last `count` - 1 packets of a flow. In arrival time, a first query makes the
        stamps durable; with a trigger that ends by itself it is run to its end before the windows.
        """
        if self.clock not in ("event", "ingress"):
            raise ValueError("clock must be 'event' or 'ingress'")
        if self.clock == "ingress":
            stamping = stamp_arrivals(packets, folder, trigger)
            if trigger is None or "availableNow" in trigger or "once" in trigger:
                stamping.awaitTermination()
            else:
                stamping.processAllAvailable()
            packets = stream_arrivals(packets.sparkSession, folder)
        if self.window == "count":
            return count_window_batches(tag_flow(packets, self.key), self.count, folder, trigger)
        return write_result_sets(self.detect_stream(packets, delay), folder, trigger)

    def stream_hits(self, spark: SparkSession, folder: str) -> DataFrame:
        """What a stream started by `run_stream` has found so far."""
        found = spark.read.parquet(f"{folder}/results").drop("batch_id")
        return heavy_hitters(found, self.threshold, self.predicate)


def detect_heavy_flows(packets: DataFrame, **parameters) -> DataFrame:
    """Flow windows whose bytes exceed the threshold; see `DetectionPlan` for parameters."""
    return DetectionPlan(**parameters).detect(packets)
