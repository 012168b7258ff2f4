"""Totals of a whole streaming run, added up by a listener."""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener


class RunTotals(StreamingQueryListener):
    """Adds up what every micro-batch of the queries of one session reports.

    Rows read, rows dropped by the watermark, batches, busy time, and each number that a query counts by
    `observe` (its sums, so observe counts and sums only). Use as a context: it is registered on entry
    and removed on exit. A micro-batch that is repeated is counted once.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._lock = spark, threading.Lock()
        self._batches: dict[tuple[str, int], dict] = {}
        self._ended: dict[str, threading.Event] = {}

    def __enter__(self) -> RunTotals:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def _end_of(self, query_id: str) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(query_id, threading.Event())

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        counts = Counter()
        for metrics in (progress.observedMetrics or {}).values():
            counts.update({name: value or 0 for name, value in metrics.asDict().items()})
        found = {
            "rows": progress.numInputRows, "busy_ms": progress.batchDuration or 0,
            "rows_dropped_by_watermark": sum(op.numRowsDroppedByWatermark for op in progress.stateOperators), **counts}
        with self._lock:
            self._batches[str(progress.id), progress.batchId] = found

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._end_of(str(event.id)).set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> RunTotals:
        """Wait until a query has ended and all its reports are in."""
        query.awaitTermination()
        self._end_of(str(query.id)).wait(seconds)
        return self

    def totals(self, query: StreamingQuery | None = None) -> dict[str, int]:
        """The sums so far, of one query or of all."""
        with self._lock:
            held = [found for (query_id, _), found in self._batches.items() if query is None or query_id == str(query.id)]
        out: Counter = Counter({"rows": 0, "busy_ms": 0, "rows_dropped_by_watermark": 0})
        for found in held:
            out.update(found)
        return {"batches": len([f for f in held if f["rows"]]), **out}

    def row(self, query: StreamingQuery | None = None) -> DataFrame:
        """One row of the totals, with rows per second of busy time."""
        totals = self.totals(query)
        totals["rows_per_busy_second"] = totals["rows"] * 1000.0 / totals["busy_ms"] if totals["busy_ms"] else None
        kinds = ", ".join(f"`{name}` {'double' if name == 'rows_per_busy_second' else 'bigint'}" for name in totals)
        return self.spark.createDataFrame([tuple(totals.values())], kinds)
