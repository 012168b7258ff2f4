"""Delimited packets and report files. Every writer produces a folder of part files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtusk.functions.addresses import saddr_from_ip
from flowtusk.operators.metrics import detector_counts, latency_stats, mean_of_sink_means, throughput
from flowtusk.operators.reports import (
    heavy_hitter_host_count, host_report_lines, latency_report_lines, peak_report_lines,
)
from flowtusk.schema import PACKET_COLUMNS, THRESHOLD_BYTES


def packet_rows(packets: DataFrame, dotted: bool) -> DataFrame:
    """The sixteen columns in file order; addresses as text or as raw address numbers."""
    rows = packets.select(*PACKET_COLUMNS)
    if not dotted:
        rows = rows.withColumns({c: saddr_from_ip(c) for c in ("src_ip", "dst_ip")})
    return rows


def write_packets_csv(packets: DataFrame, path: str, dotted: bool = True, mode: str = "error") -> None:
    """Headerless delimited packets."""
    packet_rows(packets, dotted).write.mode(mode).csv(path)


def write_captures(captures: DataFrame, folder: str) -> None:
    """One file in `folder` for each row (`path`, `content`), under the name `path`. A task that runs again replaces its files."""
    def write(batches) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        files.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                passing = f"{root}/.{uuid.uuid4().hex}"
                with files.open_output_stream(passing) as out:
                    out.write(content)
                files.move(passing, f"{root}/{name}")
            yield batch.select(["path"])

    captures.select("path", "content").mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()


HOUR_US = 3_600_000_000


def write_slides(hits: DataFrame, path: str, text: bool = False, mode: str = "error") -> None:
    """One result set per window end: a folder per slide as text; as Parquet a folder per hour, since
    slides of 100 ms make too many, with `slide` as a sorted column that scans can filter by."""
    # Ranges of slides per task: about as many files as slides, and a crowded slide is split.
    # The number is given, as few rows may still mean many files, which tasks should share.
    tasks = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slides = hits.withColumn("slide", F.col("window_end_us")).repartitionByRange(tasks, "slide", "flow_id")
    if not text:
        hours = slides.withColumn("hour", F.expr(f"slide div {HOUR_US}")).sortWithinPartitions("hour", "slide", "flow_id")
        hours.write.mode(mode).partitionBy("hour").parquet(path)
        return
    line = F.concat_ws(",", "flow_id", "dst_ip", "acc_bytes", "ts_us")
    slides.select(line.alias("value"), "slide").write.mode(mode).partitionBy("slide").text(path)


def write_peak_reports(peaks: DataFrame, path: str, mode: str = "error") -> None:
    """A text report per result group, in `sink_id=` folders, its title first."""
    order = ["sink_id", "line_no", "flow_id"]
    lines = peak_report_lines(peaks).repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("line", "sink_id").write.mode(mode).partitionBy("sink_id").text(path)


def write_host_report(hits: DataFrame, path: str, mode: str = "error") -> None:
    """Titles and hosts, in order over the part files."""
    host_report_lines(hits).orderBy("line_no", "line").select("line").write.mode(mode).text(path)


def write_latency_reports(samples: DataFrame, path: str, mode: str = "error") -> None:
    """One text line of latency statistics per result group, in `sink_id=` folders."""
    lines = latency_report_lines(latency_stats(samples))
    lines.write.mode(mode).partitionBy("sink_id").text(path)


def run_metrics(packets: DataFrame, windows: DataFrame, hits: DataFrame, samples: DataFrame, n_sinks: int,
                threshold: int = THRESHOLD_BYTES, elapsed_s: float | None = None) -> DataFrame:
    """One row: throughput, counts, average latency, distinct hosts and the elapsed time if measured."""
    row = throughput(packets, hits, n_sinks)
    counts = detector_counts(windows, threshold)
    means = mean_of_sink_means(samples)
    return row.select(
        "*",
        counts.select("processed").scalar().alias("processed"),
        counts.select("detected").scalar().alias("detected"),
        means.select("mean_of_means_ms").scalar().alias("average_latency_ms"),
        heavy_hitter_host_count(hits).scalar().alias("hosts"),
        F.lit(elapsed_s).cast("double").alias("elapsed_s"),
    )
