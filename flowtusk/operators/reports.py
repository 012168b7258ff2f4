"""What the detected windows say: peaks per flow, hit hosts, report lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _first_pair(df: DataFrame, by: list[str], seen: str, peak: str) -> DataFrame:
    """Maximum of `peak` and the addresses of the earliest `seen` per group.

    Grouping by the addresses first keeps the large aggregation on numbers only.
    """
    pairs = df.groupBy(*by, "src_ip", "dst_ip").agg(
        F.max(peak).alias("peak_bytes"), F.min(seen).alias("first_seen_us"))
    pair = F.struct("src_ip", "dst_ip")
    return (pairs.groupBy(*by)
            .agg(F.min_by(pair, F.struct("first_seen_us", "src_ip", "dst_ip")).alias("pair"),
                 F.max("peak_bytes").alias("peak_bytes"), F.min("first_seen_us").alias("first_seen_us"))
            .select(*by, "pair.src_ip", "pair.dst_ip", "peak_bytes", "first_seen_us"))


def flow_peaks(hits: DataFrame) -> DataFrame:
    """Per flow: addresses of its first detected window and its largest window sum."""
    return _first_pair(hits, ["flow_id"], "window_end_us", "acc_bytes")


def sink_peaks(hits: DataFrame) -> DataFrame:
    """The same per result group (`sink_id`)."""
    return _first_pair(hits, ["sink_id", "flow_id"], "window_end_us", "acc_bytes")


def merge_sink_peaks(peaks: DataFrame) -> DataFrame:
    """Union of the groups' peaks: one row per flow, with the largest peak."""
    return _first_pair(peaks, ["flow_id"], "first_seen_us", "peak_bytes")


def heavy_hitter_hosts(hits: DataFrame) -> DataFrame:
    """Distinct destination hosts in lexicographic order."""
    return hits.select("dst_ip").distinct().orderBy("dst_ip")


def heavy_hitter_host_count(hits: DataFrame, approximate: bool = False, rsd: float = 0.02) -> DataFrame:
    """Number of distinct destination hosts; the estimate is opt-in."""
    count = F.approx_count_distinct("dst_ip", rsd) if approximate else F.countDistinct("dst_ip")
    return hits.agg(count.alias("hosts"))


def hits_per_host(hits: DataFrame) -> DataFrame:
    """How often each destination host was detected."""
    return hits.groupBy("dst_ip").agg(F.count(F.lit(1)).alias("hits"))


def total_hits(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count(F.lit(1)).alias("hits"))


# The wording of the reports.
PEAK_REPORT_TITLE = "[Sink%d-REPORT]"
PEAK_REPORT_LINE = "%s from %s : max peak %d exchanged bytes"
HOST_REPORT_TITLE = ["[Heavy Hitters - GLOBAL REPORT]", "List of destination hosts targeted:"]
LATENCY_REPORT_LINE = ("[Sink%d] latency (ms): %s (mean) %s (min) %s (5th) %s (25th) %s (50th) %s (75th) "
                       "%s (95th) %s (max).")


def peak_report_lines(peaks: DataFrame) -> DataFrame:
    """Text of each group's peak report: `sink_id, line_no, flow_id, line`; the title is line 0."""
    title = peaks.select("sink_id").distinct().select(
        "sink_id", F.lit(0).alias("line_no"), F.lit(None).cast("bigint").alias("flow_id"),
        F.format_string(PEAK_REPORT_TITLE, "sink_id").alias("line"))
    entry = F.format_string(PEAK_REPORT_LINE, "dst_ip", "src_ip", "peak_bytes")
    body = peaks.select("sink_id", F.lit(1).alias("line_no"), "flow_id", entry.alias("line"))
    return title.unionByName(body)


def host_report_lines(hits: DataFrame) -> DataFrame:
    """Text of the host report: `line_no, line`; titles are lines 0 and 1, hosts share line 2."""
    spark = hits.sparkSession
    titles = spark.createDataFrame(list(enumerate(HOST_REPORT_TITLE)), "line_no int, line string")
    hosts = hits.select(F.lit(2).alias("line_no"), F.col("dst_ip").alias("line")).distinct()
    return titles.unionByName(hosts)


@F.pandas_udf(StringType())
def _six_digits(values: pd.Series) -> pd.Series:
    """Six significant digits; only ever applied to one row per result group."""
    return values.map("{:g}".format)


def latency_report_lines(stats: DataFrame) -> DataFrame:
    """One line per group with its latency statistics."""
    columns = ["mean_ms", "min_ms", "p5_ms", "p25_ms", "p50_ms", "p75_ms", "p95_ms", "max_ms"]
    # Rounded first, so that the last bits of a sum or an interpolation cannot tip a digit.
    numbers = [_six_digits(F.round(c, 9)) for c in columns]
    return stats.select("sink_id", F.format_string(LATENCY_REPORT_LINE, "sink_id", *numbers).alias("line"))
