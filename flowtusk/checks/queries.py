"""One query per operator, over whole tables.

Packets are derived from `events`, statistics use `lineitem`, `events` and `embeddings`.
Computed floating-point results are rounded, so that summation order does not show.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowtusk.functions import addresses, headers, keys
from flowtusk.functions.keys import FlowKey
from flowtusk.operators import metrics, reports, statistics
from flowtusk.operators.count_windows import count_window_bytes
from flowtusk.operators.crossings import first_crossings
from flowtusk.operators.packets import (
    heavy_hitters, non_empty_window, reorder, select_emitted, tag_flow, tcp_only, with_sink,
)
from flowtusk.operators.windows import (
    distinct, largest, sliding_bytes, sliding_bytes_last, sliding_bytes_microbatch, sliding_bytes_reduce, sliding_bytes_window,
    smallest, total, tumbling_bytes,
)
from flowtusk.plans.detect import DetectionPlan, detect_heavy_flows
from flowtusk.plans.storage import new_path
from flowtusk.schema import PACKET_COLUMNS, THRESHOLD_BYTES
from flowtusk.sinks import files
from flowtusk.sources.captures import packets_from_captures, read_packets_pcap, to_tuple_dataset
from flowtusk.sources.events import read_event_packets, stream_event_packets
from flowtusk.sources.replay import replay, replay_stream, with_ingress_time
from flowtusk.sources.text import PLACE_BITS, parse_packet_lines, read_packets_csv, rejected_lines, stream_packets_csv, stream_packets_parquet
from flowtusk.streaming import clock, outputs
from flowtusk.streaming import counts as stream_counts
from flowtusk.streaming.totals import RunTotals
from flowtusk.streaming.windows import finish, stream_pane_bytes, stream_sliding_bytes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters shared with the SQL counterparts.
COUNT_WINDOW = 50
LONG_COUNT_WINDOW = 2000
HIGH_THRESHOLD = 4000
SPARSE_HOSTS = 150
SINKS = 4
DELAY_US = 1_000_000
PREVIEW = 100
BATCHES = 4


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _tcp(spark: SparkSession, folder: str, hosts: int = 16) -> DataFrame:
    return tcp_only(read_event_packets(spark, folder, hosts))


def _hits(spark: SparkSession, folder: str, **parameters) -> DataFrame:
    return detect_heavy_flows(_tcp(spark, folder), **parameters)


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: _r(n) for n in names})


# --- sources -----------------------------------------------------------------------------

def _lines(packets: DataFrame) -> DataFrame:
    """Packet lines; every seventh is cut to eleven fields, every fifth lacks its last four."""
    fields = [F.col(c).cast("string") for c in PACKET_COLUMNS]
    whole = F.concat_ws(",", *fields)
    no_tail = F.concat(F.concat_ws(",", *fields[:12]), F.lit(",,,,"))
    short = F.concat(F.concat_ws(",", *fields[:11]), F.lit(",,,,"))
    return packets.select(F.when(F.col("pkt_id") % 7 == 0, short).when(F.col("pkt_id") % 5 == 0, no_tail)
                          .otherwise(whole).alias("value"))


def _line_files(spark: SparkSession, packets: DataFrame) -> DataFrame:
    """The lines written as files and read again."""
    path = new_path(spark, "packet-lines")
    _lines(packets).write.text(path)
    return spark.read.text(path)


def _filled(packets: DataFrame) -> DataFrame:
    """Missing fields as -1."""
    return packets.select(*PACKET_COLUMNS).na.fill(-1)


@query
def s1_read_packets_csv(spark, folder):
    path = new_path(spark, "packet-lines")
    _lines(read_event_packets(spark, folder)).write.text(path)
    return _filled(read_packets_csv(spark, path))


@query
def s1_rejected_lines(spark, folder):
    packets = read_event_packets(spark, folder).withColumn(
        "ts_us", F.when(F.col("pkt_id") % 3 == 0, F.lit("x")).otherwise(F.col("ts_us").cast("string")))
    return rejected_lines(_line_files(spark, packets))


@query
def s1_read_packets_csv_raw_addresses(spark, folder):
    path = new_path(spark, "packet-lines")
    files.write_packets_csv(_tcp(spark, folder), path, dotted=False)
    return _filled(read_packets_csv(spark, path, addresses="raw"))


@query
def s1_rejected_numbers(spark, folder):
    packets = read_event_packets(spark, folder)
    port = F.when(F.col("pkt_id") % 3 == 0, F.lit("port")).otherwise(F.col("dst_port").cast("string"))
    return rejected_lines(_line_files(spark, packets.withColumn("dst_port", port)))


@query
def s2_stream_packets_csv(spark, folder):
    path = new_path(spark, "packet-lines")
    _lines(read_event_packets(spark, folder)).write.text(path)
    out = new_path(spark, "packet-stream")
    outputs.write_windows(stream_packets_csv(spark, path).select(*PACKET_COLUMNS), out).awaitTermination()
    return _filled(spark.read.parquet(f"{out}/windows"))


def _hex(c: Column | str, digits: int) -> Column:
    return F.lpad(F.hex(F.col(c) if isinstance(c, str) else c), digits, "0")


def _frames(packets: DataFrame) -> DataFrame:
    """Each packet as the hex text of an Ethernet frame: every fourth tagged, every eleventh not IPv4."""
    ethertype = F.when(F.col("pkt_id") % 11 == 0, F.lit("86DD")).otherwise(F.lit("0800"))
    tag = F.when(F.col("pkt_id") % 4 == 0, F.lit("81000064")).otherwise(F.lit(""))
    ip = F.concat(F.lit("4500"), _hex("ip_len", 4), F.lit("0000000040"), _hex("protocol", 2), F.lit("0000"),
                  _hex(addresses.ip_to_long("src_ip"), 8), _hex(addresses.ip_to_long("dst_ip"), 8))
    flags = F.when(F.col("pkt_id") % 2 == 0, F.lit("5010")).otherwise(F.lit("5002"))
    tcp = F.concat(_hex("src_port", 4), _hex("dst_port", 4), _hex("seq", 8), _hex(F.col("seq") + 7, 8),
                   flags, _hex("win", 4), F.lit("00000000"))
    return packets.withColumn("frame_hex", F.concat(F.lit("00" * 12), tag, ethertype, ip, tcp, F.lit("AB" * 40)))


def _little(c: Column) -> Column:
    text = _hex(c, 8)
    return F.concat(*[F.substring(text, at, 2) for at in (7, 5, 3, 1)])


def _captures(packets: DataFrame) -> DataFrame:
    """Capture files of 2048 packets each: little-endian microseconds and big-endian nanoseconds in turn."""
    little = F.col("file") % 2 == 0
    size = F.expr("cast(length(frame_hex) div 2 as bigint)")
    sec, usec = F.expr("ts_us div 1000000"), F.expr("ts_us % 1000000")
    record = F.when(little, F.concat(_little(sec), _little(usec), _little(size), _little(size))).otherwise(
        F.concat(_hex(sec, 8), _hex(usec * 1000, 8), _hex(size, 8), _hex(size, 8)))
    head = F.when(little, F.lit("D4C3B2A1" + "02000400" + "00" * 12 + "01000000")).otherwise(
        F.lit("A1B23C4D" + "00020004" + "00" * 12 + "00000001"))
    rows = _frames(packets).withColumn("file", F.expr("pkt_id div 2048"))
    rows = rows.select("file", "pkt_id", F.concat(record, "frame_hex").alias("rec"))
    files_ = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pkt_id", "rec"))).alias("recs"))
    body = F.array_join(F.transform("recs", lambda x: x["rec"]), "")
    return files_.select(F.format_string("capture-%08d.pcap", "file").alias("path"),
                         F.unhex(F.concat(head, body)).alias("content"))


@query
def s3_read_packets_pcap(spark, folder):
    path = new_path(spark, "captures")
    files.write_captures(_captures(read_event_packets(spark, folder)), path)
    return read_packets_pcap(spark, path, range_bytes=16_384).select(*PACKET_COLUMNS)


@query
def s3_packets_from_captures(spark, folder):
    return packets_from_captures(_captures(read_event_packets(spark, folder))).select(*PACKET_COLUMNS)


@query
def s4_to_tuple_dataset(spark, folder):
    return to_tuple_dataset(_tcp(spark, folder), PREVIEW).select("pkt_id", "ts_us", "src_ip", "dst_ip", "pkt_len")


@query
def s4_to_tuple_dataset_all(spark, folder):
    return to_tuple_dataset(_tcp(spark, folder)).select("pkt_id", "ts_us", "src_ip", "dst_ip", "pkt_len")


@query
def s5_replay(spark, folder):
    return replay(_tcp(spark, folder), 3, 2).select("pkt_id", "gen", "replica", "ts_us", "pkt_len")


@query
def s5_replay_stream(spark, folder):
    packets, out = _tcp(spark, folder), new_path(spark, "replay")
    count = packets.count()
    turns = replay_stream(packets, rows_per_batch=count * 2 // 3 + 1, generations=3)
    query_ = outputs.write_windows(turns.select("pkt_id", "gen", "ts_us", "pkt_len"), out, trigger={"processingTime": "0 seconds"})
    while sum(progress["numInputRows"] for progress in query_.recentProgress) < 3 * count and query_.isActive:
        time.sleep(0.2)
    query_.stop()
    return spark.read.parquet(f"{out}/windows")


@query
def s2_stream_ids(spark, folder):
    """Ids of streamed lines that are all alike but for the protocol: distinct, and growing with the line."""
    path, out = new_path(spark, "packet-lines"), new_path(spark, "packet-stream")
    line = F.concat(F.lit("7,10.0.0.1,10.0.0.2,"), F.col("protocol"), F.lit(",60,1,2,3,4,5,6,7,8,9,10,0"))
    lines = read_event_packets(spark, folder).select(line.alias("value"), F.col("protocol"), F.pmod(F.xxhash64("pkt_id"), F.lit(3)).alias("file"))
    lines.repartition(3, "file").sortWithinPartitions("protocol").select("value").write.text(path)
    outputs.write_windows(stream_packets_csv(spark, path).select("pkt_id", "protocol"), out).awaitTermination()
    found = spark.read.parquet(f"{out}/windows").groupBy(F.shiftright("pkt_id", PLACE_BITS).alias("file"), "protocol").agg(
        F.count("*").alias("lines"), F.count_distinct("pkt_id").alias("ids"), F.min("pkt_id").alias("low"), F.max("pkt_id").alias("high"))
    # Files are in the order of protocols, so the ids of one lie above those of the one before. Where a file is read in
    # several splits its numbers have gaps, but no line's is below its place or ahead of its byte: 49 a line at most.
    along = Window.partitionBy("file").orderBy("protocol")
    number, upto = F.col("high").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)), F.sum("lines").over(along)
    found = found.withColumn("in_order", number.between(upto - 1, upto * 49)
                             & (F.col("low") > F.coalesce(F.lag("high").over(along), F.lit(-1))))
    return found.groupBy("protocol").agg(F.sum("lines").alias("lines"), F.sum("ids").alias("ids"), F.bool_and("in_order").alias("in_order"))


@query
def s6_with_ingress_time(spark, folder):
    stamped = with_ingress_time(read_event_packets(spark, folder))
    return stamped.select("pkt_id", (F.col("ingress_us") > F.col("ts_us")).alias("stamped"))


@query
def s6_ingress_windows(spark, folder):
    """Windows in arrival time: which packets meet depends on the run, what each flow sums up to does not."""
    out = new_path(spark, "ingress")
    plan = DetectionPlan(clock="ingress", length_us=1_000_000, slide_us=1_000_000, threshold=0)
    plan.run_stream(_tcp_batches(spark, folder), out).awaitTermination()
    stamped = clock.arrivals(spark, out)
    found = plan.stream_hits(spark, out).drop("packets").withColumn("part", F.lit("emitted"))
    whole = tumbling_bytes(stamped, plan.length_us)
    # Emitted windows are those of the stored stamps; the newest are still open.
    same = found.drop("part").join(whole, ["flow_id", "window_start_us", "window_end_us", "acc_bytes"], "left_anti")
    sums = whole.groupBy("flow_id").agg(F.sum("acc_bytes").alias("bytes"))
    return sums.withColumn("windows_that_differ", same.agg(F.count("*").alias("n")).scalar())


@query
def events_as_packets(spark, folder):
    return read_event_packets(spark, folder).select("pkt_id", *PACKET_COLUMNS)


# --- projections and scalar functions -------------------------------------------------------

@query
def p1_reorder(spark, folder):
    return reorder(read_event_packets(spark, folder))


@query
def p2_select_emitted(spark, folder):
    return select_emitted(read_event_packets(spark, folder))


def _key_query(name: str, column: Callable[[], Column]) -> None:
    def run(spark, folder):
        return read_event_packets(spark, folder, SPARSE_HOSTS).select("pkt_id", column().alias("flow_id"))
    QUERIES[name] = run


_key_query("p3_flow_id_poly17", lambda: keys.flow_id_poly17("src_ip", "dst_ip"))
_key_query("p4_flow_id_objects31", lambda: keys.flow_id_objects31("src_ip", "dst_ip"))
_key_query("p5_flow_id_xor", lambda: keys.flow_id_xor("src_ip", "dst_ip"))
_key_query("p6_flow_id_5tuple_xor",
           lambda: keys.flow_id_5tuple_xor("src_ip", "dst_ip", "src_port", "dst_port", "protocol"))
_key_query("p3_flow_id_pair", lambda: keys.flow_id_pair("src_ip", "dst_ip"))


@query
def p7_tag_flow(spark, folder):
    return tag_flow(_tcp(spark, folder))


@query
def p8_wire_len(spark, folder):
    packets = read_event_packets(spark, folder).withColumn("long_len", F.col("ip_len") + 65000)
    return packets.select("pkt_id", headers.wire_len("ip_len").alias("wire"),
                          headers.wire_len("long_len", wrap16=True).alias("wrapped"))


@query
def p9_payload_lengths(spark, folder):
    packets = read_event_packets(spark, folder).drop("ip_payload_len", "tr_payload_len")
    return headers.payload_lengths(packets).select("pkt_id", "ip_payload_len", "tr_payload_len")


@query
def p10_ip_to_string(spark, folder):
    number = F.pmod(F.col("event_id") * 2654435761 + F.col("user_id"), F.lit(4294967296))
    return spark.read.parquet(f"{folder}/events.parquet").select(
        "event_id", addresses.ip_to_string(number).alias("ip"), addresses.ip_from_saddr(number).alias("raw_ip"))


@query
def p11_ip_to_long(spark, folder):
    return read_event_packets(spark, folder).select(
        "pkt_id", addresses.ip_to_long("src_ip").alias("src"), addresses.ip_to_long("dst_ip").alias("dst"),
        addresses.saddr_from_ip("src_ip").alias("src_raw"))


@query
def p12_ts_from_pcap(spark, folder):
    packets = read_event_packets(spark, folder)
    return packets.select("pkt_id", headers.ts_from_pcap(F.expr("ts_us div 1000000"), F.expr("ts_us % 1000000"))
                          .alias("ts_us"))


@query
def p13_tcp_fields(spark, folder):
    frames = _frames(_tcp(spark, folder)).withColumn("frame", F.unhex("frame_hex"))
    tcp_at = F.when(headers.be_uint(F.col("frame"), 12, 2) == headers.ETHERTYPE_VLAN, 38).otherwise(34)
    return frames.select("pkt_id", *[c.alias(n) for n, c in headers.tcp_fields("frame", tcp_at).items()])


# --- filters ----------------------------------------------------------------------------------

@query
def f1_valid_row(spark, folder):
    parsed = parse_packet_lines(_lines(read_event_packets(spark, folder)))
    return parsed.agg(F.count(F.lit(1)).alias("valid"), F.sum("pkt_len").alias("bytes"))


@query
def f2_tcp_only(spark, folder):
    return _tcp(spark, folder).select("pkt_id", "protocol")


@query
def f3_heavy_hitters(spark, folder):
    return heavy_hitters(sliding_bytes_window(_tcp(spark, folder)))


@query
def f3_heavy_hitters_high(spark, folder):
    return heavy_hitters(sliding_bytes_window(_tcp(spark, folder)), HIGH_THRESHOLD)


@query
def f4_non_empty_window(spark, folder):
    windows = sliding_bytes_reduce(_tcp(spark, folder))
    flagged = windows.withColumn("ts_us", F.when(F.col("acc_bytes") % 3 == 0, F.lit(0)).otherwise(F.col("ts_us")))
    return non_empty_window(flagged)


@query
def f5_latency_sample(spark, folder):
    return metrics.latency_sample(sliding_bytes_last(_tcp(spark, folder)), SINKS, every=16)


@query
def f5_latency_sample_capped(spark, folder):
    return metrics.latency_sample(sliding_bytes_last(_tcp(spark, folder)), SINKS, every=16, cap=200)


# --- windows ----------------------------------------------------------------------------------

@query
def a1_sliding_bytes_reduce(spark, folder):
    return sliding_bytes_reduce(_tcp(spark, folder))


@query
def a1_sliding_bytes_sparse(spark, folder):
    return sliding_bytes_reduce(_tcp(spark, folder, SPARSE_HOSTS), pkt_id_bound=1 << 40)


@query
def a1_sliding_bytes_uneven(spark, folder):
    return sliding_bytes_reduce(_tcp(spark, folder), 2_000_000, 300_000)


@query
def a1_sliding_bytes_direct(spark, folder):
    return sliding_bytes_reduce(_tcp(spark, folder), plan="direct")


@query
def a2_sliding_bytes_window(spark, folder):
    return sliding_bytes_window(_tcp(spark, folder))


@query
def a3_sliding_bytes_microbatch(spark, folder):
    return sliding_bytes_microbatch(_tcp(spark, folder))


@query
def a4_sliding_bytes_last(spark, folder):
    return sliding_bytes_last(_tcp(spark, folder), key="xor")


@query
def a4_sliding_bytes_five_tuple(spark, folder):
    return sliding_bytes_last(_tcp(spark, folder), key="five_tuple_xor")


def _to_host(dst: Column | str) -> Column:
    return addresses.ip_to_long(dst)


@query
def a1_sliding_bytes_destination(spark, folder):
    key = FlowKey(("dst_ip",), _to_host)
    return sliding_bytes(_tcp(spark, folder, SPARSE_HOSTS), key=key).select(
        "flow_id", "window_start_us", "src_ip", "dst_ip", "acc_bytes", "ts_us", "packets")


@query
def a1_sliding_bytes_pair(spark, folder):
    return sliding_bytes_reduce(_tcp(spark, folder), key="pair")


@query
def a5_count_window_bytes(spark, folder):
    return count_window_bytes(tag_flow(_tcp(spark, folder)), COUNT_WINDOW)


@query
def a5_count_window_bytes_split(spark, folder):
    return count_window_bytes(tag_flow(_tcp(spark, folder)), COUNT_WINDOW, max_flow_rows=115, chunk_rows=200)


@query
def a5_count_window_bytes_long(spark, folder):
    return count_window_bytes(tag_flow(_tcp(spark, folder)), LONG_COUNT_WINDOW)


@query
def a5_count_window_bytes_long_split(spark, folder):
    return count_window_bytes(tag_flow(_tcp(spark, folder)), LONG_COUNT_WINDOW, max_flow_rows=0, chunk_rows=3000)


@query
def a6_tumbling_bytes(spark, folder):
    return tumbling_bytes(_tcp(spark, folder))


# --- results ----------------------------------------------------------------------------------

def _spread(hits: DataFrame) -> DataFrame:
    """Assign windows, not flows, to sinks, so that a flow is seen by several."""
    return hits.withColumn("sink_id", F.expr(f"cast((window_start_us div 100000) % {SINKS} as int)"))


@query
def a7_flow_peaks(spark, folder):
    return reports.flow_peaks(_hits(spark, folder, key="xor", carry="last"))


@query
def a8_merge_sink_peaks(spark, folder):
    return reports.merge_sink_peaks(reports.sink_peaks(_spread(_hits(spark, folder))))


@query
def a9_heavy_hitter_hosts(spark, folder):
    return reports.heavy_hitter_hosts(_hits(spark, folder, threshold=HIGH_THRESHOLD))


@query
def a10_heavy_hitter_host_count(spark, folder):
    return reports.heavy_hitter_host_count(_hits(spark, folder))


@query
def a11_hits_per_host(spark, folder):
    return reports.hits_per_host(_hits(spark, folder))


@query
def a11_total_hits(spark, folder):
    return reports.total_hits(_hits(spark, folder))


_STATS = ["mean_ms", "min_ms", "p5_ms", "p25_ms", "p50_ms", "p75_ms", "p95_ms", "max_ms"]


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.latency_sample(heavy_hitters(sliding_bytes_last(_tcp(spark, folder))), SINKS)


@query
def a12_latency_stats(spark, folder):
    return _rounded(metrics.latency_stats(_samples(spark, folder)), *_STATS)


@query
def a13_mean_of_sink_means(spark, folder):
    return _rounded(metrics.mean_of_sink_means(_samples(spark, folder)), "mean_of_means_ms", "weighted_mean_ms")


_TPS = ["overall_tps", "source_tps", "sink_tps"]


@query
def a14_throughput(spark, folder):
    return _rounded(metrics.throughput(_tcp(spark, folder), _hits(spark, folder), SINKS), *_TPS)


@query
def a15_detector_counts(spark, folder):
    return metrics.detector_counts(sliding_bytes_window(_tcp(spark, folder)))


@query
def a16_generation_counts(spark, folder):
    return metrics.generation_counts(replay(_tcp(spark, folder), 4))


# --- statistics -------------------------------------------------------------------------------

_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/lineitem.parquet")


@query
def d1_sample_mean(spark, folder):
    return _rounded(statistics.sample_mean(_items(spark, folder), "l_quantity", ["l_returnflag"]), "mean")


@query
def d2_sample_percentile(spark, folder):
    found = statistics.sample_percentile(_items(spark, folder), "l_extendedprice", [0.0, 0.05, 0.25, 0.75, 0.95, 1.0])
    return _rounded(found, *[f"p{i}" for i in range(6)])


@query
def d2_sample_percentile_grouped(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    found = statistics.sample_percentile(events, "value", [0.1, 0.5, 0.9], ["event_type"])
    return _rounded(found, "p0", "p1", "p2")


@query
def d3_sample_moments(spark, folder):
    found = statistics.sample_moments(spark.read.parquet(f"{folder}/events.parquet"), "value", ["event_type"])
    return _rounded(found, "mean", "variance", "skewness", "kurtosis")


@query
def d4_sample_variance(spark, folder):
    return _rounded(statistics.sample_variance(_items(spark, folder), "l_quantity"), "variance")


@query
def d5_sample_skewness(spark, folder):
    return _rounded(statistics.sample_skewness(_items(spark, folder), "l_extendedprice"), "skewness")


@query
def d5_sample_kurtosis(spark, folder):
    return _rounded(statistics.sample_kurtosis(_items(spark, folder), "l_extendedprice"), "kurtosis")


@query
def d6_sample_adev(spark, folder):
    return _rounded(statistics.sample_adev(_items(spark, folder), "l_quantity"), "adev")


@query
def d6_sample_adev_grouped(spark, folder):
    return _rounded(statistics.sample_adev(_items(spark, folder), "l_quantity", ["l_returnflag"]), "adev")


@query
def d7_sample_median(spark, folder):
    return _rounded(statistics.sample_median(_items(spark, folder), "l_extendedprice", ["l_linestatus"]), "median")


@query
def d8_cov2(spark, folder):
    return _rounded(statistics.cov2(_items(spark, folder), "l_quantity", "l_extendedprice"), "cov")


@query
def d8_pearson_corr2(spark, folder):
    return _rounded(statistics.pearson_corr2(_items(spark, folder), "l_quantity", "l_extendedprice"), "corr")


@query
def d9_spearman_corr2(spark, folder):
    return _rounded(statistics.spearman_corr2(_items(spark, folder), "l_quantity", "l_extendedprice"), "corr")


@query
def d10_cov_matrix(spark, folder):
    return _rounded(statistics.cov_matrix(_items(spark, folder), _NUMBERS), "v")


@query
def d10_pearson_matrix(spark, folder):
    return _rounded(statistics.pearson_matrix(_items(spark, folder), _NUMBERS), "v")


@query
def d10_spearman_matrix(spark, folder):
    return _rounded(statistics.spearman_matrix(_items(spark, folder), _NUMBERS), "v")


@query
def d10_cov_cross_matrix(spark, folder):
    return _rounded(statistics.cov_matrix(_items(spark, folder), _NUMBERS[:1], _NUMBERS[1:]), "v")


@query
def d10_pearson_cross_matrix(spark, folder):
    return _rounded(statistics.pearson_matrix(_items(spark, folder), _NUMBERS[:1], _NUMBERS[1:]), "v")


@query
def d10_spearman_cross_matrix(spark, folder):
    return _rounded(statistics.spearman_matrix(_items(spark, folder), _NUMBERS[:1], _NUMBERS[1:]), "v")


_FEATURES = ["l_quantity", "l_linenumber", "l_suppkey", "l_partkey"]


def _feature_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _items(spark, folder).select("l_orderkey", F.col("l_linenumber").alias("line"), *_FEATURES)


@query
def d11_rank_data(spark, folder):
    return statistics.rank_data(_feature_rows(spark, folder), _FEATURES)


@query
def d11_rank_data_centered(spark, folder):
    return statistics.rank_data(_feature_rows(spark, folder), _FEATURES, centered=True)


@query
def d11_rank_array(spark, folder):
    ranked = statistics.rank_array(spark.read.parquet(f"{folder}/embeddings.parquet"), "embedding")
    return ranked.select("vec_id", F.posexplode("embedding").alias("feature", "rank"))


# --- streaming --------------------------------------------------------------------------------

def _tcp_stream(spark: SparkSession, folder: str) -> DataFrame:
    return tcp_only(stream_event_packets(spark, folder))


#: Rows of a file of packets, and how many files a micro-batch has at most.
FILE_ROWS, BATCH_FILES = 50_000, 64


def _tcp_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The TCP packets as a stream of several micro-batches, in the order of time, equally many files each: one, or more
    where all of them have the rows for it."""
    path, packets = new_path(spark, "packet-files"), _tcp(spark, folder)
    low, high = packets.agg(F.min("ts_us"), F.max("ts_us")).first()
    part = F.least(F.expr(f"(ts_us - {low}) * {BATCHES} div {high - low + 1}"), F.lit(BATCHES - 1))
    least = min(packets.agg(*[F.count_if(part == k) for k in range(BATCHES)]).first())
    files_ = max(1, min(least // FILE_ROWS, BATCH_FILES))
    for k in range(BATCHES):
        # Files are taken in the order of their writing; rows are dealt in turn, so that none is empty.
        rows = packets.filter(part == k)
        rows = rows.coalesce(1) if files_ == 1 else rows.repartition(files_)
        rows.write.mode("append").parquet(path)
    return stream_packets_parquet(spark, path, max_files_per_trigger=files_)


def _written(spark: SparkSession, rows: DataFrame) -> DataFrame:
    out = new_path(spark, "stream")
    outputs.write_windows(rows, out).awaitTermination()
    return spark.read.parquet(f"{out}/windows")


def _whole(spark: SparkSession, folder: str, windows: DataFrame, **options) -> DataFrame:
    """The windows that a stream emits, and those it leaves open."""
    out = new_path(spark, "stream")
    query_ = outputs.write_windows(windows, out)
    open_ = finish(query_, _tcp(spark, folder), **options)
    return spark.read.parquet(f"{out}/windows").unionByName(open_)


@query
def t1_stream_sliding_bytes(spark, folder):
    return _whole(spark, folder, stream_sliding_bytes(_tcp_stream(spark, folder)))


@query
def t2_stream_pane_bytes(spark, folder):
    return _whole(spark, folder, stream_pane_bytes(_tcp_stream(spark, folder), carry="last"), carry="last")


@query
def t6_micro_batches(spark, folder):
    out = new_path(spark, "stream")
    query_ = outputs.write_windows(tag_flow(_tcp_stream(spark, folder)), out, trigger=outputs.EVERY_BATCH)
    query_.processAllAvailable()
    query_.stop()
    return spark.read.parquet(f"{out}/windows").select("pkt_id", "flow_id", "pkt_len")


@query
def t3_alert_early(spark, folder):
    out = new_path(spark, "alerts")
    outputs.alert_early(stream_sliding_bytes(_tcp_batches(spark, folder)), out, DELAY_US).awaitTermination()
    return outputs.alerts(spark, out).select("flow_id", "window_start_us")


@query
def t3_first_crossings(spark, folder):
    return first_crossings(_tcp(spark, folder))


@query
def t3_first_crossings_sparse(spark, folder):
    return first_crossings(_tcp(spark, folder, SPARSE_HOSTS), HIGH_THRESHOLD, 2_000_000, 300_000, "five_tuple_xor")


@query
def t3_alert_crossings(spark, folder):
    out = new_path(spark, "alerts")
    outputs.alert_crossings(_tcp_batches(spark, folder), out, DELAY_US, HIGH_THRESHOLD).awaitTermination()
    return outputs.alerts(spark, out)


@query
def t4_stream_count_window_bytes(spark, folder):
    sums = stream_counts.stream_count_window_bytes(tag_flow(_tcp_batches(spark, folder)), COUNT_WINDOW)
    return _written(spark, sums)


@query
def t4_count_window_batches(spark, folder):
    out = new_path(spark, "counts")
    stream_counts.count_window_batches(tag_flow(_tcp_batches(spark, folder)), COUNT_WINDOW, out).awaitTermination()
    return stream_counts.count_window_results(spark, out)


@query
def t5_keep_flow_peaks(spark, folder):
    out = new_path(spark, "peaks")
    hits = heavy_hitters(stream_sliding_bytes(_tcp_batches(spark, folder)))
    open_ = finish(outputs.keep_flow_peaks(hits, out), _tcp(spark, folder))
    peaks = outputs.current_peaks(spark, out).unionByName(reports.flow_peaks(heavy_hitters(open_)))
    return reports.merge_sink_peaks(peaks)


@query
def t7_result_sets(spark, folder):
    out = new_path(spark, "result-sets")
    hits = heavy_hitters(stream_sliding_bytes(_tcp_batches(spark, folder)))
    open_ = finish(outputs.write_result_sets(hits, out), _tcp(spark, folder))
    return spark.read.parquet(f"{out}/results").drop("batch_id").unionByName(heavy_hitters(open_))


@query
def t8_stream_latency(spark, folder):
    windows = stream_sliding_bytes(_tcp_stream(spark, folder), carry="last")
    whole = _whole(spark, folder, windows, carry="last")
    return metrics.with_latency(whole).select("flow_id", "window_end_us", "latency_ms")


@query
def t8_live_latency_stats(spark, folder):
    """Exact statistics, and whether the percentiles of the merged sketches keep their bound."""
    out, ms = new_path(spark, "latency"), F.col("pkt_len") / 8.0
    tagged = tag_flow(_tcp_batches(spark, folder))
    outputs.write_latency_stats(tagged, out, SINKS, latency=ms).awaitTermination()
    stats = outputs.live_latency_stats(spark, out)
    values = tag_flow(_tcp(spark, folder)).select(F.expr(f"cast(pmod(flow_id, {SINKS}) as int)").alias("sink_id"), ms.alias("ms"))
    joined = values.join(F.broadcast(stats), "sink_id")
    ranks = [(p, F.count_if(F.col("ms") < F.col(f"p{p}_ms")) / F.count("*"), F.count_if(F.col("ms") <= F.col(f"p{p}_ms")) / F.count("*"))
             for p in (5, 25, 50, 75, 95)]
    near = [(below <= p / 100 + outputs.RANK_ERROR) & (upto >= p / 100 - outputs.RANK_ERROR) for p, below, upto in ranks]
    checked = joined.groupBy("sink_id").agg(reduce(and_, near).alias("percentiles_within_bound"))
    return _rounded(stats.select("sink_id", "samples", "mean_ms", "min_ms", "max_ms"), "mean_ms").join(checked, "sink_id")


@query
def k7_live_run_metrics(spark, folder):
    """Totals of a whole run by its listener, and the windows that the stream left open."""
    out = new_path(spark, "run")
    with RunTotals(spark) as run:
        windows = stream_sliding_bytes(_tcp_batches(spark, folder)).observe(
            "windows", F.count("*").alias("processed"), F.count_if(F.col("acc_bytes") > THRESHOLD_BYTES).alias("detected"))
        query_ = outputs.write_result_sets(heavy_hitters(windows), out)
        totals = run.wait(query_).totals(query_)
        open_ = metrics.detector_counts(finish(query_, _tcp(spark, folder)))
    counted = open_.select((F.col("processed") + totals["processed"]).alias("processed"),
                           (F.col("detected") + totals["detected"]).alias("detected"))
    return counted.select("*", F.lit(totals["rows"]).cast("bigint").alias("packets"), F.lit(totals["batches"]).cast("bigint").alias("batches"))


# --- sinks ------------------------------------------------------------------------------------

def _csv_lines(spark: SparkSession, folder: str, dotted: bool) -> DataFrame:
    path = new_path(spark, "packets-csv")
    files.write_packets_csv(_tcp(spark, folder), path, dotted)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query
def k1_packets_csv_numeric(spark, folder):
    return _csv_lines(spark, folder, dotted=False)


@query
def k2_packets_csv_dotted(spark, folder):
    return _csv_lines(spark, folder, dotted=True)


@query
def k3_result_sets_per_slide(spark, folder):
    path = new_path(spark, "slides")
    files.write_slides(_hits(spark, folder), path)
    return spark.read.parquet(path).select("slide", "flow_id", "dst_ip", "acc_bytes", "ts_us")


@query
def k4_peak_reports(spark, folder):
    path = new_path(spark, "peak-reports")
    files.write_peak_reports(reports.sink_peaks(_spread(_hits(spark, folder))), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query
def k5_host_report(spark, folder):
    path = new_path(spark, "host-report")
    files.write_host_report(_hits(spark, folder), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query
def k6_latency_reports(spark, folder):
    path = new_path(spark, "latency-reports")
    files.write_latency_reports(_samples(spark, folder), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query
def k7_run_metrics(spark, folder):
    packets = _tcp(spark, folder)
    windows = sliding_bytes(packets, carry="last")
    hits = heavy_hitters(windows)
    samples = metrics.latency_sample(hits, SINKS)
    row = files.run_metrics(packets, windows, hits, samples, SINKS).drop("elapsed_s")
    return _rounded(row, *_TPS, "average_latency_ms")


# --- further keys and parameters of the whole analysis -----------------------------------------

_EXTRAS = {"largest": largest("pkt_len"), "hosts": distinct("dst_ip")}


@query
def window_extra_aggregates(spark, folder):
    sums = sliding_bytes(_tcp(spark, folder), extras=_EXTRAS)
    return sums.select("flow_id", "window_start_us", "acc_bytes", *_EXTRAS)


@query
def window_extra_aggregates_last(spark, folder):
    """All kinds, the last packet carried, and a key that joins many address pairs."""
    extras = {**_EXTRAS, "smallest": smallest("pkt_len"), "payload": total("ip_payload_len"), "ports": distinct("src_port")}
    sums = sliding_bytes(_tcp(spark, folder, SPARSE_HOSTS), key=FlowKey(("dst_ip",), _to_host), carry="last", extras=extras)
    return sums.select("flow_id", "window_start_us", "src_ip", "acc_bytes", "packets", *extras)


@query
def detect_stream(spark, folder):
    plan, out = DetectionPlan(threshold=HIGH_THRESHOLD), new_path(spark, "stream")
    query_ = outputs.write_windows(plan.detect_stream(_tcp_batches(spark, folder)), out)
    open_ = heavy_hitters(finish(query_, _tcp(spark, folder)), plan.threshold)
    return spark.read.parquet(f"{out}/windows").unionByName(open_)


@query
def detect_stream_count_window(spark, folder):
    plan, out = DetectionPlan(window="count", count=COUNT_WINDOW, threshold=25_000), new_path(spark, "counts")
    plan.run_stream(_tcp_batches(spark, folder), out).awaitTermination()
    return plan.stream_hits(spark, out)


@query
def detect_count_window(spark, folder):
    return detect_heavy_flows(_tcp(spark, folder), window="count", count=COUNT_WINDOW, threshold=25_000)


@query
def detect_objects31_sparse(spark, folder):
    return detect_heavy_flows(_tcp(spark, folder, SPARSE_HOSTS), key="objects31").drop("packets")


@query
def hits_by_sink(spark, folder):
    hits = with_sink(_hits(spark, folder), SINKS)
    return hits.groupBy("sink_id").agg(F.count(F.lit(1)).alias("hits"), F.sum("acc_bytes").alias("bytes"))
