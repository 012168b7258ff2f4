import pytest
from pyspark.sql import functions as F

from flowtusk.operators import metrics, reports
from flowtusk.operators.packets import with_sink
from flowtusk.operators.windows import sliding_bytes
from flowtusk.plans.ordering import with_global_position, with_running_total
from flowtusk.sinks import files

HIT = "sink_id int, flow_id bigint, src_ip string, dst_ip string, acc_bytes bigint, window_end_us bigint"


@pytest.fixture
def hits(spark):
    return spark.createDataFrame([
        (0, 1, "a", "h2", 100, 10), (1, 1, "b", "h9", 200, 20), (0, 2, "c", "h10", 50, 5), (0, 2, "c", "h10", 40, 6),
    ], HIT)


def test_peaks_merge_to_the_largest(hits):
    merged = {r.flow_id: r for r in reports.merge_sink_peaks(reports.sink_peaks(hits)).collect()}
    direct = {r.flow_id: r for r in reports.flow_peaks(hits).collect()}
    assert merged == direct
    assert (merged[1].peak_bytes, merged[1].src_ip, merged[1].dst_ip) == (200, "a", "h2")
    assert merged[2].peak_bytes == 50


def test_hosts(hits):
    assert [r.dst_ip for r in reports.heavy_hitter_hosts(hits).collect()] == ["h10", "h2", "h9"]
    assert reports.heavy_hitter_host_count(hits).first().hosts == 3
    assert reports.heavy_hitter_host_count(hits, approximate=True).first().hosts == 3
    assert {r.dst_ip: r.hits for r in reports.hits_per_host(hits).collect()} == {"h2": 1, "h9": 1, "h10": 2}
    assert reports.total_hits(hits).first().hits == 4


def test_peaks_bound_windows(packets):
    table = packets(*[(i * 90_000, "10.0.0.1", f"10.0.0.{i % 3 + 2}", 100 + i) for i in range(60)])
    windows = sliding_bytes(table)
    peaks = reports.flow_peaks(windows)
    assert windows.join(peaks, "flow_id").filter("acc_bytes > peak_bytes").count() == 0
    assert windows.select("dst_ip").exceptAll(windows.select("dst_ip")).count() == 0
    assert windows.select("dst_ip").join(table.select("dst_ip").distinct(), "dst_ip", "left_anti").count() == 0


def ordered_lines(path):
    return [line for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines()]


def test_report_files(spark, hits, tmp_path):
    files.write_peak_reports(reports.sink_peaks(hits), str(tmp_path / "peaks"))
    assert ordered_lines(tmp_path / "peaks/sink_id=0") == [
        "[Sink0-REPORT]", "h2 from a : max peak 100 exchanged bytes", "h10 from c : max peak 50 exchanged bytes"]
    assert ordered_lines(tmp_path / "peaks/sink_id=1") == [
        "[Sink1-REPORT]", "h9 from b : max peak 200 exchanged bytes"]
    files.write_host_report(hits, str(tmp_path / "hosts"))
    assert ordered_lines(tmp_path / "hosts") == [
        "[Heavy Hitters - GLOBAL REPORT]", "List of destination hosts targeted:", "h10", "h2", "h9"]


def test_slides_as_text(packets, tmp_path):
    windows = sliding_bytes(packets((5_000_000, "10.0.0.1", "10.0.0.2", 9)))
    files.write_slides(windows, str(tmp_path / "slides"), text=True)
    folders = sorted(p.name for p in (tmp_path / "slides").glob("slide=*"))
    assert len(folders) == 20
    assert ordered_lines(tmp_path / "slides" / folders[0])[0].endswith(",10.0.0.2,9,5000000")


def test_means_of_unequal_sinks(spark):
    samples = spark.createDataFrame([(0, 1.0), (0, 1.0), (0, 1.0), (1, 5.0)], "sink_id int, latency_ms double")
    row = metrics.mean_of_sink_means(samples).first()
    assert (row.mean_of_means_ms, row.weighted_mean_ms, row.active_sinks) == (3.0, 2.0, 2)


def test_latency_lines(spark, tmp_path):
    samples = spark.createDataFrame([(0, float(x)) for x in (0, 1, 2, 3, 1234567)], "sink_id int, latency_ms double")
    stats = metrics.latency_stats(samples).first()
    assert (stats.min_ms, stats.p25_ms, stats.p50_ms, stats.max_ms) == (0.0, 1.0, 2.0, 1234567.0)
    files.write_latency_reports(samples, str(tmp_path / "latency"))
    assert ordered_lines(tmp_path / "latency/sink_id=0") == [
        "[Sink0] latency (ms): 246915 (mean) 0 (min) 0.2 (5th) 1 (25th) 2 (50th) 3 (75th) 987654 (95th) "
        "1.23457e+06 (max)."]
    assert metrics.latency_stats(samples, approximate=True).first().p50_ms == 2.0


@pytest.mark.parametrize("every,cap", [(16, 1_000_000), (3, 4)])
def test_latency_sample_is_every_nth_per_sink(spark, every, cap):
    results = spark.range(500).select(
        (F.col("id") % 7 - 3).alias("flow_id"), (F.col("id") * 1000).alias("window_end_us"),
        (F.col("id") * 10).alias("ts_us"))
    got = {(r.sink_id, r.window_end_us, r.flow_id) for r in metrics.latency_sample(results, 3, every, cap).collect()}
    want = set()
    for sink in range(3):
        rows = sorted((r.window_end_us, r.flow_id) for r in results.collect() if r.flow_id % 3 == sink)
        want |= {(sink, *row) for row in rows[::every][:cap]}
    assert got == want


def test_all_latencies_by_default(spark):
    results = spark.range(50).select(F.col("id").alias("flow_id"), (F.col("id") * 1000).alias("window_end_us"), F.col("id").alias("ts_us"))
    assert metrics.latency_sample(results, 3).count() == 50


def test_throughput(packets):
    table = packets((0, "a", "b", 1), (2_000_000, "a", "b", 1))
    results = table.select((F.col("pkt_id") * 0).alias("flow_id"), (F.col("ts_us") + 2_000_000).alias("window_end_us"))
    row = metrics.throughput(table, results, 2).first()
    assert (row.sent, row.received, row.source_tps, row.overall_tps, row.sink_tps) == (2, 2, 1.0, 0.5, 1.0)
    one = metrics.throughput(table.limit(1), results.limit(0), 2).first()
    assert one.source_tps is None and one.received == 0


def test_run_metrics(packets):
    table = packets(*[(i * 50_000, "10.0.0.1", "10.0.0.2", 100) for i in range(60)])
    windows = sliding_bytes(table, key="pair")
    heavy = windows.filter("acc_bytes > 1500")
    samples = metrics.latency_sample(heavy, 2)
    row = files.run_metrics(table, windows, heavy, samples, 2, elapsed_s=1.5).first()
    assert (row.sent, row.processed, row.detected) == (60, windows.count(), heavy.count())
    assert row.hosts == 1 and row.elapsed_s == 1.5 and row.average_latency_ms > 0


def test_sink_of_negative_flows(spark):
    rows = with_sink(spark.createDataFrame([(-1,), (5,)], "flow_id bigint"), 4).collect()
    assert [r.sink_id for r in rows] == [3, 1]


def test_positions_and_totals_in_a_total_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 5).alias("v"))
    placed = with_global_position(df, ["k"]).collect()
    assert all(r.position == r.k for r in placed) and len(placed) == 1000
    want, total = {}, 0
    for r in sorted(df.collect()):
        want[r.k], total = total, total + r.v
    assert {r.k: r.before for r in with_running_total(df, ["k"], "v").collect()} == want
