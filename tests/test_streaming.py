import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from flowtusk.checks import queries
from flowtusk.functions.keys import FlowKey
from flowtusk.operators.count_windows import count_window_bytes
from flowtusk.operators.crossings import first_crossings
from flowtusk.operators.metrics import observe_detector
from flowtusk.operators.packets import heavy_hitters, tag_flow, tcp_only
from flowtusk.operators.reports import flow_peaks
from flowtusk.operators.windows import sliding_bytes
from flowtusk.plans.detect import DetectionPlan
from flowtusk.sources.events import read_event_packets
from flowtusk.sources.replay import replay, replay_stream
from flowtusk.sources.text import stream_packets_csv, stream_packets_parquet
from flowtusk.streaming import clock, outputs
from flowtusk.streaming.counts import count_window_batches, count_window_results, stream_count_window_bytes
from flowtusk.streaming.totals import RunTotals
from flowtusk.streaming.windows import (
    _packed, _unpacked, closing_windows, final_watermark_us, finish, stream_pane_bytes, stream_sliding_bytes,
)

DELAY_US = 1_000_000


def same(left, right):
    return left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


@pytest.fixture(scope="module")
def trace(spark, folder, tmp_path_factory):
    """TCP packets in five files in order of time, one per micro-batch."""
    root = tmp_path_factory.mktemp("trace")
    table = tcp_only(read_event_packets(spark, folder))
    slices = str(root / "slices")
    table.repartitionByRange(5, "ts_us").write.parquet(slices)
    source = root / "in"
    source.mkdir()
    now = time.time() - 1000
    for at, name in enumerate(sorted(n for n in os.listdir(slices) if n.endswith(".parquet"))):
        target = source / f"{at}.parquet"
        shutil.copy(os.path.join(slices, name), target)
        os.utime(target, (now + at, now + at))
    assert at == 4
    return str(source)


@pytest.fixture
def stream(spark, trace):
    return stream_packets_parquet(spark, trace, max_files_per_trigger=1)


@pytest.fixture(scope="module")
def table(spark, trace):
    return spark.read.parquet(trace).cache()


def watermark(table):
    return table.agg(F.max("ts_us")).first()[0] // 1000 * 1000 - DELAY_US


def run(spark, windows, out):
    query = outputs.write_windows(windows, str(out))
    query.awaitTermination()
    return spark.read.parquet(f"{out}/windows"), query


@pytest.mark.parametrize("carry", ["first", "last"])
def test_stream_equals_batch_on_closed_windows(spark, stream, table, tmp_path, carry):
    got, query = run(spark, stream_sliding_bytes(stream, carry=carry), tmp_path)
    want = sliding_bytes(table, carry=carry)
    assert same(got, want.filter(F.col("window_end_us") <= watermark(table)))
    assert same(got.unionByName(closing_windows(table, watermark(table), carry=carry)), want)
    assert final_watermark_us(query) == watermark(table)
    assert same(got.unionByName(finish(query, table, carry=carry)), want)
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 5
    assert outputs.progress_metrics(query)["rows_dropped_by_watermark"] == 0


@pytest.mark.parametrize("carry,slide", [("first", 100_000), ("last", 300_000)])
def test_pane_stream_equals_batch(spark, stream, table, tmp_path, carry, slide):
    got, _ = run(spark, stream_pane_bytes(stream, carry=carry, slide_us=slide), tmp_path)
    want = sliding_bytes(table, carry=carry, slide_us=slide)
    assert same(got, want.filter(F.col("window_end_us") <= watermark(table)))


def test_panes_must_divide_the_window(stream):
    with pytest.raises(ValueError):
        stream_pane_bytes(stream, batch_us=300_000)


def test_whole_analysis_as_a_stream(spark, stream, table, tmp_path):
    plan = DetectionPlan(predicate=F.col("acc_bytes") % 2 == 0)
    got, _ = run(spark, plan.detect_stream(stream), tmp_path / "time")
    assert same(got, plan.detect(table).filter(F.col("window_end_us") <= watermark(table)))
    counted = DetectionPlan(window="count", count=3, threshold=1000)
    counted.run_stream(stream, str(tmp_path / "count")).awaitTermination()
    got = counted.stream_hits(spark, str(tmp_path / "count"))
    assert same(got, counted.detect(table).select(*got.columns))
    with pytest.raises(ValueError):
        counted.detect_stream(stream)


def forget_last_commit(checkpoint):
    """The next start repeats the last micro-batch, as after a failure before its commit."""
    commits = checkpoint / "commits"
    last = max(int(name) for name in os.listdir(commits) if name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (commits / name).unlink()


def test_arrival_windows_survive_a_restart(spark, stream, table, tmp_path):
    out, turn = str(tmp_path), [0]

    def now():  # another stamp at each call: a repeated batch must not use it
        turn[0] += 1
        return F.lit(5_000_000 * turn[0]).cast("bigint")

    clock.stamp_arrivals(stream, out, now=now).awaitTermination()
    before = clock.arrivals(spark, out).collect()
    assert len(before) == table.count() and {r.ts_us for r in before} == {5_000_000 * k for k in range(1, 6)}
    forget_last_commit(tmp_path / "arrivals-checkpoint")
    clock.stamp_arrivals(stream, out, now=now).awaitTermination()
    assert sorted(clock.arrivals(spark, out).collect()) == sorted(before)
    plan = DetectionPlan(clock="ingress", threshold=0)
    got, _ = run(spark, plan.detect_stream(clock.stream_arrivals(spark, out)), tmp_path / "windows")
    want = sliding_bytes(clock.arrivals(spark, out))
    assert got.count() and got.join(want, got.columns, "left_anti").count() == 0


def test_run_totals(spark, stream, table, tmp_path):
    observed = observe_detector(stream_pane_bytes(stream), threshold=1500)
    with RunTotals(spark) as listener:
        query = outputs.write_windows(observed, str(tmp_path))
        totals = listener.wait(query).totals(query)
        row = listener.row(query).first()
    got = spark.read.parquet(f"{tmp_path}/windows")
    assert (totals["rows"], totals["batches"]) == (table.count(), 5)
    assert (row.processed, row.detected) == (got.count(), heavy_hitters(got).count())
    assert row.rows_dropped_by_watermark == 0 and row.rows_per_busy_second > 0


def test_alerts_carry_the_crossing_packet(spark, stream, table, tmp_path):
    query = outputs.alert_crossings(stream, str(tmp_path), DELAY_US, 3000)
    query.awaitTermination()
    want = first_crossings(table, 3000)
    assert same(outputs.alerts(spark, str(tmp_path)), want)
    assert len(os.listdir(tmp_path / "open")) == 2
    before = outputs.alerts(spark, str(tmp_path)).collect()
    forget_last_commit(tmp_path / "checkpoint")
    outputs.alert_crossings(stream, str(tmp_path), DELAY_US, 3000).awaitTermination()
    assert sorted(outputs.alerts(spark, str(tmp_path)).collect()) == sorted(before)


def test_late_packets_raise_no_alert_for_closed_windows(spark, packets, tmp_path):
    a, b = "10.0.0.1", "10.0.0.2"
    source = tmp_path / "in"
    for at, rows in enumerate([[(100, a, b, 900)], [(200_000, a, b, 300), (9_000_000, a, b, 10)], [(150, a, b, 5000), (9_100_000, a, b, 4)]]):
        packets(*rows).coalesce(1).write.mode("append").parquet(str(source))
        for name in os.listdir(source):
            if name.endswith(".parquet") and os.path.getmtime(source / name) > 1_700_000_100:
                os.utime(source / name, (1_700_000_000 + at, 1_700_000_000 + at))
    outputs.alert_crossings(stream_packets_parquet(spark, str(source), 1), str(tmp_path / "out"), DELAY_US, 1000).awaitTermination()
    got = outputs.alerts(spark, str(tmp_path / "out"))
    assert {(r.ts_us, r.acc_bytes) for r in got.collect()} == {(200_000, 1200)} and got.count() == 18


def test_replayed_stream_restarts_where_it_was(spark, table, tmp_path):
    packets = table.select("pkt_id", "ts_us", "pkt_len").limit(50)
    turns = replay_stream(packets, rows_per_batch=30, generations=3, partitions=2)
    for wanted in (2, 5):  # stop after some batches, then go on
        query = outputs.write_windows(turns, str(tmp_path), trigger={"processingTime": "0 seconds"})
        while max([p["batchId"] for p in query.recentProgress], default=-1) < wanted:
            time.sleep(0.1)
        query.stop()
    got = spark.read.parquet(f"{tmp_path}/windows")
    want = replay(packets, 3).select("pkt_id", F.col("gen").cast("bigint").alias("gen"), "ts_us", "pkt_len")
    assert same(got.select(*want.columns), want)


def test_observed_counts(spark, stream, table, tmp_path):
    observed = observe_detector(stream_pane_bytes(stream), threshold=1500)
    got, query = run(spark, observed, tmp_path)
    seen = [p["observedMetrics"]["detector"] for p in query.recentProgress if "detector" in p["observedMetrics"]]
    assert sum(m["processed"] for m in seen) == got.count()
    assert sum(m["detected"] for m in seen) == heavy_hitters(got).count()


def test_alerts_come_once_and_completely(spark, stream, table, tmp_path):
    threshold = 3000
    query = outputs.alert_early(stream_sliding_bytes(stream), str(tmp_path), DELAY_US, threshold)
    query.awaitTermination()
    got = outputs.alerts(spark, str(tmp_path))
    keys = ["flow_id", "window_start_us"]
    assert got.count() == got.select(*keys).distinct().count()
    assert same(got.select(*keys), heavy_hitters(sliding_bytes(table), threshold).select(*keys))
    assert got.agg(F.min("acc_bytes")).first()[0] > threshold


@pytest.mark.parametrize("n", [1, 3, 50])
def test_count_stream_equals_batch(spark, stream, table, tmp_path, n):
    got, _ = run(spark, stream_count_window_bytes(tag_flow(stream), n), tmp_path)
    assert same(got, count_window_bytes(tag_flow(table), n).select(*got.columns))


@pytest.mark.parametrize("n,hot", [(1, 10**6), (7, 10**6), (7, 2)])
def test_count_batches_equal_batch(spark, stream, table, tmp_path, n, hot):
    query = count_window_batches(tag_flow(stream), n, str(tmp_path), max_flow_rows=hot, chunk_rows=8)
    query.awaitTermination()
    assert query.exception() is None
    got = count_window_results(spark, str(tmp_path))
    assert same(got, count_window_bytes(tag_flow(table), n).select(*got.columns))
    assert len(os.listdir(tmp_path / "tails")) == 2


def test_count_batches_forget_silent_flows(spark, packets, tmp_path):
    quiet, loud = ("10.0.0.1", "10.0.0.2"), ("10.0.0.3", "10.0.0.4")
    source = tmp_path / "in"
    for at, rows in enumerate([[(0, *quiet, 10), (9_000_000, *loud, 5)], [(10_000_000, *quiet, 1), (10_000_001, *loud, 2)]]):
        packets(*rows).coalesce(1).write.mode("append").parquet(str(source))
        for name in os.listdir(source):
            if name.endswith(".parquet") and os.path.getmtime(source / name) > 1_700_000_100:
                os.utime(source / name, (1_700_000_000 + at, 1_700_000_000 + at))
    stream = stream_packets_parquet(spark, str(source), 1)
    count_window_batches(tag_flow(stream), 5, str(tmp_path / "out"), ttl_us=5_000_000).awaitTermination()
    sums = {r.ts_us: r.acc_bytes for r in count_window_results(spark, str(tmp_path / "out")).collect()}
    assert sums == {0: 10, 9_000_000: 5, 10_000_000: 1, 10_000_001: 7}


def test_running_peaks(spark, stream, table, tmp_path):
    hits = heavy_hitters(stream_sliding_bytes(stream))
    outputs.keep_flow_peaks(hits, str(tmp_path)).awaitTermination()
    closed = sliding_bytes(table).filter(F.col("window_end_us") <= watermark(table))
    assert same(outputs.current_peaks(spark, str(tmp_path)), flow_peaks(heavy_hitters(closed)))
    forget_last_commit(tmp_path / "checkpoint")
    outputs.keep_flow_peaks(hits, str(tmp_path)).awaitTermination()
    assert same(outputs.current_peaks(spark, str(tmp_path)), flow_peaks(heavy_hitters(closed)))


def test_runs_of_peaks_are_a_binary_counter():
    assert outputs._runs(0) == [] and outputs._runs(6) == [(0, 3), (4, 5)] and outputs._runs(8) == [(0, 7)]
    written = 0
    for n in range(1, 1025):
        first, last = outputs._runs(n)[-1]
        written += last - first + 1
    assert written == 1024 * 6  # each batch is written again once per doubling, half of the time


def test_latency_sketches_merge(spark, stream, table, tmp_path):
    outputs.write_latency_stats(tag_flow(stream), str(tmp_path), 2, latency=F.col("pkt_len") / 1.0).awaitTermination()
    got = {r.sink_id: r for r in outputs.live_latency_stats(spark, str(tmp_path)).collect()}
    lengths = tag_flow(table).select(F.expr("cast(pmod(flow_id, 2) as int)").alias("sink"), "pkt_len").toPandas()
    for sink, part in lengths.groupby("sink").pkt_len:
        row, values = got[sink], sorted(part)
        assert (row.samples, row.min_ms, row.max_ms) == (len(values), values[0], values[-1])
        assert row.mean_ms == pytest.approx(part.mean())
        for p in (5, 50, 95):
            below, upto = (sum(test(v) for v in values) / len(values) for test in (row[f"p{p}_ms"].__gt__, row[f"p{p}_ms"].__ge__))
            assert below - outputs.RANK_ERROR <= p / 100 <= upto + outputs.RANK_ERROR
    outputs.write_latency_stats(heavy_hitters(stream_sliding_bytes(stream)), str(tmp_path / "live")).awaitTermination()
    assert outputs.live_latency_stats(spark, str(tmp_path / "live")).first().min_ms > 0


def test_result_sets_and_latency(spark, stream, table, tmp_path):
    hits = heavy_hitters(stream_sliding_bytes(stream))
    want = heavy_hitters(sliding_bytes(table)).filter(F.col("window_end_us") <= watermark(table))
    outputs.write_result_sets(hits, str(tmp_path / "t"), text=True).awaitTermination()
    assert spark.read.text(str(tmp_path / "t/results")).count() == want.count()
    outputs.write_live_latency(hits, str(tmp_path / "l")).awaitTermination()
    latency = spark.read.parquet(str(tmp_path / "l/latency"))
    assert latency.count() == want.count() and latency.filter("latency_ms <= 0").count() == 0


def test_late_packets_are_dropped_and_counted(spark, packets, tmp_path):
    source = tmp_path / "in"
    a, b = "10.0.0.1", "10.0.0.2"
    for at, rows in enumerate([[(0, a, b, 10), (20_000_000, a, b, 10)], [(30_000_000, a, b, 3)], [(1_000, a, b, 99)]]):
        packets(*rows).coalesce(1).write.parquet(str(tmp_path / f"part{at}"))
        source.mkdir(exist_ok=True)
        part = next(n for n in os.listdir(tmp_path / f"part{at}") if n.endswith(".parquet"))
        shutil.copy(tmp_path / f"part{at}" / part, source / f"{at}.parquet")
        os.utime(source / f"{at}.parquet", (1_700_000_000 + at, 1_700_000_000 + at))
    got, query = run(spark, stream_sliding_bytes(stream_packets_parquet(spark, str(source), 1)), tmp_path / "out")
    assert got.agg(F.max("acc_bytes")).first()[0] == 10
    dropped = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    assert dropped > 0


def test_text_stream(spark, tmp_path):
    source = tmp_path / "lines"
    source.mkdir()
    (source / "a.csv").write_text("5,10.0.0.1,10.0.0.2,6,118,100,20,80,20,60,1000,80,5,0,512,1\n1,2,3\n")
    got, _ = run(spark, stream_packets_csv(spark, str(source), 1).select("ts_us", "pkt_len"), tmp_path / "out")
    assert [tuple(r) for r in got.collect()] == [(5, 118)]


def test_paced_trigger_and_restart(spark, trace, table, tmp_path):
    """A query stopped and started again goes on from its checkpoint."""
    build = lambda: stream_sliding_bytes(stream_packets_parquet(spark, trace, 1))
    query = outputs.write_windows(build(), str(tmp_path), trigger=outputs.EVERY_BATCH)
    deadline = time.time() + 60
    while not query.lastProgress and time.time() < deadline:
        time.sleep(0.2)
    query.stop()
    got, _ = run(spark, build(), tmp_path)
    assert same(got, sliding_bytes(table).filter(F.col("window_end_us") <= watermark(table)))


def test_idle_state_is_removed():
    import pandas as pd
    from flowtusk.streaming.counts import _moving_sum

    class State:
        def __init__(self, timed_out=False, kept=None):
            self.hasTimedOut, self.exists, self.get, self.removed = timed_out, kept is not None, (kept,), False
            self.timeout = None

        def remove(self):
            self.removed = True

        def update(self, value):
            self.get = value

        def setTimeoutDuration(self, ms):
            self.timeout = ms

    idle = State(timed_out=True)
    assert list(_moving_sum(3, 100)((1,), iter([]), idle)) == [] and idle.removed
    rows = pd.DataFrame({"flow_id": [1, 1], "pkt_id": [2, 1], "dst_ip": "d", "pkt_len": [30, 20], "ts_us": [9, 8]})
    active = State(kept=[7, 10])
    out = next(_moving_sum(3, 100)((1,), iter([rows]), active))
    assert list(out.acc_bytes) == [37, 60] and active.get == ([20, 30],) and active.timeout == 100


def test_passing_tables_are_deleted(spark):
    from flowtusk.plans.storage import passing_tables, store
    with passing_tables(spark):
        kept = store(spark.range(3), "passing")
        path = kept.inputFiles()[0].removeprefix("file:").replace("///", "/")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_stream_hashes_expanded_packets(spark, packets, tmp_path):
    """Sums have a fixed width, and carried addresses come back as they were; longer ones go as texts."""
    rows = packets((0, "10.0.0.1", "", 10), (1, "host-ä", None, 7), (2, "255.255.255.255", "b", 5))
    rows.write.parquet(str(tmp_path / "in"))
    stream = stream_packets_parquet(spark, str(tmp_path / "in"))
    query = outputs.write_result_sets(stream_sliding_bytes(stream, key=FlowKey(("pkt_id",), F.col)), str(tmp_path / "out"))
    query.processAllAvailable()
    query.awaitTermination()
    plan = query._jsq.explainInternal(False).splitlines()
    at = next(i for i, line in enumerate(plan) if "Expand " in line)
    assert "HashAggregate" in next(line for line in reversed(plan[:at]) if "Project" not in line and "Filter" not in line)
    halves = {f"{c}_{h}": _packed(c, h) for c in ("src_ip", "dst_ip") for h in (0, 1)}
    back = rows.withColumns(halves).select("pkt_id", *[_unpacked([f"{c}_0", f"{c}_1"]).alias(c) for c in ("src_ip", "dst_ip")])
    assert sorted(map(tuple, back.collect())) == [
        (0, "10.0.0.1", ""), (1, "host-ä", None), (2, "255.255.255.255", "b")]
    with pytest.raises(Exception, match="long_addresses"):
        packets((0, "2001:db8:0:0:0:0:0:1", "b", 1)).select(_packed("src_ip", 0)).collect()


def test_batches_of_several_files(spark, folder, monkeypatch):
    """Large micro-batches are written and read as several files each; the number of batches stays."""
    monkeypatch.setattr(queries, "FILE_ROWS", 50)
    stream = queries._tcp_batches(spark, folder).select("ts_us", F.col("_metadata.file_path").alias("file"))
    seen = []
    stream.writeStream.foreachBatch(lambda batch, _: seen.append(batch.agg(
        F.min("ts_us"), F.max("ts_us"), F.count_distinct("file"), F.count("*")).first())).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == queries.BATCHES and all(a[1] < b[0] for a, b in zip(seen, seen[1:]))
    assert len({row[2] for row in seen}) == 1 and seen[0][2] > 1
    assert sum(row[3] for row in seen) == queries._tcp(spark, folder).count()
