import math
import random

import pytest
from pyspark.sql import functions as F

from flowtusk import detect_heavy_flows
from flowtusk.operators.count_windows import count_window_bytes
from flowtusk.operators import windows
from flowtusk.operators.crossings import first_crossings
from flowtusk.operators.packets import heavy_hitters, non_empty_window, tag_flow
from flowtusk.functions.keys import FlowKey
from flowtusk.operators.windows import (
    _panes_of_flows,
    distinct, largest, sliding_bytes, sliding_bytes_microbatch, sliding_bytes_reduce, sliding_bytes_window, smallest, total,
    tumbling_bytes, windows_of_panes,
)

S = 1_000_000
A, B = "10.0.0.1", "10.0.0.2"


def same(left, right):
    return left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def noisy(packets, n=400, pairs=7, span=6 * S, seed=3):
    """Packets with gaps, equal times and colliding pairs."""
    rng = random.Random(seed)
    ends = [("1.1.1.1", "10.0.0.25"), ("1.1.1.3", "10.0.0.12")]
    ends += [(f"10.0.0.{i}", f"10.0.1.{i % 3}") for i in range(pairs)]
    return packets(*[(rng.randrange(0, span, 50_000), *rng.choice(ends), rng.randrange(60, 1500)) for _ in range(n)])


def brute(rows, length, slide, carry, key):
    windows = {}
    for r in rows:
        start = r.ts_us // slide * slide
        while start > r.ts_us - length:
            windows.setdefault((key(r), start), []).append(r)
            start -= slide
    out = set()
    for (flow, start), members in windows.items():
        members.sort(key=lambda r: (r.ts_us, r.pkt_id))
        edge = members[0 if carry == "first" else -1]
        out.add((flow, start, start + length, edge.src_ip, edge.dst_ip, sum(r.pkt_len for r in members), edge.ts_us,
                 len(members)))
    return out


@pytest.mark.parametrize("length,slide", [(2 * S, S // 10), (2 * S, 300_000), (S, S), (S, 3 * S), (700_000, 200_000)])
@pytest.mark.parametrize("carry", ["first", "last"])
@pytest.mark.parametrize("bound", [None, 1000])
def test_pane_plan_against_brute_force(spark, packets, length, slide, carry, bound):
    table = noisy(packets).cache()
    flow_of = {r.pkt_id: r.flow_id for r in tag_flow(table).collect()}
    want = brute(table.collect(), length, slide, carry, lambda r: flow_of[r.pkt_id])
    got = sliding_bytes(table, length, slide, carry=carry, pkt_id_bound=bound).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("blocks", [1, 3, None])
@pytest.mark.parametrize("carry", ["first", "last"])
def test_block_size_does_not_show(packets, blocks, carry):
    from flowtusk.operators.windows import flow_panes, windows_of_panes
    table = noisy(packets, seed=13)
    panes = flow_panes(table, 100_000, carry=carry)
    assert same(windows_of_panes(panes, 20 * S, S // 10, carry, blocks),
                sliding_bytes(table, 20 * S, carry=carry, plan="direct"))


@pytest.mark.parametrize("key", ["poly17", "objects31", "xor", "pair"])
@pytest.mark.parametrize("carry", ["first", "last"])
def test_pane_plan_equals_the_window_function(packets, key, carry):
    table = noisy(packets, seed=5)
    assert same(sliding_bytes(table, key=key, carry=carry), sliding_bytes(table, key=key, carry=carry, plan="direct"))


def test_five_tuple_packets_of_one_pair_at_one_time(packets):
    table = noisy(packets, seed=11).withColumns({
        "src_port": (F.col("pkt_id") % 3).cast("int"), "dst_port": F.lit(80)})
    assert same(sliding_bytes(table, key="five_tuple_xor"),
                sliding_bytes(table, key="five_tuple_xor", plan="direct"))


def test_times_before_the_epoch(packets):
    table = packets((-5, A, B, 10), (-1_999_999, A, B, 20), (3, A, B, 30))
    assert same(sliding_bytes(table), sliding_bytes(table, plan="direct"))


def test_variants_agree(packets):
    table = noisy(packets, seed=7)
    reduce_ = sliding_bytes_reduce(table)
    assert same(reduce_, sliding_bytes_window(table).drop("packets"))
    assert same(reduce_, sliding_bytes_microbatch(table))
    assert same(reduce_, sliding_bytes_microbatch(table, batch_us=50_000))


def test_each_byte_is_counted_in_twenty_windows(packets):
    table = noisy(packets, seed=9)
    total = table.agg(F.sum("pkt_len")).first()[0]
    assert sliding_bytes(table).agg(F.sum("acc_bytes")).first()[0] == 20 * total
    assert tumbling_bytes(table).agg(F.sum("acc_bytes")).first()[0] == total


def test_one_packet_lies_in_twenty_windows(packets):
    assert sliding_bytes(packets((5 * S, A, B, 100))).count() == 20


def test_window_ends_are_exclusive(packets):
    sums = sliding_bytes(packets((5 * S, A, B, 100), (7 * S, A, B, 100)))
    assert sums.agg(F.max("acc_bytes")).first()[0] == 100


def test_wrong_pkt_id_bound_fails(packets):
    table = packets((0, A, B, 1), (1, A, B, 2), (2, A, B, 3))
    with pytest.raises(Exception, match="pkt_id outside"):
        sliding_bytes(table, pkt_id_bound=2).collect()


def test_parameters_are_checked(packets):
    table = packets((0, A, B, 1))
    with pytest.raises(ValueError):
        sliding_bytes(table, 0, 10)
    with pytest.raises(ValueError):
        sliding_bytes_microbatch(table, 300_000)
    with pytest.raises(ValueError):
        sliding_bytes(table, key="nope")
    with pytest.raises(ValueError):
        sliding_bytes(table, carry="middle")


def test_threshold_is_strict(packets):
    exact = packets((0, A, B, 1500))
    above = packets((0, A, B, 1501))
    assert detect_heavy_flows(exact).count() == 0
    assert detect_heavy_flows(above).count() == 20


def test_custom_predicate_and_empty_windows(packets):
    sums = sliding_bytes(packets((S, A, B, 10), (S + 1, A, "10.0.0.9", 20)))
    assert heavy_hitters(sums, predicate=F.col("dst_ip") == "10.0.0.9").count() == 20
    assert non_empty_window(sums.withColumn("ts_us", F.lit(0))).count() == 0


def test_plan_has_two_shuffles_and_no_python(packets, spark):
    plan = sliding_bytes(packets((0, A, B, 1)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "Python" not in plan and "ArrowEval" not in plan
    assert "HashAggregate" in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("carry", ["first", "last"])
def test_many_pairs_of_one_flow_are_merged_before_the_sweep(spark, packets, carry):
    key = FlowKey(("dst_ip",), lambda dst: F.xxhash64(dst))
    table = packets(*[(S + i % 7 * 90_000, f"10.0.{i % 50}.{i % 9}", B, 100 + i) for i in range(900)])
    options = {"key": key, "carry": carry}
    assert same(sliding_bytes(table, **options), sliding_bytes(table, plan="direct", **options))
    panes = _panes_of_flows(table, 100_000, key, carry, None)
    assert panes.count() == panes.select("flow_id", "pane").distinct().count() == 6


# --- count windows -------------------------------------------------------------------------

def brute_counts(rows, n):
    kept, out = {}, {}
    for r in sorted(rows, key=lambda r: (r.ts_us, r.pkt_id)):
        window = kept.setdefault(r.flow_id, [])
        window.append(r.pkt_len)
        del window[:-n]
        out[r.pkt_id] = sum(window)
    return out


@pytest.mark.parametrize("n", [1, 2, 5, 50, 1000])
@pytest.mark.parametrize("options", [
    {"strategy": "by_flow"}, {"strategy": "by_chunk", "chunk_rows": 7}, {"strategy": "by_chunk", "chunk_rows": 64},
    {"max_flow_rows": 60, "chunk_rows": 16},
])
def test_count_windows_against_brute_force(packets, n, options):
    tagged = tag_flow(noisy(packets, n=500, seed=2)).cache()
    want = brute_counts(tagged.collect(), n)
    got = count_window_bytes(tagged, n, **options).collect()
    assert len(got) == len(want) and {r.pkt_id: r.acc_bytes for r in got} == want


def test_count_window_example(packets):
    tagged = tag_flow(packets((0, A, B, 10), (1, A, B, 20), (2, A, B, 30)))
    assert [r.acc_bytes for r in count_window_bytes(tagged, 2).orderBy("ts_us").collect()] == [10, 30, 50]


def test_dominating_flow_is_split(spark):
    """Two thirds of the rows in one flow, many at one instant."""
    rows = spark.range(6000).select(
        F.col("id").alias("pkt_id"), (F.col("id") % 3 == 0).cast("bigint").alias("cold"),
        (F.col("id").cast("bigint") % 11).alias("ts_us"), F.lit("d").alias("dst_ip"),
        (F.col("id") % 97).alias("pkt_len"))
    tagged = rows.withColumn("flow_id", F.when(F.col("cold") == 1, F.col("pkt_id")).otherwise(F.lit(-1))).drop("cold")
    split = count_window_bytes(tagged, 20, max_flow_rows=500, chunk_rows=300)
    assert same(split, count_window_bytes(tagged, 20, "by_flow"))


def test_filter_and_columns_reach_the_scan(spark, packets, tmp_path):
    from flowtusk.operators.packets import tcp_only
    noisy(packets).withColumns({"seq": F.lit(1), "win": F.lit(2)}).write.parquet(str(tmp_path / "packets"))
    table = tcp_only(spark.read.parquet(str(tmp_path / "packets")))
    plan = sliding_bytes(table)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(protocol,6)" in plan
    read = plan.split("ReadSchema:")[1]
    assert "pkt_len" in read and "seq" not in read and "win:" not in read


EXTRAS = {"most": largest("pkt_len"), "least": smallest("pkt_len"), "sum": total("pkt_len"), "lengths": distinct("pkt_len"),
          "hosts": distinct("dst_ip")}


@pytest.mark.parametrize("length,slide,carry,key,blocks", [
    (2 * S, S // 10, "first", "poly17", None), (2 * S, S // 10, "last", FlowKey(("dst_ip",), F.crc32), 20),
    (S, S, "last", "poly17", 3), (6 * S // 10, S // 10, "first", "xor", 6), (S // 2, 3 * S // 10, "first", "poly17", None)])
def test_extras_on_panes_equal_the_window_function(packets, length, slide, carry, key, blocks):
    table = noisy(packets, 300, span=9 * S)
    table = table.withColumn("dst_ip", F.when(F.col("pkt_id") % 11 == 0, F.lit(None)).otherwise(F.col("dst_ip"))) if key == "poly17" else table
    want = sliding_bytes(table, length, slide, key=key, carry=carry, plan="direct", extras=EXTRAS)
    if blocks is None:
        got = sliding_bytes(table, length, slide, key=key, carry=carry, extras=EXTRAS)
    else:
        pane = math.gcd(length, slide)
        got = windows_of_panes(windows._panes_of_flows(table, pane, key, carry, None, EXTRAS), length, slide, carry, blocks, EXTRAS,
                               windows._values_of_panes(table, pane, key, EXTRAS))
    assert same(got.select(*want.columns), want)


def test_extras_expand_no_packets(packets):
    plan = sliding_bytes(noisy(packets), extras={"most": largest("pkt_len")})._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


@pytest.mark.parametrize("length,slide,threshold,blocks", [
    (2 * S, S // 10, 2000, None), (2 * S, S // 10, 5000, 3), (S, S, 900, 2), (S // 2, 3 * S // 10, 300, 1), (S // 10, S // 2, 50, 4)])
def test_crossings_against_brute_force(packets, length, slide, threshold, blocks):
    table = noisy(packets, 300, span=9 * S)
    got = {(r.flow_id, r.window_start_us): (r.pkt_id, r.ts_us, r.acc_bytes)
           for r in first_crossings(table, threshold, length, slide, windows_per_block=blocks).collect()}
    flows, want = {}, {}
    for r in tag_flow(table).orderBy("ts_us", "pkt_id").collect():
        flows.setdefault(r.flow_id, []).append(r)
    for flow, rows in flows.items():
        for start in range(-length - slide, 10 * S, slide):
            start, acc = start // slide * slide, 0
            for r in rows:
                if start <= r.ts_us < start + length:
                    acc += r.pkt_len
                    if acc > threshold:
                        want[flow, start] = (r.pkt_id, r.ts_us, acc)
                        break
    assert got == want and want
    with pytest.raises(ValueError):
        first_crossings(table, -1)


def above_expand(plan: str) -> str:
    """The operator that takes the packets expanded to windows."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "Expand " in line)
    return next(line for line in reversed(lines[:at]) if "Project" not in line and "Filter" not in line)


def test_direct_hashes_expanded_packets(packets):
    table = packets(*[(S + i * 1000, A, B, 1 + i) for i in range(20)])
    plan = sliding_bytes(table, plan="direct")._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" in above_expand(plan)


def test_values_are_counted_before_they_meet_their_block(packets):
    """What reaches the sweep follows panes and windows, not the number of different values."""
    table = packets(*[(S + i % 10, A, B, i) for i in range(300)])
    sums = sliding_bytes(table, extras={"lengths": distinct("pkt_len")})
    assert {r.lengths for r in sums.collect()} == {300}
    plan = sums._jdf.queryExecution().optimizedPlan().toString().splitlines()
    sweep = next(i for i, line in enumerate(plan) if "RepartitionByExpression [flow_id" in line)
    assert any("Aggregate [flow_id" in line and "what" in line for line in plan[sweep:])
