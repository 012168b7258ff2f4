"""Bytes per flow over sliding and tumbling event-time windows.

Windows are half-open and start at multiples of the slide since the epoch.

The pane plan works in three steps:
1. packets are summed per (key columns, pane), where panes are the greatest common divisor of
   length and slide long; this aggregates before the shuffle and before the flow id is computed;
2. panes are placed into blocks of consecutive window starts and shuffled by (flow, block);
   a block holds a bounded number of panes, however hot the flow, and only panes near its edge
   lie in two;
3. inside its block, running sums over the sorted panes give all windows without a further
   shuffle, and without expanding panes to the windows they lie in.

Further aggregates go the same way. Totals are running sums. Of a value that occurs in several panes
of a window only the first counts: each occurrence stands for the window starts that no earlier one
covers, so distinct values are running sums too, and exact. For extremes the starts are cut into stretches of one window
length: a window lies in two of them at most, and its extreme is that of a suffix of one and a prefix of the next.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtusk.functions.keys import PAIR, FlowKey, flow_key
from flowtusk.schema import BATCH_US, SLIDE_US, WINDOW_US

MIN_WINDOWS_PER_BLOCK = 128
_WIDE = "20000000000000000000"  # larger than the range of a bigint

RESULT = ["flow_id", "window_start_us", "window_end_us", "src_ip", "dst_ip", "acc_bytes", "ts_us", "packets"]


@dataclass(frozen=True)
class Extra:
    """A further aggregate of the packets of a window: `kind` of `column`."""

    kind: str
    column: str

    def direct(self) -> Column:
        return {"total": F.sum, "largest": F.max, "smallest": F.min, "distinct": F.count_distinct}[self.kind](self.column)

    @property
    def is_extreme(self) -> bool:
        return self.kind in ("largest", "smallest")

    @property
    def pick(self):
        return F.max if self.kind == "largest" else F.min


def total(column: str) -> Extra:
    """Sum of a whole-number column."""
    return Extra("total", column)


def largest(column: str) -> Extra:
    return Extra("largest", column)


def smallest(column: str) -> Extra:
    return Extra("smallest", column)


def distinct(column: str) -> Extra:
    """Number of different values, NULL not counted; exact."""
    return Extra("distinct", column)


def floor_to(value: Column, step: int) -> Column:
    """Largest multiple of `step` that is not above `value`."""
    return value - F.pmod(value, F.lit(step).cast("bigint"))


def _check(length_us: int, slide_us: int) -> None:
    if length_us <= 0 or slide_us <= 0:
        raise ValueError("window length and slide must be positive")


def _edge(carry: str):
    """Aggregates that pick the carried packet: (extreme value, row at the extreme)."""
    if carry == "first":
        return F.min, F.min_by
    if carry == "last":
        return F.max, F.max_by
    raise ValueError("carry must be 'first' or 'last'")


def _edge_of_pane(pane_us: int, carry: str, pkt_id_bound: int | None):
    """Expressions that find time and id of the first or last packet of a pane.

    The order (ts_us, pkt_id) is held in one fixed-width number, so that the aggregation stays
    hash-based: a decimal in general, a bigint when a bound of the packet ids is known and
    offset and id fit together. Returns (order value, time of it, packet id of it).
    """
    order = F.col("edge")
    if pkt_id_bound is not None:
        id_bits = max(1, (pkt_id_bound - 1).bit_length())
        if id_bits + (pane_us - 1).bit_length() <= 62:
            packed = F.shiftleft(F.col("ts_us") - F.col("pane"), id_bits).bitwiseOR(F.col("pkt_id"))
            in_bound = F.col("pkt_id").between(0, pkt_id_bound - 1)
            value = F.when(in_bound, packed).otherwise(
                F.raise_error(F.lit(f"pkt_id outside 0..{pkt_id_bound - 1}")).cast("bigint"))
            return (value, F.col("pane") + F.shiftright(order, id_bits),
                    order.bitwiseAND(F.lit((1 << id_bits) - 1)))
    value = F.expr(f"cast(ts_us as decimal(19,0)) * cast({_WIDE} as decimal(20,0)) + pkt_id")
    ts = F.col("edge_ts")
    pkt = F.expr(f"cast(edge - cast(edge_ts as decimal(19,0)) * cast({_WIDE} as decimal(20,0)) as bigint)")
    return value, ts, pkt


def flow_panes(packets: DataFrame, pane_us: int, key: str | FlowKey = "poly17", carry: str = "first",
               pkt_id_bound: int | None = None, extras: Mapping[str, Extra] | None = None) -> DataFrame:
    """Bytes, packets, carried packet and partial `extras` per (key columns, pane), with the flow id."""
    spec = flow_key(key)
    extreme, _ = _edge(carry)
    keyed = packets.withColumn("ts_us", F.col("ts_us").cast("bigint"))
    keyed = keyed.withColumn("pane", floor_to(F.col("ts_us"), pane_us))
    sums = [F.sum("pkt_len").cast("bigint").alias("bytes"), F.count(F.lit(1)).alias("packets"),
            *[extra.direct().alias(name) for name, extra in _summed(extras).items()]]
    group = [*dict.fromkeys((*PAIR, *spec.inputs)), "pane"]
    if spec.determines_pair:
        panes = keyed.groupBy(*group).agg(*sums, extreme("ts_us").alias("edge_ts"))
        panes = panes.withColumn("edge_pkt", F.lit(0).cast("bigint"))
    else:
        value, ts, pkt = _edge_of_pane(pane_us, carry, pkt_id_bound)
        panes = (keyed.withColumn("edge", value).groupBy(*group)
                 .agg(*sums, extreme("ts_us").alias("edge_ts"), extreme("edge").alias("edge"))
                 .withColumn("edge_pkt", pkt).withColumn("edge_ts", ts))
    return panes.select(
        spec.column().alias("flow_id"), "src_ip", "dst_ip", "pane", "bytes", "packets", "edge_ts", "edge_pkt", *_summed(extras),
    )


def _summed(extras: Mapping[str, Extra] | None) -> dict[str, Extra]:
    """Those extras that have one partial value per pane."""
    return {name: extra for name, extra in (extras or {}).items() if extra.kind != "distinct"}


def _values_of_panes(packets: DataFrame, pane_us: int, key: str | FlowKey, extras: Mapping[str, Extra]) -> DataFrame | None:
    """The different values of the distinct extras per flow and pane: flow_id, pane, what, value."""
    spec, found = flow_key(key), None
    for name, extra in extras.items():
        if extra.kind == "distinct":
            pane = floor_to(F.col("ts_us").cast("bigint"), pane_us)
            rows = packets.filter(F.col(extra.column).isNotNull()).groupBy(
                *dict.fromkeys((*PAIR, *spec.inputs)), pane.alias("pane"), F.col(extra.column).cast("string").alias("__value")).agg(
                F.lit(1).alias("one"))
            rows = rows.select(spec.column().alias("flow_id"), "pane", F.lit(name).alias("what"), F.col("__value").alias("value"))
            found = rows if found is None else found.unionByName(rows)
    return found


def _merge_pairs(sums: DataFrame, by: list[str], carry: str, extras: Mapping[str, Extra] | None = None) -> DataFrame:
    """Merge address pairs that share a flow id; the carried packet gives the addresses."""
    extreme, at_extreme = _edge(carry)
    edge = F.struct("edge_ts", "edge_pkt")
    return (sums.groupBy(*by)
            .agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"),
                 extreme("edge_ts").alias("edge_ts"),
                 at_extreme(F.struct("src_ip", "dst_ip"), edge).alias("pair"),
                 *[(extra.pick if extra.is_extreme else F.sum)(name).alias(name) for name, extra in _summed(extras).items()])
            .select(*by, "pair.src_ip", "pair.dst_ip", "bytes", "packets", "edge_ts", *_summed(extras)))


def _panes_of_flows(packets: DataFrame, pane_us: int, key: str | FlowKey, carry: str, pkt_id_bound,
                    extras: Mapping[str, Extra] | None = None) -> DataFrame:
    """Panes with few rows per flow each: where a key joins many address pairs, they are merged
    before blocks are formed, with partial sums, so a block's size is bounded whatever the key."""
    spec = flow_key(key)
    panes = flow_panes(packets, pane_us, spec, carry, pkt_id_bound, extras)
    if spec.few_pairs or spec.determines_pair:
        return panes
    return _merge_pairs(panes, ["flow_id", "pane"], carry, extras).withColumn("edge_pkt", F.lit(0).cast("bigint"))


def _as_result(merged: DataFrame, start: str, length_us: int, extras: Sequence[str] = ()) -> DataFrame:
    return merged.select(
        "flow_id", F.col(start).alias("window_start_us"),
        (F.col(start) + F.lit(length_us).cast("bigint")).alias("window_end_us"),
        "src_ip", "dst_ip", F.col("bytes").alias("acc_bytes"), F.col("edge_ts").alias("ts_us"), "packets", *extras,
    )


def _first_occurrences(rows: DataFrame, forwards: bool) -> DataFrame:
    """Shorten the span of each value to the starts that no occurrence before it in the sweep covers."""
    order = [F.col(c).asc() if forwards else F.col(c).desc() for c in ("enter", "leave")]
    before = F.lag("leave").over(Window.partitionBy("flow_id", "block", "what", "value").orderBy(*order))
    enter = (F.greatest if forwards else F.least)(F.col("enter"), before)
    rows = rows.withColumn("enter", enter)
    return rows.filter(F.col("enter") < F.col("leave") if forwards else F.col("enter") > F.col("leave"))


def windows_of_panes(panes: DataFrame, length_us: int, slide_us: int, carry: str = "first",
                     windows_per_block: int | None = None, extras: Mapping[str, Extra] | None = None,
                     values: DataFrame | None = None) -> DataFrame:
    """Steps 2 and 3 of the pane plan.

    Within a block the window starts are swept in one direction: a pane is added at the first
    start it counts for and taken off after the last. Between two such events all windows have
    the same sum, so each non-empty window is produced once. Sweeping backwards for
    `carry="first"`, and forwards for "last", the pane added last holds the carried packet.
    `values` has the values of distinct extras per flow and pane.
    """
    _edge(carry)
    extras = dict(extras or {})
    extremes = {name: extra for name, extra in extras.items() if extra.is_extreme}
    # At least four window lengths per block, so that few panes lie in two blocks.
    windows_per_block = windows_per_block or max(MIN_WINDOWS_PER_BLOCK, 4 * -(-length_us // slide_us))
    if extremes:  # blocks of whole stretches
        stretch = length_us // slide_us
        windows_per_block = -(-windows_per_block // stretch) * stretch
    block_us = slide_us * windows_per_block
    pane = F.col("pane")
    forwards = carry == "last"
    step = slide_us if forwards else -slide_us

    def swept_of(rows: DataFrame) -> DataFrame:
        spans = rows.withColumns({
            "low": floor_to(pane - F.lit(length_us).cast("bigint"), slide_us) + F.lit(slide_us),
            "high": floor_to(pane, slide_us),
        })
        if slide_us > length_us:  # panes between two windows belong to none
            spans = spans.filter(F.col("low") <= F.col("high"))
        blocks = spans.withColumn("block", F.explode(F.sequence(
            floor_to(F.col("low"), block_us), floor_to(F.col("high"), block_us), F.lit(block_us).cast("bigint"))))
        low = F.greatest("low", "block")
        high = F.least(F.col("high"), F.col("block") + F.lit(block_us - slide_us))
        enter, leave = (low, high + F.lit(slide_us)) if forwards else (high, low - F.lit(slide_us))
        # A pane whose sweep begins in another block counts towards that block's stretches.
        begins = low == F.col("low") if forwards else high == F.col("high")
        return blocks.select("flow_id", "block", *[c for c in rows.columns if c not in ("flow_id", "pane")], begins.alias("begins"),
                             enter.alias("enter"), leave.alias("leave"))

    swept = swept_of(panes)
    if values is not None:
        # Values are dealt over tasks by value; to a block go only the numbers of those that enter and leave alike.
        counted = _first_occurrences(swept_of(values), forwards).groupBy("flow_id", "block", "what", "enter", "leave").agg(
            F.count(F.lit(1)).alias("times"))
        swept = swept.unionByName(counted, allowMissingColumns=True)
    swept = swept.repartition("flow_id", "block")
    entering, sign = F.col("sign") == 1, F.col("sign")
    change = [(sign * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("bytes", "packets")]
    for name, extra in extras.items():
        if extra.kind == "distinct":
            change.append(F.when(F.col("what") == name, sign * F.col("times")).otherwise(0).cast("bigint").alias(name))
        elif extra.kind == "total":
            change.append((sign * F.coalesce(F.col(name), F.lit(0))).alias(name))
        else:
            change += [F.when(entering & F.col("begins"), F.col(name)).alias(f"{name}__up"), F.when(~entering, F.col(name)).alias(f"{name}__down")]
    is_pane = F.col("packets").isNotNull()
    events = swept.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1)))).select(
        "flow_id", "block", F.when(entering, F.col("enter")).otherwise(F.col("leave")).alias("start"), *change,
        "edge_ts", "edge_pkt", F.when(entering & is_pane, F.struct("src_ip", "dst_ip", "edge_ts")).alias("edge"))
    order = [F.col(c).asc() if forwards else F.col(c).desc() for c in ("start", "edge_ts", "edge_pkt")]
    sweep = Window.partitionBy("flow_id", "block").orderBy(*order)
    so_far = sweep.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = [F.sum(name).over(so_far).alias(name) for name, extra in extras.items() if not extra.is_extreme]
    if extremes:
        # Windows begin at `at`, turned so that the sweep runs downwards; panes of a window lie in its own
        # stretch from `at` on, or have left the stretch above by less than `at`.
        events = events.withColumn("at", -F.col("start") - F.lit(slide_us) if forwards else F.col("start"))
        within = Window.partitionBy("flow_id", "block", floor_to(F.col("at"), length_us))
        suffix = within.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        prefix = within.orderBy(F.asc("at")).rangeBetween(Window.unboundedPreceding, -1)
        events = events.withColumns({f"{name}__{side}": extra.pick(f"{name}__{side}").over(frame) for name, extra in extremes.items()
                                     for side, frame in (("up", suffix), ("down", prefix))})
        counted += [(F.greatest if extra.kind == "largest" else F.least)(f"{name}__up", f"{name}__down").alias(name)
                    for name, extra in extremes.items()]
    held = events.select(
        "flow_id", "start", F.lead("start").over(sweep).alias("next"),
        F.sum("bytes").over(so_far).alias("bytes"), F.sum("packets").over(so_far).alias("packets"),
        F.last("edge", ignorenulls=True).over(so_far).alias("edge"), *counted,
    ).filter((F.col("packets") > 0) & (F.col("next") != F.col("start")))
    return _as_result(held.select(
        "flow_id", "bytes", "packets", "edge.*", *extras,
        F.explode(F.sequence(F.col("start"), F.col("next") - F.lit(step), F.lit(step).cast("bigint"))).alias("at"),
    ), "at", length_us, list(extras))


def _tumbling(packets: DataFrame, length_us: int, key, carry: str, pkt_id_bound) -> DataFrame:
    spec = flow_key(key)
    panes = flow_panes(packets, length_us, spec, carry, pkt_id_bound)
    if not spec.determines_pair:
        panes = _merge_pairs(panes, ["flow_id", "pane"], carry)
    return _as_result(panes, "pane", length_us)


def packet_order(ts: str = "ts_us", pkt: str = "pkt_id") -> Column:
    """The order (time, id) as one fixed-width number; no id sorts first."""
    return F.expr(f"cast({ts} as decimal(19,0)) * cast({_WIDE} as decimal(20,0)) + coalesce(cast({pkt} as decimal(20,0)), {-(1 << 63) - 1})")


def _direct(packets: DataFrame, length_us: int, slide_us: int, key, carry: str, aggs: Sequence[Column]) -> DataFrame:
    """The built-in window function: every packet is expanded to all its windows.

    Without further aggregates the expanded packets go into sums per address pair, whose buffers have fixed
    width, so they are hashed and never sorted; only these sums are merged by flow.
    """
    extreme, at_extreme = _edge(carry)
    spec, pair = flow_key(key), F.struct("src_ip", "dst_ip")
    window = F.window(F.timestamp_micros(F.col("ts_us")), f"{length_us} microseconds", f"{slide_us} microseconds")
    if aggs:
        grouped = packets.withColumn("flow_id", spec.column()).groupBy("flow_id", window.alias("w")).agg(
            F.sum("pkt_len").cast("bigint").alias("acc_bytes"), extreme("ts_us").alias("ts_us"),
            at_extreme(pair, F.struct("ts_us", "pkt_id")).alias("pair"), F.count(F.lit(1)).alias("packets"), F.struct(*aggs).alias("extra"))
    else:
        inputs = list(dict.fromkeys((*PAIR, *spec.inputs)))
        sums = packets.withColumn("edge", packet_order()).groupBy(*inputs, window.alias("w")).agg(
            F.sum("pkt_len").cast("bigint").alias("bytes"), extreme("ts_us").alias("ts_us"), extreme("edge").alias("edge"),
            F.count(F.lit(1)).alias("packets"))
        grouped = sums.withColumn("flow_id", spec.column()).groupBy("flow_id", "w").agg(
            F.sum("bytes").alias("acc_bytes"), extreme("ts_us").alias("ts_us"), at_extreme(pair, "edge").alias("pair"),
            F.sum("packets").alias("packets"))
    return grouped.select(
        "flow_id", F.unix_micros("w.start").alias("window_start_us"), F.unix_micros("w.end").alias("window_end_us"),
        "pair.src_ip", "pair.dst_ip", "acc_bytes", "ts_us", "packets", *(["extra.*"] if aggs else []))


def sliding_bytes(packets: DataFrame, length_us: int = WINDOW_US, slide_us: int = SLIDE_US,
                  key: str | FlowKey = "poly17", carry: str = "first", plan: str = "panes",
                  pkt_id_bound: int | None = None, aggs: Sequence[Column] = (),
                  extras: Mapping[str, Extra] | None = None) -> DataFrame:
    """Bytes per flow and window, with the addresses and time of the first or last packet.

    Packets need `pkt_id, ts_us, src_ip, dst_ip, pkt_len` and the key's columns. Ties in time
    are ordered by `pkt_id`. `extras` names further aggregates (`total`, `largest`, `smallest`,
    `distinct`), which panes hold; extremes need a length that is a multiple of the slide, else the built-in
    window function is used. So it is for `plan="direct"` and for any other aggregates of
    the packets in a window, `aggs`, which panes cannot hold in general.
    """
    _check(length_us, slide_us)
    extras = dict(extras or {})
    uneven = length_us % slide_us and any(extra.is_extreme for extra in extras.values())
    if plan == "direct" or aggs or uneven:
        return _direct(packets, length_us, slide_us, key, carry, [*aggs, *[e.direct().alias(n) for n, e in extras.items()]])
    if plan != "panes":
        raise ValueError("plan must be 'panes' or 'direct'")
    if length_us == slide_us and not extras:
        return _tumbling(packets, length_us, key, carry, pkt_id_bound)
    pane_us = gcd(length_us, slide_us)
    panes = _panes_of_flows(packets, pane_us, key, carry, pkt_id_bound, extras)
    return windows_of_panes(panes, length_us, slide_us, carry, extras=extras,
                            values=_values_of_panes(packets, pane_us, key, extras))


def sliding_bytes_reduce(packets: DataFrame, length_us: int = WINDOW_US, slide_us: int = SLIDE_US,
                         **options) -> DataFrame:
    """Running reduction per window: sum, with the first packet's destination and time."""
    return sliding_bytes(packets, length_us, slide_us, carry="first", **options).drop("src_ip", "packets")


def sliding_bytes_window(packets: DataFrame, length_us: int = WINDOW_US, slide_us: int = SLIDE_US,
                         **options) -> DataFrame:
    """Full-window evaluation: as the reduction, plus the number of packets in the window."""
    return sliding_bytes(packets, length_us, slide_us, carry="first", **options).drop("src_ip")


def sliding_bytes_microbatch(packets: DataFrame, batch_us: int = BATCH_US, length_us: int = WINDOW_US,
                             slide_us: int = SLIDE_US, key: str | FlowKey = "poly17",
                             pkt_id_bound: int | None = None) -> DataFrame:
    """Windows over fixed batches of time; length and slide must be multiples of the batch."""
    _check(length_us, slide_us)
    if batch_us <= 0 or length_us % batch_us or slide_us % batch_us:
        raise ValueError("window length and slide must be multiples of the batch interval")
    panes = _panes_of_flows(packets, batch_us, key, "first", pkt_id_bound)
    return windows_of_panes(panes, length_us, slide_us, "first").drop("src_ip", "packets")


def sliding_bytes_last(packets: DataFrame, length_us: int = WINDOW_US, slide_us: int = SLIDE_US,
                       **options) -> DataFrame:
    """Sliding sum carrying the last packet's time and addresses."""
    return sliding_bytes(packets, length_us, slide_us, carry="last", **options).drop("packets")


def tumbling_bytes(packets: DataFrame, length_us: int = WINDOW_US, carry: str = "first", **options) -> DataFrame:
    """Windows that do not overlap."""
    return sliding_bytes(packets, length_us, length_us, carry=carry, **options).drop("src_ip", "packets")
