"""Lengths, times and header fields of captured Ethernet frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtusk.functions.addresses import _col, ip_to_string
from flowtusk.schema import FRAME_OVERHEAD, TCP

# EtherType numbers.
ETHERTYPE_IPV4 = 0x0800
ETHERTYPE_VLAN = 0x8100


def wire_len(ip_len: Column | str, wrap16: bool = False) -> Column:
    """IP length plus link overhead, optionally wrapped to 16 bits."""
    total = _col(ip_len) + F.lit(FRAME_OVERHEAD)
    return F.pmod(total, F.lit(65536)) if wrap16 else total


def ip_payload_len(ip_len: Column | str, ip_hdr_len: Column | str) -> Column:
    return _col(ip_len) - _col(ip_hdr_len)


def tr_payload_len(ip_len: Column | str, ip_hdr_len: Column | str, tr_hdr_len: Column | str) -> Column:
    return _col(ip_len) - _col(ip_hdr_len) - _col(tr_hdr_len)


def payload_lengths(packets: DataFrame) -> DataFrame:
    """Attach IP and transport payload lengths."""
    return packets.withColumns({
        "ip_payload_len": ip_payload_len("ip_len", "ip_hdr_len"),
        "tr_payload_len": tr_payload_len("ip_len", "ip_hdr_len", "tr_hdr_len"),
    })


def ts_from_pcap(sec: Column | str, usec: Column | str) -> Column:
    """Seconds and microseconds to epoch microseconds."""
    return _col(sec).cast("bigint") * 1_000_000 + _col(usec).cast("bigint")


def be_uint(data: Column, offset: Column | int, size: int) -> Column:
    """Big-endian unsigned number of `size` bytes at 0-based `offset` of a binary column."""
    start = (offset if isinstance(offset, Column) else F.lit(offset)) + 1
    return F.conv(F.hex(F.substring(data, start, F.lit(size))), 16, 10).cast("bigint")


def tcp_fields(frame: Column | str, tcp_at: Column | int) -> dict[str, Column]:
    """TCP header fields of a frame whose TCP header starts at byte `tcp_at`.

    The acknowledgement number is 0 unless the ACK flag is set.
    """
    data = _col(frame)
    at = tcp_at if isinstance(tcp_at, Column) else F.lit(tcp_at)
    flags = be_uint(data, at + 13, 1)
    return {
        "tr_hdr_len": (F.shiftright(be_uint(data, at + 12, 1), 4) * 4).cast("int"),
        "src_port": be_uint(data, at, 2).cast("int"),
        "dst_port": be_uint(data, at + 2, 2).cast("int"),
        "seq": be_uint(data, at + 4, 4),
        "ack": F.when(flags.bitwiseAND(16) != 0, be_uint(data, at + 8, 4)).otherwise(F.lit(0).cast("bigint")),
        "win": be_uint(data, at + 14, 2).cast("int"),
        "syn": F.shiftright(flags, 1).bitwiseAND(1).cast("smallint"),
    }


def decode_frames(records: DataFrame, frame: str = "frame") -> DataFrame:
    """Ethernet frames to TCP packets; other columns (`pkt_id`, `ts_us`) pass through.

    One 802.1Q tag is skipped; frames that are not IPv4, not TCP, or cut before the end of
    the fixed headers are dropped.
    """
    data = F.col(frame)
    keep = [c for c in records.columns if c != frame]
    tagged = be_uint(data, 12, 2) == ETHERTYPE_VLAN
    ip_at = F.when(tagged, 18).otherwise(14)
    located = records.filter(F.length(data) >= 34).select(*keep, data.alias(frame), ip_at.alias("ip_at"))
    ipv4 = located.filter(
        (be_uint(data, F.col("ip_at") - 2, 2) == ETHERTYPE_IPV4)
        & (be_uint(data, F.col("ip_at") + 9, 1) == TCP)
    )
    lengths = ipv4.select(
        *keep, frame, "ip_at",
        be_uint(data, F.col("ip_at") + 2, 2).cast("int").alias("ip_len"),
        (be_uint(data, F.col("ip_at"), 1).bitwiseAND(15) * 4).cast("int").alias("ip_hdr_len"),
    )
    tcp_at = F.col("ip_at") + F.col("ip_hdr_len")
    tcp = tcp_fields(data, tcp_at)
    fields = lengths.filter(F.length(data) >= tcp_at + 20).select(
        *keep,
        ip_to_string(be_uint(data, F.col("ip_at") + 12, 4)).alias("src_ip"),
        ip_to_string(be_uint(data, F.col("ip_at") + 16, 4)).alias("dst_ip"),
        F.lit(TCP).cast("smallint").alias("protocol"),
        wire_len("ip_len").alias("pkt_len"),
        "ip_len", "ip_hdr_len",
        *[c.alias(name) for name, c in tcp.items()],
    )
    return payload_lengths(fields)
