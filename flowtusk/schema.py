"""Column layout of packets and results."""

from __future__ import annotations

# The sixteen fields of a packet row, in file order.
PACKET_FIELDS = [
    ("ts_us", "bigint"),
    ("src_ip", "string"),
    ("dst_ip", "string"),
    ("protocol", "smallint"),
    ("pkt_len", "int"),
    ("ip_len", "int"),
    ("ip_hdr_len", "int"),
    ("ip_payload_len", "int"),
    ("tr_hdr_len", "int"),
    ("tr_payload_len", "int"),
    ("src_port", "int"),
    ("dst_port", "int"),
    ("seq", "bigint"),
    ("ack", "bigint"),
    ("win", "int"),
    ("syn", "smallint"),
]
PACKET_COLUMNS = [name for name, _ in PACKET_FIELDS]
PACKET_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in PACKET_FIELDS)

# A row counts as a packet when it has more than this many fields.
MIN_FIELDS = 11

# IP protocol numbers.
TCP = 6
UDP = 17

# Defaults of the analysis.
WINDOW_US = 2_000_000
SLIDE_US = 100_000
BATCH_US = 100_000
THRESHOLD_BYTES = 1500
FRAME_OVERHEAD = 18  # 14 bytes of Ethernet header and 4 of checksum
