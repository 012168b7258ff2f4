"""Flow keys. Each key names the packet columns it is computed from, so that
callers can aggregate by those columns first and compute the key on far fewer rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowtusk.functions.addresses import _col, ip_to_long

_WRAP = 4294967296  # 2^32


def _text_hash(text: Column) -> Column:
    """Base-31 polynomial of the characters modulo 2^32 (ASCII text)."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("bigint"), lambda acc, ch: (acc * 31 + F.ascii(ch)) % _WRAP)


def _signed32(value: Column) -> Column:
    """Wrap a non-negative value to a signed 32-bit number."""
    return (value + 2147483648) % _WRAP - 2147483648


def flow_id_poly17(src: Column | str, dst: Column | str) -> Column:
    """Two rounds of base 17 from the seed 17 over the two text hashes, as a signed 32-bit value."""
    return _signed32((_text_hash(_col(src)) + 289) * 17 + _text_hash(_col(dst)))


def flow_id_objects31(src: Column | str, dst: Column | str) -> Column:
    """Two rounds of base 31 from the seed 1 over the two text hashes, as a signed 32-bit value."""
    return _signed32((_text_hash(_col(src)) + 31) * 31 + _text_hash(_col(dst)))


def flow_id_xor(src: Column | str, dst: Column | str) -> Column:
    """Numeric source XOR destination; both directions of a conversation share it."""
    return ip_to_long(src).bitwiseXOR(ip_to_long(dst))


def flow_id_5tuple_xor(src: Column | str, dst: Column | str, src_port: Column | str,
                       dst_port: Column | str, protocol: Column | str) -> Column:
    """XOR of both addresses, both ports and the protocol number."""
    key = flow_id_xor(src, dst)
    for part in (src_port, dst_port, protocol):
        key = key.bitwiseXOR(_col(part).cast("bigint"))
    return key


def flow_id_pair(src: Column | str, dst: Column | str) -> Column:
    """Source in the high and destination in the low 32 bits: no two pairs collide."""
    return F.shiftleft(ip_to_long(src), 32).bitwiseOR(ip_to_long(dst))


@dataclass(frozen=True)
class FlowKey:
    inputs: tuple[str, ...]
    build: Callable[..., Column]
    # True when the key determines source and destination, so that no two pairs merge.
    determines_pair: bool = False
    # True when only chance makes pairs merge, so that a flow has few of them.
    few_pairs: bool = False

    def column(self) -> Column:
        return self.build(*self.inputs)


PAIR = ("src_ip", "dst_ip")
KEYS: dict[str, FlowKey] = {
    "poly17": FlowKey(PAIR, flow_id_poly17, few_pairs=True),
    "objects31": FlowKey(PAIR, flow_id_objects31, few_pairs=True),
    "xor": FlowKey(PAIR, flow_id_xor),
    "pair": FlowKey(PAIR, flow_id_pair, determines_pair=True, few_pairs=True),
    "five_tuple_xor": FlowKey((*PAIR, "src_port", "dst_port", "protocol"), flow_id_5tuple_xor),
}


def flow_key(key: str | FlowKey) -> FlowKey:
    """Look up a key by name, or pass a custom one through."""
    if isinstance(key, FlowKey):
        return key
    if key not in KEYS:
        raise ValueError(f"unknown flow key {key!r}; choose one of {sorted(KEYS)}")
    return KEYS[key]
