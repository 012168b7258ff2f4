"""IPv4 addresses as text and as unsigned numbers held in a bigint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ip_to_long(address: Column | str) -> Column:
    """Dotted quad to its big-endian number."""
    octets = F.split(_col(address), "[.]")
    return F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o.cast("bigint"))


def ip_to_string(number: Column | str) -> Column:
    """Big-endian number to a dotted quad."""
    n = _col(number)
    return F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def ip_from_saddr(raw: Column | str) -> Column:
    """Number whose lowest byte is the first octet (an address field printed by a
    little-endian host) to a dotted quad."""
    n = _col(raw)
    return F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(255).cast("string") for s in (0, 8, 16, 24)])


def saddr_from_ip(address: Column | str) -> Column:
    """Inverse of `ip_from_saddr`."""
    octets = F.reverse(F.split(_col(address), "[.]"))
    return F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o.cast("bigint"))
