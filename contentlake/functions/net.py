"""IPv4 addresses as 32-bit numbers in BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (network, mask) of private and loopback ranges.
PRIVATE_RANGES = (
    (0x0A000000, 0xFF000000),
    (0xC0A80000, 0xFFFF0000),
    (0xAC100000, 0xFFF00000),
    (0x7F000000, 0xFF000000),
)
BROADCAST = 0xFFFFFFFF


def is_routable(ip: Column, port: Column) -> Column:
    """The rule for compact lists and caches: no zero or broadcast address, no port 0."""
    return (ip != 0) & (ip != BROADCAST) & (port != 0)


def is_public_peer(ip: Column, port: Column) -> Column:
    """Drops zero, private and loopback addresses and port 0."""
    ok = (ip != 0) & (port != 0)
    for network, mask in PRIVATE_RANGES:
        ok = ok & (ip.bitwiseAND(F.lit(mask)) != network)
    return ok


def dotted(ip: Column) -> Column:
    parts = [F.shiftright(ip, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *parts)
