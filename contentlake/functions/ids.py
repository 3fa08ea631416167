"""160-bit ids as 40-digit lower-case hex, with XOR arithmetic on five 32-bit limbs.

Fixed-width lower-case hex sorts like the unsigned big-endian number, so distances are kept as hex
wherever they only need to be compared.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_HEX = 40
LIMBS = 5


def as_id(value: Column | str) -> Column:
    """A literal for a hex string, the column itself otherwise."""
    return F.lit(value) if isinstance(value, str) else value


def to_hex(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def from_hex(text: Column) -> Column:
    return F.unhex(text)


def is_id(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"^[0-9a-fA-F]{40}\z"))


def hex_number(text: Column, start: int, digits: int) -> Column:
    """The number in ``digits`` (at most 8) hex digits from 1-based ``start``."""
    return F.conv(F.substring(text, start, digits), 16, 10).cast("bigint")


def limb(text: Column, i: int) -> Column:
    return hex_number(text, 1 + 8 * i, 8)


def xor_limbs(a: Column | str, b: Column | str) -> Column:
    a, b = as_id(a), as_id(b)
    return F.array(*[limb(a, i).bitwiseXOR(limb(b, i)) for i in range(LIMBS)])


def xor_distance(a: Column | str, b: Column | str) -> Column:
    """XOR of two ids as 40 hex digits."""
    a, b = as_id(a), as_id(b)
    return F.concat(
        *[F.lpad(F.lower(F.hex(limb(a, i).bitwiseXOR(limb(b, i)))), 8, "0") for i in range(LIMBS)]
    )


def first_byte_distance(a: Column | str, b: Column | str) -> Column:
    return hex_number(as_id(a), 1, 2).bitwiseXOR(hex_number(as_id(b), 1, 2))


def distance_share(a: Column | str, b: Column | str) -> Column:
    """The first 64 bits of the distance as a share of 2^64 - 1."""
    a, b = as_id(a), as_id(b)
    high = limb(a, 0).bitwiseXOR(limb(b, 0)).cast("double")
    low = limb(a, 1).bitwiseXOR(limb(b, 1)).cast("double")
    return (high * float(1 << 32) + low) / float((1 << 64) - 1)


def bucket_index(a: Column | str, b: Column | str) -> Column:
    """159 minus the leading zero bits of the distance; 0 for identical ids."""
    a, b = as_id(a), as_id(b)
    out = F.lit(0)
    for i in reversed(range(LIMBS)):
        x = limb(a, i).bitwiseXOR(limb(b, i))
        out = F.when(x > 0, F.length(F.bin(x)) + (127 - 32 * i)).otherwise(out)
    return out.cast("int")


def _is_power_of_two(n: int) -> bool:
    return n & (n - 1) == 0


def partition_of(node_id: Column | str, n: int) -> Column:
    """Key-space partition: the top bits for a power of two, else the scaled first byte."""
    if n < 1:
        raise ValueError("at least one partition is needed")
    node_id = as_id(node_id)
    if _is_power_of_two(n):
        bits = (n - 1).bit_length()
        return F.shiftright(limb(node_id, 0), 32 - bits).cast("int") if bits else F.lit(0)
    scaled = F.floor(hex_number(node_id, 1, 2) * n / 256)
    return F.least(scaled, F.lit(n - 1)).cast("int")


def partition_center(index: Column, n: int) -> Column:
    """The id in the middle of partition ``index``."""
    index = index.cast("bigint")
    if _is_power_of_two(n):
        bits = (n - 1).bit_length()
        if bits <= 8:
            first = F.shiftleft(index, 8 - bits)
            if bits < 8:
                first = first.bitwiseOR(F.lit(1 << (7 - bits)))
            head = F.concat(F.lpad(F.hex(first), 2, "0"), F.lit("00"))
        else:
            # the index fills the top bits, the next bit marks the middle
            middle = F.shiftleft(index, 32 - bits).bitwiseOR(F.lit(1 << (31 - bits)))
            head = F.lpad(F.hex(middle), 8, "0")
    else:
        head = F.concat(F.lpad(F.hex(F.ceil(index * 256 / n).cast("bigint")), 2, "0"), F.lit("80"))
    return F.lower(F.rpad(head, ID_HEX, "80"))


def in_partition(node_id: Column | str, index: Column, n: int) -> Column:
    return (index < n) & (partition_of(node_id, n) == index)
