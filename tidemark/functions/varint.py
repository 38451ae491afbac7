"""LEB128 integers: seven bits a byte, low bits first, the high bit set where more follow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BITS = {32: 5, 64: 10}


class DecodeError(ValueError):
    """Bytes that end too early, or that hold more than fits."""


def encode(value: int, bits: int = 64) -> bytes:
    if not 0 <= value < 1 << bits:
        raise ValueError(f"{value} does not fit in {bits} bits")
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def decode(data: bytes, at: int = 0, bits: int = 64) -> tuple[int, int]:
    """(value, bytes consumed) of the integer at a place."""
    value = 0
    for n in range(MAX_BITS[bits]):
        if at + n >= len(data):
            raise DecodeError("the bytes end within an integer")
        byte = data[at + n]
        value |= (byte & 0x7F) << (7 * n)
        if byte < 0x80:
            if value >> bits:
                raise DecodeError(f"the integer exceeds {bits} bits")
            return value, n + 1
    raise DecodeError(f"the integer exceeds {bits} bits")


def decode_canonical(data: bytes, at: int = 0, bits: int = 64) -> tuple[int, int]:
    """As decode, but a padded form is an error."""
    value, used = decode(data, at, bits)
    if len(encode(value, bits)) != used:
        raise DecodeError("the integer is padded")
    return value, used


def length(value: Column) -> Column:
    """Bytes of a BIGINT's encoding; a negative one is read as unsigned and takes ten."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 7)).cast("int")


def encoded(value: Column) -> Column:
    """The encoding of a BIGINT as BINARY, by expressions alone."""
    size = length(value)

    def group(i: Column) -> Column:
        low = F.call_function("shiftrightunsigned", value, (i * 7).cast("int")).bitwiseAND(F.lit(0x7F))
        return F.lpad(F.hex(low + F.when(i < size - 1, 0x80).otherwise(0)), 2, "0")

    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), size - 1), group), ""))


def decoded(data: Column, bits: int = 64, canonical: bool = False) -> Column:
    """Struct (value, size) of the integer at the start of a BINARY column, by expressions alone; null where ``decode`` raises.

    A value of 64 bits is the BIGINT of the same bits.  With ``canonical`` a padded form is null too.
    """
    most = MAX_BITS[bits]
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(data), F.lit(most))))
    octets = F.transform(places, lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))
    size = F.array_position(F.transform(octets, lambda b: b < 0x80), F.lit(True)).cast("int")
    own = F.slice(octets, F.lit(1), F.greatest(size, F.lit(1)))
    value = F.aggregate(
        F.transform(own, lambda b, i: F.call_function("shiftleft", b.bitwiseAND(F.lit(0x7F)), (i * 7).cast("int"))),
        F.lit(0).cast("long"),
        lambda x, y: x.bitwiseOR(y),
    )
    last = F.element_at(own, -1)
    # what the last byte of the longest form may hold
    fits = (size < most) | (last < 1 << (bits - 7 * (most - 1)))
    fits = fits & ((size == 1) | (last != 0)) if canonical else fits
    return F.when((F.length(data) > 0) & (size > 0) & fits, F.struct(value.alias("value"), size.alias("size")))
