"""Binary records of the archive format as Catalyst expressions: parse and build.

Unsigned 64-bit fields carry flags in their two top bits, so they are read as
two 32-bit halves and masked before they become a BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalars import props_byte, props_parts


def be_int(record: Column, at: int, size: int) -> Column:
    """Big-endian unsigned integer of up to 7 bytes at a zero-based place of a BINARY."""
    return F.conv(F.hex(F.substring(record, at + 1, size)), 16, 10).cast("long")


def be_hex(value: Column, size: int) -> Column:
    """The low ``size`` bytes of a non-negative BIGINT as lower-case hexadecimal."""
    return F.lower(F.right(F.concat(F.lit("0" * 2 * size), F.hex(value)), F.lit(2 * size)))


def hex_of(record: Column) -> Column:
    return F.lower(F.hex(record))


def flagged_size(record: Column, at: int = 0) -> tuple[Column, Column, Column]:
    """Top bit, second bit and low 62 bits of an eight-byte field."""
    high, low = be_int(record, at, 4), be_int(record, at + 4, 4)
    top = F.call_function("shiftright", high, F.lit(31)).bitwiseAND(1)
    second = F.call_function("shiftright", high, F.lit(30)).bitwiseAND(1)
    size = F.call_function("shiftleft", high.bitwiseAND(0x3FFFFFFF), F.lit(32)).bitwiseOR(low)
    return top, second, size


def header_hex(options: dict[str, Column]) -> Column:
    """First ten bytes of a file header (its parity follows) from the option columns."""
    fields = [options["ecc"], options["prefilter"], options["block_exp"], props_byte(options["lc"], options["lp"], options["pb"]), options["dict_exp"]]
    return F.concat(F.lit("fedcba9801"), *(be_hex(f.cast("long"), 1) for f in fields))


def header_fields(record: Column) -> dict[str, Column]:
    lc, lp, pb = props_parts(be_int(record, 8, 1))
    return {
        "version": be_int(record, 4, 1), "ecc": be_int(record, 5, 1).bitwiseAND(3), "prefilter": be_int(record, 6, 1),
        "block_exp": be_int(record, 7, 1), "lc": lc, "lp": lp, "pb": pb, "dict_exp": be_int(record, 9, 1),
    }


def header_status(record: Column) -> Column:
    """``ok`` or the first rule that a file header breaks."""
    byte = lambda at: be_int(record, at, 1)
    return (
        F.when(F.octet_length(record) < 10, "truncated")
        .when(hex_of(F.substring(record, 1, 4)) != "fedcba98", "magic")
        .when(byte(4) != 1, "version")
        .when(byte(5).bitwiseAND(0xFC) != 0, "reserved")
        .when(byte(6) > 8, "prefilter")
        .when(~byte(7).between(16, 62), "block_exp")
        .when(byte(8) > 224, "props")
        .when(~byte(9).between(16, 31), "dict_exp")
        .otherwise("ok")
    )


def block_size_hex(physical: Column, partial: Column) -> Column:
    """Size field of a block header."""
    field = physical.bitwiseAND((1 << 62) - 1)
    return be_hex(F.when(partial, field.bitwiseOR(1 << 62)).otherwise(field), 8)


def trailer_size_hex(size: Column) -> Column:
    """Size field of a trailer: the top bit is set, by its halves as it leaves BIGINT."""
    high = F.call_function("shiftright", size, F.lit(32)).bitwiseAND(0x7FFFFFFF).bitwiseOR(0x80000000)
    return F.concat(be_hex(high, 4), be_hex(size.bitwiseAND(0xFFFFFFFF), 4))
