"""Scalar functions of the archive format as Catalyst expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..dims import BLOCK_EXPONENTS, DICT_LIMIT, ECC_LEVELS


def bits_needed(x: Column) -> Column:
    """Number of binary digits of a positive integer."""
    return F.length(F.bin(x))


def ceil_div(x: Column, by) -> Column:
    by = F.lit(by) if not isinstance(by, Column) else by
    return idiv(x + by - 1, by)


def idiv(a: Column, b) -> Column:
    """Integer division of non-negative integers."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def ceil_log2(x: Column) -> Column:
    """Least e with 2**e >= x, for x >= 1."""
    return F.when(x <= 1, F.lit(0)).otherwise(bits_needed(x - 1))


def is_power_of_two(x: Column) -> Column:
    return (x > 0) & (x.bitwiseAND(x - 1) == 0)


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def trailing_zeros(x: Column) -> Column:
    """Trailing zero bits of a positive integer."""
    return F.bit_count(x.bitwiseAND(-x) - 1)


def block_exponent_from_count(size: Column, count: Column) -> Column:
    """Exponent of the least power of two, 2**16 to 2**62, with which ``size`` makes ``count`` blocks; null for count 0."""
    each = ceil_div(size, count)
    found = F.when(each <= 1 << BLOCK_EXPONENTS[0], F.lit(BLOCK_EXPONENTS[0])).otherwise(F.least(ceil_log2(each), F.lit(BLOCK_EXPONENTS[1])))
    return F.when(count > 0, found)


def default_block_exponent(size: Column, dict_exp: Column) -> Column:
    """The dictionary's exponent; for more than 256 MiB one more, up to 30."""
    return F.when(size > 256 << 20, F.least(dict_exp + 1, F.lit(30))).otherwise(dict_exp)


def dict_size(exponent: Column) -> Column:
    return F.least(F.call_function("shiftleft", F.lit(1).cast("long"), exponent.cast("int")), F.lit(DICT_LIMIT).cast("long"))


def round_up_16(x: Column) -> Column:
    return (x + 15).bitwiseAND(~15)


def props_byte(lc: Column, lp: Column, pb: Column) -> Column:
    return (pb * 5 + lp) * 9 + lc


def props_parts(byte: Column) -> tuple[Column, Column, Column]:
    """lc, lp, pb of a properties byte."""
    return byte % 9, idiv(byte, 9) % 5, idiv(byte, 45)


def ecc_expanded(size: Column, level: Column) -> Column:
    """Stored bytes of a payload at an ECC level of 0 to 3."""
    out = size
    for _, bits, k, _ in ECC_LEVELS[1:]:
        out = F.when(level == bits, ceil_div(size, k) * 255).otherwise(out)
    return out


def raw_header_size(size: Column) -> Column:
    """Header bytes of a raw chunk: two near 65536, else three."""
    return F.when(F.abs(size - 65536) <= 8191, F.lit(2)).otherwise(F.lit(3))


def coded_header_size(coded: Column) -> Column:
    """Header bytes of a coded chunk: four from 65281 coded bytes on, else five."""
    return F.when(coded > 65280, F.lit(4)).otherwise(F.lit(5))


def raw_payload_size(size: Column) -> Column:
    """Payload of a block stored as raw chunks of 64 KiB, with the end mark."""
    whole, rest = idiv(size, 65536), size % 65536
    return whole * (65536 + 2) + F.when(rest > 0, rest + raw_header_size(rest)).otherwise(F.lit(0)) + 1


def format_size(size: Column) -> Column:
    """Bytes with a binary unit and three figures or so; exact halves go to the even last figure.

    A value shown with d decimals is ``size * 10**d / 2**k``, rounded as the
    binary value is: by the exact remainder, never by way of decimal text.  Unit
    and decimals come first, so that one division and one rounding are left; all
    of it stays within 64 bits.
    """
    units = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]
    unit = F.least(idiv(bits_needed(F.greatest(size, F.lit(1))) - 1, 10), F.lit(len(units) - 1)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), unit * 10)
    decimals = F.when(unit == 0, 0).otherwise(2 - (size >= one * 10).cast("int") - (size >= one * 100).cast("int"))
    by = F.element_at(F.array(*(F.lit(10**d).cast("long") for d in range(3))), decimals + 1)
    scaled = size * by
    low, rest = F.call_function("shiftright", scaled, unit * 10), scaled.bitwiseAND(one - 1)
    up = (rest * 2 > one) | ((rest * 2 == one) & (low.bitwiseAND(F.lit(1).cast("long")) == 1))
    number = low + F.when(up, 1).otherwise(0)
    digits = F.lpad((number % by).cast("string"), decimals, F.lit("0"))
    text = F.concat(idiv(number, by).cast("string"), F.when(decimals > 0, F.concat(F.lit("."), digits)).otherwise(F.lit("")))
    return F.concat(text, F.lit(" "), F.element_at(F.array(*map(F.lit, units)), unit + 1))


def ratio_percent(packed: Column, original: Column) -> Column:
    return F.when(original > 0, packed.cast("double") * 100.0 / original.cast("double")).otherwise(F.lit(0.0))


def space_label(packed: Column, original: Column) -> Column:
    """``saved`` where packing made the data smaller or left it, else ``overhead``."""
    return F.when(packed <= original, F.lit("saved")).otherwise(F.lit("overhead"))


def mib_per_second(size: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, size.cast("double") / 1048576.0 / seconds).otherwise(F.lit(0.0))


def dist_slot(distance: Column) -> Column:
    """LZMA's bucket of a match distance: the distance itself up to 3, then twice the
    position of its highest bit, and the next bit."""
    top = bits_needed(distance) - 1
    second = F.call_function("shiftright", distance, (top - 1).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    return F.when(distance < 4, distance).otherwise(top * 2 + second)


def dist_state(length: Column) -> Column:
    return F.when(length < 6, length - 2).otherwise(F.lit(3))


def window_buffer_size(dict_size_: Column, before: int, after: int, longest: int) -> Column:
    """Bytes of the encoder's window: what is kept before and after, and a reserve of half the dictionary and 512 KiB, at most 512 MiB and so."""
    reserve = F.least(idiv(dict_size_, 2) + (512 << 10), F.lit(512 << 20).cast("long"))
    return dict_size_ + before + after + longest + reserve


def output_name(name: Column, unpack: bool, suffix: str = ".sba") -> Column:
    """Where an archive goes: a suffix more, or on unpacking a suffix less (without it: .extracted)."""
    if not unpack:
        return F.concat(name, F.lit(suffix))
    cut = F.substr(name, F.lit(1), F.length(name) - len(suffix))
    return F.when(name.endswith(suffix), cut).otherwise(F.concat(name, F.lit(".extracted")))
