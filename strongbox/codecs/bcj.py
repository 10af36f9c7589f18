"""Reversible branch-address filters over whole blocks; addresses start at 0 in each block.

Fixed-width instruction sets are done as numpy words; x86, Thumb and IA-64 by
liblzma, whose filters these are: backwards a filter alone is what remains when
liblzma reads chunks that are stored plain, and forwards when it codes with the
filter, as quickly as it can, and decodes without it.  RISC-V, whose instruction
width varies, is done by a walk over its candidate bytes.
"""

from __future__ import annotations

import lzma

import numpy as np

_U = np.uint32
_LIBRARY = {1: lzma.FILTER_X86, 3: lzma.FILTER_ARMTHUMB, 7: lzma.FILTER_IA64}
_PLAIN = {"id": lzma.FILTER_LZMA2, "dict_size": 1 << 16, "mode": lzma.MODE_FAST, "mf": lzma.MF_HC3, "nice_len": 273, "depth": 1}
_CHUNK = 1 << 16


def _stored(data: bytes) -> bytes:
    """LZMA2 chunks that hold the data as it is; the first resets the dictionary."""
    parts = [data[k : k + _CHUNK] for k in range(0, len(data), _CHUNK)]
    return b"".join(bytes([1 if k == 0 else 2]) + (len(p) - 1).to_bytes(2, "big") + p for k, p in enumerate(parts)) + b"\0"


def _by_library(data: bytes, filter_id: int, encode: bool) -> bytes:
    if filter_id == lzma.FILTER_X86 and b"\xe8" not in data and b"\xe9" not in data:
        return data  # no call and no jump
    with_, without = [{"id": filter_id}, _PLAIN], [_PLAIN]
    if not encode:
        return lzma.decompress(_stored(data), lzma.FORMAT_RAW, filters=with_)
    return lzma.decompress(lzma.compress(data, lzma.FORMAT_RAW, filters=with_), lzma.FORMAT_RAW, filters=without)


def _shift(address: np.ndarray, move: np.ndarray, encode: bool) -> np.ndarray:
    return address + move if encode else address - move


def arm(w: np.ndarray, place: np.ndarray, encode: bool) -> np.ndarray:
    """Branch with link: top byte EB, 24 bits of word address relative to place + 8."""
    hit = w >> _U(24) == 0xEB
    to = _shift(w << _U(2), place + _U(8), encode) >> _U(2)
    return np.where(hit, _U(0xEB000000) | to & _U(0xFFFFFF), w)


def powerpc(w: np.ndarray, place: np.ndarray, encode: bool) -> np.ndarray:
    """Branch and link, relative: opcode 18, last bits 01, 26 bits of byte address."""
    hit = w & _U(0xFC000003) == 0x48000001
    to = _shift(w & _U(0x03FFFFFC), place, encode)
    return np.where(hit, _U(0x48000001) | to & _U(0x03FFFFFC), w)


def sparc(w: np.ndarray, place: np.ndarray, encode: bool) -> np.ndarray:
    """Call: 01 and 30 bits, of which the upper eight repeat the sign of the other 22."""
    top = w >> _U(22)
    hit = (top == 0x100) | (top == 0x1FF)
    to = _shift(w << _U(2), place, encode) >> _U(2)
    sign = to >> _U(22) & _U(1)
    return np.where(hit, _U(0x40000000) | sign * _U(0x3FC00000) | to & _U(0x3FFFFF), w)


def arm64(w: np.ndarray, place: np.ndarray, encode: bool) -> np.ndarray:
    """BL (26-bit word address) and ADRP (page address within 512 MiB either way)."""
    branch = w >> _U(26) == 0x25
    to = _U(0x94000000) | _shift(w, place >> _U(2), encode) & _U(0x03FFFFFF)
    page = w >> _U(29) & _U(3) | w >> _U(3) & _U(0x1FFFFC)
    near = (w & _U(0x9F000000) == 0x90000000) & (page + _U(0x20000) & _U(0x1C0000) == 0)
    moved = _shift(page, place >> _U(12), encode)
    paged = _U(0x90000000) | w & _U(0x1F) | (moved & _U(3)) << _U(29) | (moved & _U(0x3FFFC)) << _U(3)
    paged = paged | (_U(0) - (moved & _U(0x20000))) & _U(0xE00000)
    return np.where(branch, to, np.where(near, paged, w))


_WORDS = {2: (arm, "<u4"), 4: (arm64, "<u4"), 5: (sparc, ">u4"), 6: (powerpc, ">u4")}


def word_rule(kind: int):
    """The function (words, places, encode) of a prefilter of fixed-width words."""
    return _WORDS[kind][0]


def _by_words(data: bytes, kind: int, encode: bool) -> bytes:
    rule, order = _WORDS[kind]
    whole = len(data) // 4 * 4
    words = np.frombuffer(data, order, whole // 4).astype(_U)
    with np.errstate(over="ignore"):
        out = rule(words, np.arange(0, whole, 4).astype(_U), encode)
    return out.astype(order).tobytes() + data[whole:]


def _signed(x: int) -> int:
    x &= 0xFFFFFFFF
    return x - (1 << 32) if x >> 31 else x


def _jal_address(word: int) -> int:
    """The 20 address bits that a JAL instruction scatters, in place (bit 0 is 0)."""
    return (word >> 12 & 0xFF) << 12 | (word >> 20 & 1) << 11 | (word >> 21 & 0x3FF) << 1 | (word >> 31) << 20


def _jal_word(low12: int, address: int) -> int:
    return low12 | (address >> 12 & 0xFF) << 12 | (address >> 11 & 1) << 20 | (address >> 1 & 0x3FF) << 21 | (address >> 20 & 1) << 31


def riscv(data: bytes, encode: bool) -> bytes:
    """JAL to x1 or x5, and AUIPC with the instruction behind it that uses its register.

    A filtered pair starts with an AUIPC to x2 that holds the second instruction's
    low 20 bits, then the absolute address, big endian; an AUIPC to x2 (or to x0)
    that stood in the data already is rewritten so that it can be told apart.
    """
    buf = bytearray(data)
    read = lambda at: int.from_bytes(buf[at : at + 4], "little")
    first_bytes, after = np.frombuffer(data, np.uint8)[: max(len(data) - 7, 0) : 2], 0
    # what is rewritten lies behind the next place, so the candidates are those of the data as it came
    for i in (2 * np.flatnonzero((first_bytes == 0xEF) | (first_bytes & 0x7F == 0x17))).tolist():
        if i < after:
            continue
        if buf[i] == 0xEF:
            if buf[i + 1] & 0x0D:
                continue
            word, after = read(i), i + 4
            if encode:
                to = _jal_address(word) + i
                # stored with the address bits in order, high bits first
                buf[i + 1] = buf[i + 1] & 0x0F | to >> 13 & 0xF0
                buf[i + 2], buf[i + 3] = to >> 9 & 0xFF, to >> 1 & 0xFF
            else:
                to = ((buf[i + 1] & 0xF0) << 13 | buf[i + 2] << 9 | buf[i + 3] << 1) - i
                buf[i : i + 4] = _jal_word(word & 0xFFF, to).to_bytes(4, "little")
            continue
        first, second = read(i), read(i + 4)
        if first & 0xE80:
            if ((first << 8) ^ second) & 0xF8003 != 3:
                after = i + 6
                continue
            head = 0x117 | second << 12 & 0xFFFFF000
            upper = first & 0xFFFFF000
            if encode:
                tail = (upper + (_signed(second) >> 20) + i & 0xFFFFFFFF).to_bytes(4, "big")
            else:
                tail = (upper + (second >> 20) & 0xFFFFFFFF).to_bytes(4, "little")
        else:
            register = first >> 27
            if (first - 0x3100) & 0x3F80 >= register & 0x1D:
                after = i + 4
                continue
            if encode:
                head = 0x17 | register << 7 | second & 0xFFFFF000
                tail = (first >> 12 | second << 20 & 0xFFFFFFFF).to_bytes(4, "little")
            else:
                to = int.from_bytes(buf[i + 4 : i + 8], "big") - i
                head = 0x17 | register << 7 | to + 0x800 & 0xFFFFF000
                tail = (first >> 12 | to << 20 & 0xFFFFFFFF).to_bytes(4, "little")
        buf[i : i + 4] = head.to_bytes(4, "little")
        buf[i + 4 : i + 8] = tail
        after = i + 8
    return bytes(buf)


def apply(data: bytes, prefilter: int, encode: bool) -> bytes:
    """A block through prefilter 0 to 8 (see dims.PREFILTERS), forwards or back."""
    if prefilter == 0 or not data:
        return data
    if prefilter in _WORDS:
        return _by_words(data, prefilter, encode)
    if prefilter in _LIBRARY:
        return _by_library(data, _LIBRARY[prefilter], encode)
    if prefilter == 8:
        return riscv(data, encode)
    raise ValueError(f"no prefilter {prefilter}")
