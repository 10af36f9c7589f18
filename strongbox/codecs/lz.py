"""LZMA payloads in their own chunk framing, by way of liblzma.

The chunks' payloads are plain LZMA; only their headers differ from LZMA2's, so
headers are translated and liblzma does the coding.

First byte of a chunk, then big-endian bytes: 00 end; 001 raw, 21-bit size - 1;
010 coded, 21-bit size - 1, 16-bit coded size - 1; 011 coded, 21-bit size - 1,
8 bits below 65536; 1s raw, 14 bits above (s=0) or below 65536.
"""

from __future__ import annotations

import lzma
from collections.abc import Iterator

from ..dims import Options

RAW, CODED = "raw", "coded"
NEAR = 65536


class FormatError(ValueError):
    pass


def raw_header(size: int) -> bytes:
    gap = size - NEAR
    if abs(gap) <= 8191:
        return (0x8000 | (0x4000 if gap < 0 else 0) | abs(gap)).to_bytes(2, "big")
    return (0x200000 | size - 1).to_bytes(3, "big")


def coded_header(size: int, coded: int) -> bytes:
    if coded > 65280:
        return (0x600000 | size - 1).to_bytes(3, "big") + bytes([NEAR - coded])
    return (0x400000 | size - 1).to_bytes(3, "big") + (coded - 1).to_bytes(2, "big")


def chunks(payload: bytes) -> Iterator[tuple[str, int, int, int]]:
    """(kind, size, coded size, place of its bytes) of each chunk up to the end mark."""
    at = 0
    while True:
        if at >= len(payload):
            raise FormatError("no end mark")
        b = payload[at]
        if b == 0:
            return
        if b & 0x80:
            gap = int.from_bytes(payload[at : at + 2], "big") & 0x3FFF
            kind, size, head = RAW, NEAR - gap if b & 0x40 else NEAR + gap, 2
            stored = size
        elif b >> 5 == 1:
            size = (int.from_bytes(payload[at : at + 3], "big") & 0x1FFFFF) + 1
            kind, stored, head = RAW, size, 3
        elif b >> 5 == 2:
            size = (int.from_bytes(payload[at : at + 3], "big") & 0x1FFFFF) + 1
            kind, stored, head = CODED, int.from_bytes(payload[at + 3 : at + 5], "big") + 1, 5
        elif b >> 5 == 3:
            size = (int.from_bytes(payload[at : at + 3], "big") & 0x1FFFFF) + 1
            kind, stored, head = CODED, NEAR - payload[at + 3] if at + 3 < len(payload) else 0, 4
        else:
            raise FormatError("bad control byte")
        if at + head + stored > len(payload):
            raise FormatError("chunk leaves the payload")
        if kind == CODED and (stored < 5 or payload[at + head] != 0):
            raise FormatError("bad range coder start")
        yield kind, size, stored, at + head
        at += head + stored


def _filters(o: Options, length: int | None) -> list[dict]:
    size = min(1 << o.dict_exp, 0xFFFFFFF0)
    if length is not None:  # a smaller search window decodes under a larger declared one
        size = min(size, max(1 << 12, 1 << max(length - 1, 1).bit_length()))
    size = min(size, 1536 << 20)
    return [{
        "id": lzma.FILTER_LZMA2, "dict_size": size, "lc": o.lc, "lp": o.lp, "pb": o.pb,
        "mode": lzma.MODE_FAST if o.fast else lzma.MODE_NORMAL, "mf": lzma.MF_HC4 if o.fast else lzma.MF_BT4,
        "nice_len": max(o.nice, 4), "depth": o.depth,
    }]


def compress(data: bytes, o: Options) -> bytes:
    """A payload of chunks with its end mark; raw chunks where liblzma refuses the settings."""
    if o.lc + o.lp > 4:
        return store(data)
    if not data:
        return b"\0"
    coded = lzma.compress(data, lzma.FORMAT_RAW, filters=_filters(o, len(data)))
    out, at, before = [], 0, None
    while coded[at]:
        control = coded[at]
        if control < 0x80:
            size = int.from_bytes(coded[at + 1 : at + 3], "big") + 1
            out.append(raw_header(size) + coded[at + 3 : at + 3 + size])
            at, before = at + 3 + size, RAW
        else:
            size = ((control & 0x1F) << 16) + int.from_bytes(coded[at + 1 : at + 3], "big") + 1
            stored = int.from_bytes(coded[at + 3 : at + 5], "big") + 1
            reset = control >> 5 & 3
            if (reset > 0) != (before in (None, RAW)):
                raise FormatError("state reset out of place")
            head = 6 if reset >= 2 else 5
            out.append(coded_header(size, stored) + coded[at + head : at + head + stored])
            at, before = at + head + stored, CODED
    return b"".join(out) + b"\0"


def store(data: bytes) -> bytes:
    """A payload of raw chunks only."""
    step = 1 << 16
    return b"".join(raw_header(len(p)) + p for p in (data[k : k + step] for k in range(0, len(data), step))) + b"\0"


def decompress(payload: bytes, o: Options) -> bytes:
    """The data of a payload; bytes behind the end mark are ignored."""
    found = list(chunks(payload))
    if all(kind == RAW for kind, *_ in found):
        return b"".join(payload[at : at + size] for _, size, _, at in found)
    out, before, coded_before = [], None, False
    for kind, size, stored, at in found:
        if kind == RAW:
            for k in range(0, size, NEAR):
                part = payload[at + k : at + min(size, k + NEAR)]
                out.append(bytes([1 if before is None else 2]) + (len(part) - 1).to_bytes(2, "big") + part)
                before = RAW
        else:
            reset = 3 if before is None else 2 if not coded_before else 1 if before == RAW else 0
            head = bytes([0x80 | reset << 5 | (size - 1) >> 16]) + ((size - 1) & 0xFFFF).to_bytes(2, "big") + (stored - 1).to_bytes(2, "big")
            if reset >= 2:
                head += bytes([(o.pb * 5 + o.lp) * 9 + o.lc])
            out.append(head + payload[at : at + stored])
            before, coded_before = CODED, True
    if o.lc + o.lp > 4 and coded_before:
        from .lz_slow import decompress_slow

        return decompress_slow(payload, o)
    decoder = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=_filters(o, None))
    try:
        data = decoder.decompress(b"".join(out) + b"\0")
    except lzma.LZMAError as e:
        raise FormatError(str(e)) from e
    if not decoder.eof:
        raise FormatError("payload ends early")
    return data
