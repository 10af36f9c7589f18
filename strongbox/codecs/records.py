"""The archive's fixed records with their parity: file header, block header, trailer."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from ..dims import BLOCK_HEADER_SIZE, ECC_LEVELS, HEADER_SIZE, MAGIC, VERSION, Options
from . import rs

_PARTIAL, _TRAILER, _LOW = 1 << 62, 1 << 63, (1 << 62) - 1


def with_parity(data: list[bytes], n: int) -> list[bytes]:
    """Records of n bytes: the data (all of one length), then its parity."""
    if not data:
        return []
    rows = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)
    raw = np.hstack([rows, rs.encode(rows, n, rows.shape[1])]).tobytes()
    return [raw[at : at + n] for at in range(0, len(raw), n)]


def _with_parity(data: bytes, n: int) -> bytes:
    return with_parity([data], n)[0]


def _corrected(records: list[bytes], n: int, k: int) -> list[tuple[bytes, int]]:
    """Of each record its data bytes and how many bytes were put right; -1: beyond repair, or cut short."""
    whole = [r[:n] for r in records if len(r) >= n]
    words, changed = rs.decode(np.frombuffer(b"".join(whole), np.uint8).reshape(-1, n), n, k)
    raw = words[:, :k].tobytes()
    found = iter([(raw[at * k : at * k + k], c) for at, c in enumerate(changed.tolist())])
    return [next(found) if len(r) >= n else (r[:k], -1) for r in records]


@lru_cache(1024)  # archives of a batch mostly have one header
def header(o: Options) -> bytes:
    data = MAGIC + bytes([VERSION, o.ecc, o.prefilter, o.block_exp, (o.pb * 5 + o.lp) * 9 + o.lc, o.dict_exp])
    return _with_parity(data, HEADER_SIZE)


def parse_headers(records: list[bytes], validate: bool = True) -> list[tuple[Options | None, str, int]]:
    """Options (None if unusable), status, bytes corrected of each; checks in the format's order."""
    data = _corrected(records, 32, 10) if validate else [(r[:10], 0) for r in records]
    return [_header_of(d, changed) if len(r) >= HEADER_SIZE else (None, "truncated", 0) for r, (d, changed) in zip(records, data, strict=True)]


def parse_header(record: bytes, validate: bool = True) -> tuple[Options | None, str, int]:
    return parse_headers([record], validate)[0]


@lru_cache(1024)
def _header_of(data: bytes, changed: int) -> tuple[Options | None, str, int]:
    if changed < 0:
        return None, "header_uncorrectable", 0
    checks = (
        ("magic", data[:4] == MAGIC), ("version", data[4] == VERSION), ("reserved", data[5] & 0xFC == 0), ("prefilter", data[6] <= 8),
        ("block_exp", 16 <= data[7] <= 62), ("props", data[8] <= 224), ("dict_exp", 16 <= data[9] <= 31),
    )
    for name, holds in checks:
        if not holds:
            return None, name, changed
    lc, lp, pb = data[8] % 9, data[8] // 9 % 5, data[8] // 45
    return Options(ecc=data[5], prefilter=data[6], block_exp=data[7], lc=lc, lp=lp, pb=pb, dict_exp=data[9]), "ok", changed


def _block_data(physical: int, partial: bool, cv: bytes) -> bytes:
    return (physical & _LOW | (_PARTIAL if partial else 0)).to_bytes(8, "big") + cv


def _trailer_data(size: int, root: bytes) -> bytes:
    return (size & ~_TRAILER | _TRAILER).to_bytes(8, "big") + root


def block_headers(blocks: list[tuple[int, bool, bytes]]) -> list[bytes]:
    """Of (physical size, partial, chaining value) each."""
    return with_parity([_block_data(*b) for b in blocks], BLOCK_HEADER_SIZE)


def trailers(ends: list[tuple[int, bytes]]) -> list[bytes]:
    """Of (size, root hash) each."""
    return with_parity([_trailer_data(*e) for e in ends], BLOCK_HEADER_SIZE)


def block_header(physical: int, partial: bool, cv: bytes) -> bytes:
    return block_headers([(physical, partial, cv)])[0]


def trailer(size: int, root: bytes) -> bytes:
    return trailers([(size, root)])[0]


@dataclass(frozen=True)
class Record:
    """A block header or trailer: ``size`` is the payload's or the whole data's; ``value`` its hash."""

    is_trailer: bool
    partial: bool
    size: int
    value: bytes
    corrected: int


def record_data(r: Record) -> bytes:
    return _trailer_data(r.size, r.value) if r.is_trailer else _block_data(r.size, r.partial, r.value)


def parse_records(records: list[bytes], validate: bool = True) -> list[Record | None]:
    """None: beyond repair or cut short.  Parity is applied before the kind is told."""
    data = _corrected(records, 64, 40) if validate else [(r[:40], 0 if len(r) >= 64 else -1) for r in records]
    return [_record_of(d, changed) if changed >= 0 else None for d, changed in data]


def parse_record(record: bytes, validate: bool = True) -> Record | None:
    return parse_records([record], validate)[0]


def _record_of(data: bytes, changed: int) -> Record:
    field = int.from_bytes(data[:8], "big")
    if field & _TRAILER:
        return Record(True, False, field & ~_TRAILER, data[8:], changed)
    return Record(False, bool(field & _PARTIAL), field & _LOW, data[8:], changed)


def level(ecc: int) -> tuple[int, int] | None:
    """Data and parity bytes of an ECC level; None for none."""
    _, _, k, parity = ECC_LEVELS[ecc]
    return None if k is None else (k, parity)
