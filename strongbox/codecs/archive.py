"""Whole archives as bytes: encode and decode blocks, walk, repair, append, damage."""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np

from ..dims import BLOCK_HEADER_SIZE, CODEWORD, HEADER_SIZE, Options
from . import bcj, blake, lz, records, rs


def encode_payloads(blocks: list[bytes], o: Options, raw: bool = False) -> list[bytes]:
    filtered = [bcj.apply(b, o.prefilter, True) for b in blocks]
    return rs.protect_many([lz.store(f) if raw else lz.compress(f, o) for f in filtered], records.level(o.ecc))


def encode_payload(data: bytes, o: Options, raw: bool = False) -> bytes:
    return encode_payloads([data], o, raw)[0]


def decode_payloads(payloads: list[tuple[bytes, Options]], validate: bool = True) -> list[tuple[bytes | None, str, int]]:
    """Of each payload data (None if lost), status, bytes corrected.  Never raises.

    The codewords of all payloads of a level are corrected together.
    """
    plain: list[tuple[bytes, int, int]] = [(b"", 0, 0)] * len(payloads)
    for ecc in {o.ecc for _, o in payloads}:
        own = [k for k, (_, o) in enumerate(payloads) if o.ecc == ecc]
        for k, found in zip(own, rs.unprotect_many([payloads[k][0] for k in own], records.level(ecc), validate), strict=True):
            plain[k] = found
    out: list[tuple[bytes | None, str, int]] = []
    for (data, corrected, lost), (_, o) in zip(plain, payloads, strict=True):
        try:
            out.append((bcj.apply(lz.decompress(data, o), o.prefilter, False), "ok", corrected))
        except (lz.FormatError, MemoryError, ValueError) as e:
            out.append((None, "payload_uncorrectable" if lost else f"payload: {e}", corrected))
    return out


def decode_payload(payload: bytes, o: Options, validate: bool = True) -> tuple[bytes | None, str, int]:
    return decode_payloads([(payload, o)], validate)[0]


def split(data: bytes, o: Options) -> list[bytes]:
    unit = 1 << o.block_exp
    return [data[k : k + unit] for k in range(0, len(data), unit)] if data else []


def pack_many(datas: list[bytes], o: Options, raw: bool = False) -> list[bytes]:
    """An archive of each; no data gives no block.  Blocks of all are coded and hashed together."""
    blocks, unit, head = [split(d, o) for d in datas], 1 << o.block_exp, records.header(o)
    flat = [b for own in blocks for b in own]
    payloads = encode_payloads(flat, o, raw)
    values = blake.block_values([(b, k * unit, len(own) == 1) for own in blocks for k, b in enumerate(own)])
    heads = records.block_headers([(len(p), len(b) < unit, v) for b, p, v in zip(flat, payloads, values, strict=True)])
    parts, held = (iter([h + p for h, p in zip(heads, payloads, strict=True)]), iter(values))
    roots = blake.roots_of([[next(held) for _ in own] for own in blocks])
    ends = records.trailers([(len(d), r) for d, r in zip(datas, roots, strict=True)])
    return [b"".join([head, *(next(parts) for _ in own), end]) for own, end in zip(blocks, ends, strict=True)]


def pack(data: bytes, o: Options, raw: bool = False) -> bytes:
    return pack_many([data], o, raw)[0]


class BlockWriter:
    """One block of an archive: data up to the block's size, then its header and payload."""

    def __init__(self, o: Options, index: int = 0, raw: bool = False):
        self.o, self.index, self.raw, self.held = o, index, raw, bytearray()

    @property
    def full(self) -> bool:
        return len(self.held) >= 1 << self.o.block_exp

    @property
    def empty(self) -> bool:
        return not self.held

    def write(self, data: bytes) -> int:
        """Takes what there is room for and says how much; a full block takes nothing and is an error."""
        if self.full and data:
            raise ValueError("block is full")
        taken = data[: (1 << self.o.block_exp) - len(self.held)]
        self.held += taken
        return len(taken)

    def finish(self, only: bool = False) -> tuple[bytes, bytes]:
        """The block's bytes in the archive, and its chaining value (``only``: its hash as all there is)."""
        (cv,) = blake.block_values([(bytes(self.held), self.index << self.o.block_exp, only)])
        payload = encode_payload(bytes(self.held), self.o, self.raw)
        return records.block_header(len(payload), not self.full, cv) + payload, cv


class Packer:
    """An archive in the making: data goes in by ``feed``, finished bytes come out; one block is held."""

    def __init__(self, o: Options, raw: bool = False):
        self.o, self.raw, self.size, self.values = o, raw, 0, []
        self.block, self.started = BlockWriter(o, 0, raw), False

    def _sealed(self, only: bool) -> bytes:
        out, cv = self.block.finish(only)
        self.values.append(cv)
        self.block = BlockWriter(self.o, len(self.values), self.raw)
        return out

    def feed(self, data: bytes) -> Iterator[bytes]:
        if not self.started:
            self.started = True
            yield records.header(self.o)
        self.size += len(data)
        at = 0
        while at < len(data):
            if self.block.full:  # a block is sealed when more follows, as a full last block is still the last
                yield self._sealed(False)
            at += self.block.write(data[at : at + (1 << self.o.block_exp)])

    def end(self) -> Iterator[bytes]:
        yield from self.feed(b"")
        if not self.block.empty:
            yield self._sealed(not self.values)
        yield records.trailer(self.size, blake.root_of(self.values))


@dataclass(frozen=True)
class Entry:
    """A block of a directory: its header's place and record."""

    index: int
    at: int
    record: records.Record


@dataclass
class Directory:
    """What a walk over the records of an archive finds; payloads are skipped."""

    options: Options | None
    status: str
    header_corrected: int
    entries: list[Entry]
    trailer: records.Record | None
    end: int

    @property
    def corrected(self) -> int:
        found = [e.record.corrected for e in self.entries]
        return self.header_corrected + sum(found) + (self.trailer.corrected if self.trailer else 0)


def _steps(size: int, until: int | None) -> Generator[tuple[int, int], object, Directory]:
    """A walk over an archive's records: yields the place and length of each, and is sent what it says."""
    options, status, corrected = yield 0, HEADER_SIZE
    out = Directory(options, status, corrected, [], None, HEADER_SIZE)
    if options is None:
        return out
    at, partial = HEADER_SIZE, False
    while until is None or at < until:
        if at + BLOCK_HEADER_SIZE > size:
            out.status, out.end = "truncated", at
            return out
        record = yield at, BLOCK_HEADER_SIZE
        if record is None:
            out.status, out.end = "record_uncorrectable", at
            return out
        if record.is_trailer:
            out.trailer, out.end = record, at + BLOCK_HEADER_SIZE
            if out.status == "ok" and out.end < size:
                out.status = "trailing_bytes"
            return out
        if partial:
            out.status = "partial_inside"
        if at + BLOCK_HEADER_SIZE + record.size > size:
            out.status, out.end = "truncated", at
            return out
        out.entries.append(Entry(len(out.entries), at, record))
        partial, at = record.partial, at + BLOCK_HEADER_SIZE + record.size
    out.end = at
    return out


def walk(read, size: int, until: int | None = None) -> Directory:
    """Directory of an archive by ``read(at, n)``, 64 bytes a block; of what begins before ``until`` alone.

    Status: ``ok``; a header rule; ``record_uncorrectable`` or ``truncated`` where
    the walk had to stop (what lies behind is unknown); ``partial_inside`` if a
    partial block isn't the last; ``trailing_bytes``.
    """
    return walks([(read, size, until)])[0]


def walks(archives: list[tuple], validate: bool = True) -> list[Directory]:
    """Walks side by side, of (read, size, until) each: what each asks for next is corrected together, or taken as it is."""
    out: list[Directory | None] = [None] * len(archives)
    walks = {k: _steps(size, until) for k, (_, size, until) in enumerate(archives)}
    asked, parse = {k: next(g) for k, g in walks.items()}, records.parse_headers
    while asked:
        found, on = parse([archives[k][0](*ask) for k, ask in asked.items()], validate), {}
        for k, says in zip(asked, found, strict=True):
            try:
                on[k] = walks[k].send(says)
            except StopIteration as end:
                out[k] = end.value
        asked, parse = on, records.parse_records
    return out


def told(found: list[Directory]) -> list[str]:
    """The status of each whole directory, its root hash compared with its blocks' values."""
    roots = blake.roots_of([[e.record.value for e in d.entries] if d.trailer else [] for d in found])
    return ["root" if d.status == "ok" and d.trailer and root != d.trailer.value else d.status for d, root in zip(found, roots, strict=True)]


def directories(archives: list[bytes], validate: bool = True) -> list[Directory]:
    """Directories of whole archives; without ``validate`` the records' parity isn't looked at."""
    return walks([(lambda at, n, a=a: a[at : at + n], len(a), None) for a in archives], validate)


def directory(archive: bytes) -> Directory:
    return directories([archive])[0]


def payload_of(archive: bytes, e: Entry) -> bytes:
    return archive[e.at + BLOCK_HEADER_SIZE : e.at + BLOCK_HEADER_SIZE + e.record.size]


@dataclass(frozen=True)
class Block:
    index: int
    data: bytes | None
    status: str
    corrected: int
    value: bytes | None


def decode_blocks(archive: bytes, d: Directory, wanted: set[int] | None = None, validate: bool = True) -> Iterator[Block]:
    """Blocks decoded and hashed; status ``hash`` where data and stored value differ."""
    unit, single = 1 << d.options.block_exp, len(d.entries) == 1
    for e in d.entries:
        if wanted is not None and e.index not in wanted:
            continue
        data, status, corrected = decode_payload(payload_of(archive, e), d.options, validate)
        value = None
        if data is not None:
            value = blake.block_values([(data, e.index * unit, single)])[0]
            if value != e.record.value:
                # before the number of blocks was known a lone block's plain value counted too
                plain = blake.block_values([(data, e.index * unit, False)])[0] if single else value
                status, value = ("ok", plain) if plain == e.record.value else ("hash", value)
        yield Block(e.index, data, status, corrected, value)


def unpack_many(archives: list[bytes], validate: bool = True) -> list[tuple[bytes, str, int]]:
    """For each archive all data that could be decoded, the first thing wrong (or ok), bytes corrected.

    Blocks of all archives are hashed together.
    """
    known = directories(archives)
    decoded = iter(decode_payloads([(payload_of(a, e), d.options) for a, d in zip(archives, known, strict=True) for e in d.entries], validate))
    payloads = [[next(decoded) for _ in d.entries] for d in known]
    todo = [
        (data, e.index << d.options.block_exp, len(d.entries) == 1, e.record.value)
        for d, found in zip(known, payloads, strict=True)
        for e, (data, _, _) in zip(d.entries, found, strict=True)
        if data is not None
    ]
    holds, roots, out = iter(blake.holds(todo)), blake.roots_of([[e.record.value for e in d.entries] for d in known]), []
    for d, found, root in zip(known, payloads, roots, strict=True):
        status = d.status
        for data, problem, _ in found:
            held = data is not None and next(holds)
            if status == d.status and not held:
                status = problem if data is None else "hash"
        data = b"".join(x or b"" for x, _, _ in found)
        if status == "ok":
            if root != d.trailer.value:
                status = "root"
            elif len(data) != d.trailer.size:
                status = "size"
        out.append((data, status, d.corrected + sum(c for _, _, c in found)))
    return out


def unpack(archive: bytes, validate: bool = True) -> tuple[bytes, str, int]:
    return unpack_many([archive], validate)[0]


def verify_many(archives: list[bytes], validate: bool = True) -> list[tuple[str, int, int, int]]:
    """Of each archive the first thing wrong (or ok), blocks, bad blocks, bytes corrected.

    Some blocks are decoded at a time, and none is kept.
    """
    known = directories(archives)
    size, bad, fixed = [0] * len(known), [0] * len(known), [d.corrected for d in known]
    wrong: list[set[str]] = [set() for _ in known]
    for some in stretches([(k, e, d.options) for k, d in enumerate(known) for e in d.entries], known):
        found = decode_payloads([(payload_of(archives[k], e), o) for k, e, o in some], validate)
        holds = iter(blake.holds([
            (data, e.index << o.block_exp, len(known[k].entries) == 1, e.record.value) for (k, e, o), (data, _, _) in zip(some, found, strict=True) if data is not None
        ]))
        for (k, _, _), (data, problem, corrected) in zip(some, found, strict=True):
            fixed[k] += corrected
            size[k] += len(data or b"")
            if data is None or not next(holds):
                bad[k] += 1
                wrong[k].add(problem if data is None else "hash")
    out, roots = [], blake.roots_of([[e.record.value for e in d.entries] for d in known])
    for k, (d, root) in enumerate(zip(known, roots, strict=True)):
        status = min(wrong[k]) if wrong[k] else d.status
        if status == "ok" and root != d.trailer.value:
            status = "root"
        elif status == "ok" and size[k] != d.trailer.size:
            status = "size"
        out.append((status, len(d.entries), bad[k], fixed[k]))
    return out


def stretches(blocks: list[tuple], found: list[Directory], most: int = 4 << 20) -> Iterator[list[tuple]]:
    """(number in ``found``, entry, options) of blocks, those together whose data is likely to stay within ``most`` bytes, or one.

    A trailer tells a last block's size; as it may be wrong, a block is taken for four times its payload at least.
    """
    held, total = [], 0
    for block in blocks:
        k, e, o = block
        room, end = min(1 << o.block_exp, max(e.record.size * 16, 1 << 16)), found[k].trailer
        if end:
            room = min(room, max(end.size - (e.index << o.block_exp), e.record.size * 4))
        if held and total + room > most:
            yield held
            held, total = [], 0
        held.append(block)
        total += room
    if held:
        yield held


def repair_many(archives: list[bytes]) -> list[tuple[bytes, int, int]]:
    """Each archive with all records and codewords corrected; bytes changed, places lost."""
    known = directories(archives)
    fixed: dict[tuple[int, int], tuple[bytes, int]] = {}
    for level in {records.level(d.options.ecc) for d in known if d.options} - {None}:
        n = sum(level)
        own = [(k, e) for k, d in enumerate(known) if d.options and records.level(d.options.ecc) == level for e in d.entries if e.record.size % n == 0]
        words = np.frombuffer(b"".join(payload_of(archives[k], e) for k, e in own), np.uint8).reshape(-1, n)
        words, changed = rs.decode(words, n, level[0])
        raw, at, bad = words.tobytes(), 0, np.concatenate([[0], np.cumsum(changed < 0)])
        for k, e in own:
            fixed[k, e.index] = raw[at : at + e.record.size], int(bad[(at + e.record.size) // n] - bad[at // n])
            at += e.record.size
    ends = [e for d in known for e in (*(x.record for x in d.entries), d.trailer) if e]
    made = iter(records.with_parity([records.record_data(r) for r in ends], BLOCK_HEADER_SIZE))
    out = []
    for k, (archive, d) in enumerate(zip(archives, known, strict=True)):
        if d.options is None:
            out.append((archive, 0, 1))
            continue
        parts, lost = [records.header(d.options)], 0 if d.trailer else 1
        for e in d.entries:
            payload, bad = fixed.get((k, e.index), (payload_of(archive, e), 0))
            parts += [next(made), payload]
            lost += bad
        if d.trailer:
            parts.append(next(made))
        whole = b"".join(parts) + archive[d.end :]
        out.append((whole, int((np.frombuffer(whole, np.uint8) != np.frombuffer(archive, np.uint8)).sum()), lost))
    return out


def repair(archive: bytes) -> tuple[bytes, int, int]:
    return repair_many([archive])[0]


@dataclass
class _Plan:
    """An archive to be written anew: its blocks in order, each kept, or coded from data."""

    options: Options
    size: int
    kept: list[tuple[int, bool, bytes, bytes]]  # physical size, partial, value, payload
    at: int  # where the new blocks stand among the kept ones
    fresh: list[tuple[bytes, int, bool]]  # data, offset, whether it is all there is


def _written(plans: list[_Plan]) -> list[bytes]:
    """The archives planned; new blocks, records and roots of all are coded and hashed together."""
    flat = [(b, p.options) for p in plans for b, _, _ in p.fresh]
    values, coded = blake.block_values([f for p in plans for f in p.fresh]), [b""] * len(flat)
    for o in {o for _, o in flat}:
        own = [k for k, (_, x) in enumerate(flat) if x == o]
        for k, payload in zip(own, encode_payloads([flat[k][0] for k in own], o), strict=True):
            coded[k] = payload
    new = iter([(len(c), len(b) < 1 << o.block_exp, v, c) for (b, o), v, c in zip(flat, values, coded, strict=True)])
    blocks = []
    for p in plans:
        blocks.append([*p.kept[: p.at], *(next(new) for _ in p.fresh), *p.kept[p.at :]])
    heads = iter(records.block_headers([b[:3] for own in blocks for b in own]))
    roots = blake.roots_of([[b[2] for b in own] for own in blocks])
    ends = records.trailers([(p.size, r) for p, r in zip(plans, roots, strict=True)])
    return [
        b"".join([records.header(p.options), *(x for b in own for x in (next(heads), b[3])), end]) for p, own, end in zip(plans, blocks, ends, strict=True)
    ]


def _kept(archive: bytes, e: Entry) -> tuple[int, bool, bytes, bytes]:
    return e.record.size, e.record.partial, e.record.value, payload_of(archive, e)


def _decoded(blocks: list[tuple[bytes, Directory, Entry]]) -> list[bytes]:
    """The data of blocks; one that can't be decoded is an error."""
    out = decode_payloads([(payload_of(a, e), d.options) for a, d, e in blocks])
    for (data, status, _), (_, _, e) in zip(out, blocks, strict=True):
        if data is None:
            raise ValueError(f"block {e.index}: {status}")
    return [data for data, _, _ in out]


def _searched(o: Options, like: Options | None) -> Options:
    """An archive's options with the search of ``like``: what new blocks are coded with, which no archive tells."""
    return o.with_(fast=like.fast, nice=like.nice, depth=like.depth) if like else o


def append_many(archives: list[bytes], extras: list[bytes], like: Options | None = None) -> list[bytes]:
    """Each archive with the bytes of ``extras`` behind its data; full blocks keep their payloads.

    Only a partial last block is coded again; a lone block is hashed again, as
    its stored value is a root and no part of a tree.  ``like`` has the search for
    matches; with that of its packing an archive is as if packed at once.
    """
    known = directories(archives)
    grow = [k for k, (d, x) in enumerate(zip(known, extras, strict=True)) if d.options is not None and d.trailer is not None and x]
    again = [k for k in grow if known[k].entries and (len(known[k].entries) == 1 or known[k].entries[-1].record.partial)]
    data = dict(zip(again, _decoded([(archives[k], known[k], known[k].entries[-1]) for k in again]), strict=True))
    lasts = [(data[k], known[k].entries[-1].index << known[k].options.block_exp, len(known[k].entries) == 1, known[k].entries[-1].record.value) for k in again]
    for k, held in zip(again, blake.holds(lasts), strict=True):
        if not held:
            raise ValueError(f"block {known[k].entries[-1].index}: hash")
    lone = [k for k in again if not known[k].entries[-1].record.partial]
    parts = dict(zip(lone, blake.block_values([(data[k], 0, False) for k in lone]), strict=True))
    plans = []
    for k in grow:
        d, unit = known[k], 1 << known[k].options.block_exp
        keep = d.entries[:-1] if d.entries and d.entries[-1].record.partial else d.entries
        fresh = split((data[k] if len(keep) < len(d.entries) else b"") + extras[k], d.options)
        kept = [_kept(archives[k], e) for e in keep]
        if k in parts:  # the value of a lone block is a root's, and no part of a tree
            kept = [(*kept[0][:2], parts[k], kept[0][3])]
        at = len(kept)
        lonely = at + len(fresh) == 1
        plans.append(_Plan(_searched(d.options, like), d.trailer.size + len(extras[k]), kept, at, [(b, (at + n) * unit, lonely) for n, b in enumerate(fresh)]))
    out = list(archives)
    for k, archive in zip(grow, _written(plans), strict=True):
        out[k] = archive
    return out


def append(archive: bytes, extra: bytes, like: Options | None = None) -> bytes:
    return append_many([archive], [extra], like)[0]


def replace_many(archives: list[bytes], indexes: list[int | None], datas: list[bytes], like: Options | None = None) -> list[bytes]:
    """Each archive with one block's data changed (None: none), in length only if it is the last; other payloads are kept."""
    known = directories(archives)
    todo = [k for k, index in enumerate(indexes) if index is not None]
    for k in todo:
        d, index = known[k], indexes[k]
        if d.options is None or d.trailer is None or not 0 <= index < len(d.entries):
            raise ValueError("no such block")
        unit, last = 1 << d.options.block_exp, index == len(d.entries) - 1
        if not 0 < len(datas[k]) <= unit or (not last and len(datas[k]) != unit):
            raise ValueError("only the last block may be short")
    plans = []
    for k, old in zip(todo, _decoded([(archives[k], known[k], known[k].entries[indexes[k]]) for k in todo]), strict=True):
        d, data, at = known[k], datas[k], indexes[k]
        kept = [_kept(archives[k], e) for e in d.entries if e.index != at]
        plans.append(_Plan(_searched(d.options, like), d.trailer.size - len(old) + len(data), kept, at, [(data, at << d.options.block_exp, len(d.entries) == 1)]))
    out = list(archives)
    for k, archive in zip(todo, _written(plans), strict=True):
        out[k] = archive
    return out


def replace_block(archive: bytes, index: int, data: bytes) -> bytes:
    return replace_many([archive], [index], [data])[0]


def _regions(d: Directory) -> list[tuple[str, int, int, int]]:
    out = [("header", 0, HEADER_SIZE, 11)]
    level = records.level(d.options.ecc) if d.options else None
    for e in d.entries:
        out.append(("block_header", e.at, BLOCK_HEADER_SIZE, 12))
        if level:
            first = e.at + BLOCK_HEADER_SIZE
            out += [("codeword", at, CODEWORD, level[1] // 2) for at in range(first, first + e.record.size // CODEWORD * CODEWORD, CODEWORD)]
    if d.trailer:
        out.append(("trailer", d.end - BLOCK_HEADER_SIZE, BLOCK_HEADER_SIZE, 12))
    return out


def regions(archive: bytes) -> list[tuple[str, int, int, int]]:
    """(kind, start, length, correctable bytes) of every protected stretch."""
    return _regions(directory(archive))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers that look random and follow from those given (the closing steps of MurmurHash3)."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = (x ^ x >> np.uint32(shift)) * np.uint32(factor)
    return x ^ x >> np.uint32(16)


def _drawn(key: np.ndarray, length: int) -> np.ndarray:
    """Of each row of n random numbers n different places below ``length``, any set as likely as another (Floyd's draw)."""
    rows, n = key.shape
    out, taken, each = np.empty((rows, n), np.int64), np.zeros((rows, length), bool), np.arange(rows)
    for k, top in enumerate(range(length - n, length)):
        place = (key[:, k].astype(np.uint64) * np.uint64(top + 1) >> np.uint64(32)).astype(np.int64)
        place[taken[each, place]] = top
        taken[each, place] = True
        out[:, k] = place
    return out


def damage_many(archives: list[bytes], seeds: list[int], more: int = 0) -> list[tuple[bytes, int]]:
    """Each archive with as many bytes of every protected stretch changed as can be corrected, and ``more``; their number.

    Which bytes change follows from the seed and their places alone, whatever archives are damaged together.
    """
    raw, total = np.frombuffer(b"".join(archives), np.uint8).copy(), [0] * len(archives)
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    starts = np.cumsum([0, *map(len, archives)])
    for k, (archive, d, seed) in enumerate(zip(archives, directories(archives), seeds, strict=True)):
        for _, at, length, most in _regions(d):
            n = min(length, most + more, max(len(archive) - at, 0))
            found.setdefault((length, n), []).append((int(starts[k]) + at, at, seed & 0xFFFFFFFF))
            total[k] += n
    for (length, n), places in found.items():
        table = np.array(places, np.int64)
        for first in range(0, len(table) if n else 0, 4096):
            start, at, seed = table[first : first + 4096].T
            key = _mixed((at[:, None] + np.arange(length - n, length)).astype(np.uint32) ^ _mixed(seed.astype(np.uint32))[:, None])
            along = _drawn(key, length)
            raw[start[:, None] + along] ^= (1 + _mixed(~key) % np.uint32(255)).astype(np.uint8)
    return [(raw[a:b].tobytes(), n) for a, b, n in zip(starts[:-1].tolist(), starts[1:].tolist(), total, strict=True)]


def damage(archive: bytes, seed: int, more: int = 0) -> tuple[bytes, int]:
    return damage_many([archive], [seed], more)[0]
