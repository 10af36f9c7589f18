"""LZMA chunks decoded in Python, for the literal settings that liblzma refuses (lc + lp over 4).

Written from the public LZMA specification; slow, a few hundred KB a second.
"""

from __future__ import annotations

from ..dims import Options
from .lz import CODED, FormatError, chunks

_HALF = 1024


class _Bits:
    """The range decoder over one chunk's bytes."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 5
        self.code, self.range = int.from_bytes(raw[1:5], "big"), 0xFFFFFFFF

    def _fill(self) -> None:
        if self.range < 1 << 24:
            if self.at >= len(self.raw):
                raise FormatError("chunk ends early")
            self.range = self.range << 8 & 0xFFFFFFFF
            self.code = (self.code << 8 | self.raw[self.at]) & 0xFFFFFFFF
            self.at += 1

    def bit(self, model: list[int], k: int) -> int:
        self._fill()
        p = model[k]
        bound = (self.range >> 11) * p
        if self.code < bound:
            self.range = bound
            model[k] = p + (2048 - p >> 5)
            return 0
        self.range -= bound
        self.code -= bound
        model[k] = p - (p >> 5)
        return 1

    def direct(self, n: int) -> int:
        out = 0
        for _ in range(n):
            self._fill()
            self.range >>= 1
            one = self.code >= self.range
            if one:
                self.code -= self.range
            out = out << 1 | one
        return out

    def tree(self, model: list[int], n: int) -> int:
        m = 1
        for _ in range(n):
            m = m << 1 | self.bit(model, m)
        return m - (1 << n)

    def tree_low_first(self, model: list[int], n: int, base: int = 0) -> int:
        m, out = 1, 0
        for k in range(n):
            b = self.bit(model, base + m)
            m = m << 1 | b
            out |= b << k
        return out

    @property
    def ended(self) -> bool:
        self._fill()
        return self.at == len(self.raw) and self.code == 0


class _Lengths:
    def __init__(self):
        self.choice = [_HALF, _HALF]
        self.low = [[_HALF] * 8 for _ in range(16)]
        self.mid = [[_HALF] * 8 for _ in range(16)]
        self.high = [_HALF] * 256

    def read(self, bits: _Bits, pos: int) -> int:
        if not bits.bit(self.choice, 0):
            return 2 + bits.tree(self.low[pos], 3)
        if not bits.bit(self.choice, 1):
            return 10 + bits.tree(self.mid[pos], 3)
        return 18 + bits.tree(self.high, 8)


class _Coder:
    """Models and state that a state reset makes anew; the data stays."""

    def __init__(self, o: Options):
        self.o = o
        self.state, self.reps = 0, [0, 0, 0, 0]
        self.literal = [[_HALF] * 0x300 for _ in range(1 << (o.lc + o.lp))]
        self.is_match = [[_HALF] * 16 for _ in range(12)]
        self.is_rep, self.rep0, self.rep1, self.rep2 = ([_HALF] * 12 for _ in range(4))
        self.rep0_long = [[_HALF] * 16 for _ in range(12)]
        self.slots = [[_HALF] * 64 for _ in range(4)]
        self.special = [_HALF] * 128
        self.align = [_HALF] * 16
        self.match_length, self.rep_length = _Lengths(), _Lengths()

    def _literal(self, bits: _Bits, out: bytearray) -> None:
        o, before = self.o, out[-1] if out else 0
        model = self.literal[(len(out) & (1 << o.lp) - 1) << o.lc | before >> 8 - o.lc]
        symbol = 1
        if self.state >= 7:
            near = out[-self.reps[0] - 1]
            while symbol < 0x100:
                b = near >> 7 & 1
                near <<= 1
                got = bits.bit(model, (1 + b << 8) + symbol)
                symbol = symbol << 1 | got
                if got != b:
                    break
        while symbol < 0x100:
            symbol = symbol << 1 | bits.bit(model, symbol)
        out.append(symbol & 0xFF)
        self.state = 0 if self.state < 4 else self.state - 3 if self.state < 10 else self.state - 6

    def _distance(self, bits: _Bits, length: int) -> int:
        slot = bits.tree(self.slots[min(length - 2, 3)], 6)
        if slot < 4:
            return slot
        n = (slot >> 1) - 1
        base = (2 | slot & 1) << n
        if slot < 14:
            return base + bits.tree_low_first(self.special, n, base - slot)
        return base + (bits.direct(n - 4) << 4) + bits.tree_low_first(self.align, 4)

    def run(self, raw: bytes, size: int, out: bytearray) -> None:
        bits, end = _Bits(raw), len(out) + size
        while len(out) < end:
            pos, s = len(out) & (1 << self.o.pb) - 1, self.state
            if not bits.bit(self.is_match[s], pos):
                self._literal(bits, out)
                continue
            if not bits.bit(self.is_rep, s):
                length = self.match_length.read(bits, pos)
                self.reps = [self._distance(bits, length), *self.reps[:3]]
                self.state = 7 if s < 7 else 10
            else:
                if not bits.bit(self.rep0, s):
                    if not bits.bit(self.rep0_long[s], pos):
                        self.state = 9 if s < 7 else 11
                        self._copy(out, 1, end)
                        continue
                else:
                    k = 1 if not bits.bit(self.rep1, s) else 2 + bits.bit(self.rep2, s)
                    self.reps.insert(0, self.reps.pop(k))
                length = self.rep_length.read(bits, pos)
                self.state = 8 if s < 7 else 11
            self._copy(out, length, end)
        if not bits.ended:
            raise FormatError("chunk isn't used up")

    def _copy(self, out: bytearray, length: int, end: int) -> None:
        back = self.reps[0] + 1
        if back > len(out) or len(out) + length > end:
            raise FormatError("match leaves the data")
        for _ in range(length):
            out.append(out[-back])


def decompress_slow(payload: bytes, o: Options) -> bytes:
    out, coder = bytearray(), None
    for kind, size, stored, at in chunks(payload):
        if kind == CODED:
            coder = coder or _Coder(o)
            coder.run(payload[at : at + stored], size, out)
        else:
            out += payload[at : at + size]
            coder = None  # a coded chunk after a raw one starts anew
    return bytes(out)
