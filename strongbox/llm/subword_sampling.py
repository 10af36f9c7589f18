"""SentencePiece encoding and decoding with sampled segmentations.

A text's segmentations are the paths of a lattice of the model's pieces; a path
has probability in proportion to the product of its pieces' weights.  Gumbel
top-k draws k distinct paths without replacement: each path has the log of its
probability plus Gumbel noise, and the k largest are wanted.  A perturbed A-star
search finds them without listing paths: a queue holds sets of paths, each with
the largest perturbed value in it (a Gumbel variable at the log of the set's
mass, truncated at the value of the path it was split from); the best set is
taken, its best path is drawn, and the rest is split again.

The lattice falls apart where no piece spans two neighbouring characters (mostly
between words).  Sets are therefore split at such units first, and inside a unit
only when its set is taken.  Forward sums run over the distinct units of a batch
with numpy, path draws over all units of all rows at once.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .wordhash import _windows, mix, slices
from .work import trim

_BASE = 0x9E3779B97F4A7C15
_SLOT_BITS = 18
_SLOTS = 1 << _SLOT_BITS
_NOISE = 38.0  # -log(-log(u)) for the largest u of _uniform is below this


def _uniform(key: np.ndarray, seed: int) -> np.ndarray:
    return (mix(key, seed) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def _slots(key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


class _Draws:
    """Numbers in (0, 1) of a row's own stream."""

    def __init__(self, key: int):
        self.key, self.n = key, 0

    def __call__(self) -> float:
        self.n += 1
        x = (self.key + self.n * 0x9E3779B97F4A7C15) % 2**64  # as mix(), for one number
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 % 2**64
        x = (x ^ (x >> 29)) * 0xA0761D6478BD642F % 2**64
        return ((x ^ (x >> 32)) >> 11) * 2.0**-53 + 2.0**-54


class Pieces:
    """The model's pieces with log weights, and their look-up by hash.

    The weight of a piece is (rank + 100) ** -alpha, its rank being its place in
    the order in which the model's pieces were merged; single characters and
    bytes come last.  A character without a piece is its UTF-8 bytes, as the model
    has it.
    """

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        if n > 1 << 16:
            raise ValueError(f"{path} has {n} pieces, and ids are written in 16 bits")
        names = [model.id_to_piece(i) for i in range(n)]
        self.byte_id = np.zeros(256, np.int64)
        log_weight = np.full(n, -alpha * math.log(n + 100))
        chars: dict[int, int] = {}
        table: list[tuple[str, int]] = []
        for i, p in enumerate(names):
            if model.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                score = model.get_score(i)
                if len(p) > 1 and -n < score <= 0:
                    log_weight[i] = -alpha * math.log(-score + 100)
                table.append((p, i))
                chars.update((ord(c), len(chars) + 1) for c in p if ord(c) not in chars)
        self.n, self.log_weight, self.names = n, log_weight, names
        self.longest = max(len(p) for p, _ in table)
        self.bytes = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.encode() for i, p in enumerate(names)]
        flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.size = np.array([len(b) for b in self.bytes], np.int32)
        self.flat, self.at = flat, (np.cumsum(self.size) - self.size).astype(np.int32)
        # which pairs of neighbours some piece spans
        self.char = np.zeros(max(chars) + 2, np.int32)
        for c, k in chars.items():
            self.char[c] = k
        self.spans = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p, _ in table:
            for a, b in zip(p, p[1:], strict=False):
                self.spans[self.char[ord(a)], self.char[ord(b)]] = True
        # open addressing by the high bits of the hash
        self.keys, self.ids, self.probes = np.zeros(_SLOTS, np.uint64), np.full(_SLOTS, -1, np.int32), 1
        for p, i in table:
            points = np.frombuffer(p.encode("utf-32-le"), np.uint32).astype(np.uint64)
            key = _windows(points, np.zeros(1, np.int64), np.array([len(points)]), _BASE)
            slot = int(_slots(key)[0])
            probe = 1
            while self.ids[slot] >= 0:
                slot, probe = (slot + 1) % _SLOTS, probe + 1
            self.keys[slot], self.ids[slot], self.probes = key[0], i, max(self.probes, probe)

    def find(self, key: np.ndarray) -> np.ndarray:
        at = _slots(key)
        out, same = self.ids[at], self.keys[at] == key
        # most have no piece: a slot that is free ends the search, one that another piece has goes on
        more = np.flatnonzero(~same & (out >= 0))
        out[~same] = -1
        while len(more):
            at = (at[more] if len(at) == len(key) else at) + 1 & _SLOTS - 1
            ids, same = self.ids[at], self.keys[at] == key[more]
            out[more[same]] = ids[same]
            on = ~same & (ids >= 0)
            more, at = more[on], at[on]
        return out

    def with_bytes(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids from n on are code points of characters without a piece; they become bytes' pieces.
        ``cuts`` (places in ids) move along."""
        odd = np.flatnonzero(ids >= self.n)
        if not len(odd):
            return ids, cuts
        points = ids[odd] - self.n
        ids = ids.copy()
        ids[odd] = self.byte_id[np.minimum(points, 127)]
        if points.max() < 128:
            return ids, cuts
        wide = odd[points > 127]
        raw = [chr(c).encode() for c in (points[points > 127]).tolist()]
        size = np.ones(len(ids), np.int64)
        size[wide] = [len(r) for r in raw]
        out, first = np.repeat(ids, size), np.concatenate([[0], np.cumsum(size)])
        for at, r in zip(first[wide].tolist(), raw, strict=True):
            out[at : at + len(r)] = self.byte_id[list(r)]
        return out, first[cuts]

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        size, at = self.size.take(ids), self.at.take(ids)
        ends = np.cumsum(size)
        if len(ends) and ends[-1] < 2**31:  # places in half the room
            ends = ends.astype(np.int32)
        where = np.repeat(at - (ends - size), size)
        where += np.arange(len(where), dtype=where.dtype)
        return self.flat.take(where)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids: their bytes, white space marks as spaces, without the first."""
        raw = self.spelled(ids).tobytes()
        raw = raw.replace("▁".encode(), b" ")
        return raw[1:] if raw[:1] == b" " else raw


_PIECES: dict[tuple[str, float], Pieces] = {}


def pieces_of(path: str, alpha: float) -> Pieces:
    if (path, alpha) not in _PIECES:
        _PIECES[path, alpha] = Pieces(path, alpha)
    return _PIECES[path, alpha]


class _Batch:
    """The lattices of some texts: units, their distinct forms, forward sums, edge tables."""

    def __init__(self, pieces: Pieces, texts: list[str]):
        self.p = pieces
        self.shown = shown = ["▁" + t.replace(" ", "▁") if t else "" for t in texts]
        self.points = np.frombuffer("".join(shown).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.doc_at = np.concatenate([[0], np.cumsum([len(t) for t in shown])]).astype(np.int64)
        points, n = self.points, len(self.points)
        code = pieces.char[np.minimum(points, len(pieces.char) - 1)]
        cut = np.ones(n + 1, bool)
        if n > 1:
            cut[1:n] = ~pieces.spans[code[:-1], code[1:]]
        cut[self.doc_at] = True
        self.unit_at = np.flatnonzero(cut)  # first characters, and the end
        if not n:
            self.unit_at = np.zeros(1, np.int64)
        self.doc_unit = np.searchsorted(self.unit_at, self.doc_at)
        # a unit's number within its row: draws must not depend on what else is in the batch
        self.own = (np.arange(len(self.unit_at) - 1) - np.repeat(self.doc_unit[:-1], np.diff(self.doc_unit))).astype(np.uint64)
        start, size = self.unit_at[:-1], np.diff(self.unit_at)
        key = _windows(points.astype(np.uint64), start, size, _BASE) if n else np.zeros(0, np.uint64)
        # equal units together: draws go through them in this order, for the sake of the caches
        self.by_form = np.argsort(key)
        new = np.ones(len(key), bool)
        new[1:] = np.diff(key[self.by_form]) != 0
        first = self.by_form[new]
        self.form = np.empty(len(key), np.int64)
        self.form[self.by_form] = np.cumsum(new) - 1
        # distinct forms, longest first, laid out end to end; a form of m characters has m + 1 nodes
        order = np.argsort(-size[first], kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.form = rank[self.form]
        first = first[order]
        self.size = size[first]
        self.char_at = np.cumsum(self.size) - self.size
        self.node_at = self.char_at + np.arange(len(self.size))
        total = int(self.size.sum())
        flat = points[np.repeat(start[first] - self.char_at, self.size) + np.arange(total)]
        self._edges(flat, total)
        self._forward(total)

    def _edges(self, flat: np.ndarray, total: int) -> None:
        """self.edge[L - 1, i]: id of the piece of L characters at i, -1 if none; ids from n on are characters without a piece."""
        p = self.p
        edge = [np.full(total, -1, np.int32) for _ in range(min(p.longest, int(self.size[0]) if len(self.size) else 1))]
        left = np.repeat(self.char_at + self.size, self.size) - np.arange(total)
        with np.errstate(over="ignore"):
            base = np.full(total + 1, _BASE, np.uint64)
            base[0] = 1
            power = np.cumprod(base, dtype=np.uint64)
            base[1:] = np.uint64(pow(_BASE, -1, 2**64))
            back = np.cumprod(base, dtype=np.uint64)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(flat.astype(np.uint64) * power[:total], dtype=np.uint64)])
            at = np.arange(total)
            for length in range(1, len(edge) + 1):
                at = at[left[at] >= length]
                edge[length - 1][at] = p.find((sums[at + length] - sums[at]) * back[at])
        while len(edge) > 1 and not (edge[-1] >= 0).any():
            edge.pop()
        self.edge, self.longest = np.stack(edge), len(edge)
        alone = self.edge[0] < 0
        self.edge[0, alone] = p.n + flat[alone]
        width = np.array([1, 2, 3, 4])[np.searchsorted([0x80, 0x800, 0x10000], flat, side="right")]
        self.log_weight = np.full(self.edge.shape, -np.inf, np.float32)
        for k in range(self.longest):
            has = np.flatnonzero(self.edge[k] >= 0)
            self.log_weight[k, has] = p.log_weight[np.minimum(self.edge[k, has], p.n - 1)]
        self.log_weight[0, alone] = width[alone] * p.log_weight[p.byte_id[0]]

    def _forward(self, total: int) -> None:
        """self.alpha[node]: log of the summed weight of paths to it; self.share[node, L - 1]:
        the share of the paths whose last piece has L characters; self.best, self.best_share:
        the largest of these; self.paths: the paths' number, up to 2."""
        nodes = total + len(self.size)
        self.alpha, self.paths = np.zeros(nodes), np.ones(nodes, np.int8)
        self.share = np.zeros((nodes, self.longest), np.float32)
        self.best, self.best_share = np.zeros(nodes, np.int32), np.zeros(nodes, np.float32)
        for t in range(1, int(self.size[0]) + 1 if len(self.size) else 0):
            live = int(np.searchsorted(-self.size, -t, side="right"))
            node, char = self.node_at[:live] + t, self.char_at[:live] + t
            x = self.alpha[node - 1] + self.log_weight[0, char - 1]  # one character: always an edge
            top, paths, edges = x.copy(), self.paths[node - 1].copy(), [(1, slice(None), x)]
            for length in range(2, min(t, self.longest) + 1):
                w = self.log_weight[length - 1, char - length]
                has = np.flatnonzero(w > -np.inf)
                if len(has):
                    x = self.alpha[node[has] - length] + w[has]
                    edges.append((length, has, x))
                    top[has] = np.maximum(top[has], x)
                    paths[has] = np.minimum(paths[has] + self.paths[node[has] - length], 2)
            sums = np.zeros(live)
            for length, has, x in edges:
                sums[has] += np.exp(x - top[has])
            alpha = top + np.log(sums)
            best, best_share = np.ones(live, np.int32), np.zeros(live, np.float32)
            for length, has, x in edges:
                share = np.exp(x - alpha[has]).astype(np.float32)
                self.share[node[has], length - 1] = share
                more = share > best_share[has]
                best[has] = np.where(more, length, best[has])
                best_share[has] = np.where(more, share, best_share[has])
            self.alpha[node], self.paths[node], self.best[node], self.best_share[node] = alpha, paths, best, best_share

    def draw(self, units: np.ndarray, key: np.ndarray, seed: int, piece_at: np.ndarray, logp: np.ndarray) -> None:
        """Draw a path for each of ``units``, by the row's key (one for every unit of the batch): ids of pieces into piece_at (by first character), logs of path probabilities."""
        chosen = np.zeros(len(self.form), bool)
        chosen[units] = True
        units = self.by_form[chosen[self.by_form]]
        key = key[units]
        form = self.form[units]
        t, stream = self.size[form].copy(), mix(key + self.own[units], seed)
        begin, node0, char0 = self.unit_at[units], self.node_at[form], self.char_at[form]
        total = np.zeros(len(units))
        live, wide = np.arange(len(units)), self.edge.shape[1]
        edge, log_weight = self.edge.reshape(-1), self.log_weight.reshape(-1)
        while len(live):
            left = t[live]
            node = node0[live] + left
            with np.errstate(over="ignore"):  # a linear congruential step of each unit's own stream
                stream = stream * np.uint64(6364136223846793005) + np.uint64(1442695040888963407)
            u = (stream >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
            length = self.best.take(node)  # the likeliest piece ends most draws
            best_share = self.best_share.take(node)
            other = np.flatnonzero(u >= best_share)
            if len(other):
                row = self.share[node[other]]
                row[np.arange(len(other)), length[other] - 1] = 0
                sums = np.cumsum(row, axis=1)
                # the rest of u, stretched over the shares of the others; with no other the likeliest stays
                held = best_share[other]
                reach = (u[other] - held) / np.maximum(1 - held, np.float32(1e-12))
                chosen = 1 + np.count_nonzero(sums <= np.minimum(reach, np.float32(1 - 1e-6))[:, None] * sums[:, -1:], axis=1)
                length[other] = np.where(sums[:, -1] > 0, chosen, length[other])
            left = left - length
            t[live] = left
            at = char0[live] + left + (length - 1).astype(np.int64) * wide
            piece_at[begin[live] + left] = edge.take(at) + 1
            total[live] += log_weight.take(at)
            more = np.flatnonzero(left)
            live, stream = live.take(more), stream.take(more)
        logp[units] = np.minimum(total - self.alpha[node0 + self.size[form]], 0)

    def rest(self, units: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Log of the mass of a unit's other paths; minus infinity if there is none."""
        form = self.form[units]
        more = self.paths[self.node_at[form] + self.size[form]] > 1
        return np.where(more, np.log(-np.expm1(logp[units])), -np.inf)

    def options(self, node: int, out: frozenset) -> list[tuple[int, float]]:
        return [(k, s) for k, s in enumerate(self.share[node].tolist(), 1) if s > 0 and k not in out]


def _truncated(log_mass: np.ndarray, bound: float, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at log_mass, given that they are below bound."""
    return -np.logaddexp(-bound, np.log(-np.log(u)) - log_mass)


def _truncated_one(log_mass: float, bound: float, u: float) -> float:
    """The same of one, by numbers."""
    a, b = -bound, math.log(-math.log(u)) - log_mass
    return -(max(a, b) + math.log1p(math.exp(-abs(a - b))))


class _Search:
    """The queue of one row."""

    def __init__(self, batch: _Batch, doc: int, key: int):
        self.b, self.key, self.draws = batch, key, _Draws(key)
        self.lo, self.hi = int(batch.doc_unit[doc]), int(batch.doc_unit[doc + 1])
        self.queue: list[tuple] = []
        self.found: list[tuple[int, float, float]] = []  # round, log probability, perturbed value

    def push(self, value: float, item: tuple) -> None:
        if value > -np.inf:
            heapq.heappush(self.queue, (-value, len(self.queue) + self.draws.n, item))

    def settle(self, round_: int, first: int, value: float, logp: np.ndarray, want: int) -> None:
        """A whole path is drawn (units from ``first`` on anew): note it, queue the sets beside it."""
        own = logp[self.lo : self.hi]
        sums = np.concatenate([[0.0], np.cumsum(own)])
        self.found.append((round_, float(sums[-1]), value))
        if not want or first >= self.hi:
            return
        # noise is below _NOISE, so a unit whose mass is that much below the best sets can't give one
        n, g = 64, np.zeros(0)
        while True:
            units = np.arange(first, min(first + n, self.hi))
            mass = sums[units - self.lo] + self.b.rest(units, logp)
            g = _truncated(mass, value, _uniform(self.b.own[units] + np.uint64(self.key), 1000 + round_))
            floor = np.partition(g, -want)[-want] if len(g) > want else -np.inf
            if first + n >= self.hi or sums[first + n - self.lo] + _NOISE < floor:
                break
            n *= 4
        best = np.argpartition(-g, want - 1)[:want] if len(g) > want else np.arange(len(g))
        for i in best.tolist():
            self.push(float(g[i]), ("unit", round_, int(units[i]), float(sums[i + first - self.lo])))

    def take(self, pieces_by_round: list[np.ndarray]) -> tuple[int, int, float, list[tuple[int, int]], float] | None:
        """The best set's best path up to and with its first free unit: round of its prefix,
        unit, value, the unit's pieces (place, length) and their log probability."""
        if not self.queue:
            return None
        value, _, item = heapq.heappop(self.queue)
        value, b = -value, self.b
        kind, round_, unit, before = item[:4]
        form = int(b.form[unit])
        node0, size = int(b.node_at[form]), int(b.size[form])
        if kind == "unit":
            # all other paths of the unit: apart by the place where they leave the path drawn before
            begin = int(b.unit_at[unit])
            ends = [*(np.flatnonzero(pieces_by_round[round_][begin : begin + size]).tolist()), size]
            steps = [(ends[k], ends[k] - ends[k - 1]) for k in range(len(ends) - 1, 0, -1)]
            parts, log_, done = [], 0.0, []
            for t, length in steps:
                share = float(b.share[node0 + t, length - 1])
                mass = sum(s for _, s in b.options(node0 + t, frozenset([length])))
                if mass > 0:
                    parts.append((log_ + math.log(mass), ("node", round_, unit, before, t, tuple(done), frozenset([length]))))
                log_ += math.log(share)
                done.append((t - length, length))
            if not parts:
                return self.take(pieces_by_round)
            total = np.exp(np.array([m for m, _ in parts]) - max(m for m, _ in parts))
            chosen = int(np.searchsorted(np.cumsum(total), self.draws() * total.sum()))
            chosen = min(chosen, len(parts) - 1)
            for k, (mass, part) in enumerate(parts):
                if k != chosen:
                    self.push(_truncated_one(before + mass, value, self.draws()), part)
            item = parts[chosen][1]
        _, round_, unit, before, t, done, out = item
        log_ = sum(math.log(float(b.share[node0 + at + length, length - 1])) for at, length in done)
        path = list(done)
        splits, skip = [], out
        while t > 0:
            options = b.options(node0 + t, skip)
            total = sum(s for _, s in options)
            u, length = self.draws() * total, options[-1][0]
            for k, s in options:
                u -= s
                if u <= 0:
                    length = k
                    break
            share = float(b.share[node0 + t, length - 1])
            others = total - share
            if len(options) > 1 and others > 0:
                splits.append((log_ + math.log(others), t, tuple(path), skip | {length}))
            log_ += math.log(share)
            t -= length
            path.append((t, length))
            skip = frozenset()
        for mass, at, fixed, skip in splits:
            self.push(_truncated_one(before + mass, value, self.draws()), ("node", round_, unit, before, at, fixed, skip))
        return round_, unit, value, path, log_


def sample_batch(pieces: Pieces, texts: list[str], keys: list[int], k: int) -> list[list[tuple[np.ndarray, float, float, float, bool]]]:
    """For each text up to k of (ids, log probability, perturbed value, inclusion probability, whether they decode to it), best first."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):  # once: it takes longer than what it is about
        return _sampled(pieces, texts, keys, k)


def _sampled(pieces: Pieces, texts: list[str], keys: list[int], k: int) -> list[list[tuple[np.ndarray, float, float, float, bool]]]:
    b = _Batch(pieces, texts)
    n, units = len(b.points), len(b.unit_at) - 1
    doc_of = np.repeat(np.arange(len(texts)), np.diff(b.doc_unit))
    key = np.array(keys, np.uint64)[doc_of]
    piece_at, logp = np.zeros(n, np.int32), np.zeros(units)
    b.draw(np.arange(units), key, 1, piece_at, logp)
    by_round = [piece_at]
    searches = [_Search(b, d, keys[d]) for d in range(len(texts))]
    for s in searches:
        s.settle(0, s.lo, -math.log(-math.log(s.draws())), logp, k)
    for r in range(1, k):
        piece_at, logp2, tails, starts = np.zeros(n, np.int32), np.zeros(units), [], []
        for s in searches:
            taken = s.take(by_round)
            if taken is None:
                continue
            old, unit, value, path, log_ = taken
            lo, begin = int(b.unit_at[s.lo]), int(b.unit_at[unit])
            piece_at[lo:begin] = by_round[old][lo:begin]
            logp2[s.lo : unit] = logs[old][s.lo : unit] if (logs := s.__dict__.setdefault("logs", {0: logp})) else 0
            form = b.form[unit]
            for at, length in path:
                piece_at[begin + at] = b.edge[length - 1, b.char_at[form] + at] + 1
            logp2[unit] = log_
            tails.append(np.arange(unit + 1, s.hi))
            starts.append((s, unit + 1, value))
        if tails:
            b.draw(np.concatenate(tails), key, 1 + 97 * r, piece_at, logp2)
        by_round.append(piece_at)
        for s, first, value in starts:
            s.__dict__["logs"][r] = logp2
            s.settle(r, first, value, logp2, k - r)
    out: list[list] = [[] for _ in texts]
    limits = [-s.queue[0][0] if s.queue and len(s.found) == k else None for s in searches]
    for r, piece_at in enumerate(by_round):
        at = np.flatnonzero(piece_at)
        ids, cuts = pieces.with_bytes(piece_at[at].astype(np.int64) - 1, np.searchsorted(at, b.doc_at))
        there = [d for d, s in enumerate(searches) if len(s.found) > r]
        # the samples of a round are decoded together; only if they differ somewhere, text by text
        shown = "".join(b.shown[d] for d in there).encode()
        whole = bytes(pieces.spelled(ids)) == shown
        for d in there:
            _, log_, value = searches[d].found[r]
            own, limit = ids[cuts[d] : cuts[d + 1]], limits[d]
            included = 1.0 if limit is None else -math.expm1(-math.exp(min(log_ - limit, 50.0)))
            same = "▁" not in texts[d] if whole else pieces.decode(own) == texts[d].encode()
            out[d].append((own, log_, value, included, same))
    return out


_SCHEMA = (
    "id long, sample int, n_pieces long, ids binary, log_prob double, perturbed double, "
    "inclusion double, best boolean, round_trip boolean"
)


def sample_segmentations(
    docs: DataFrame,
    model: str,
    k: int = 3,
    alpha: float = 0.3,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    slice_bytes: int = 1 << 20,
) -> DataFrame:
    """Up to k distinct segmentations of every whole text, drawn without replacement.

    One row per document and sample: the id, ``sample`` from 0 by falling
    perturbed value, ``n_pieces``, ``ids`` (unsigned 16-bit little endian),
    ``log_prob`` of the segmentation, its ``perturbed`` value, ``inclusion`` (the
    probability that such a path is among the k, given the largest value left
    out; 1 when all paths are drawn), and ``round_trip``: whether the ids decode
    to the text, which fails only for texts that hold the mark U+2581 itself.

    Draws depend on seed and id alone, so a task that runs again, or rows dealt
    otherwise, give the same samples; repeated ids with the same text repeat them.
    A null or empty text has one segmentation, of no piece.  A text with fewer
    than k segmentations gives them all.  Other columns are ignored.  Texts are done
    in slices of about ``slice_bytes``, which bears on a worker's memory alone.
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model, alpha)
        for batch in batches:
            for part in slices(batch, 1, slice_bytes):
                ids = part.column(0).to_pylist()
                texts = [t or "" for t in part.column(1).to_pylist()]
                keys = [xxhash.xxh3_64_intdigest(str(i), seed) for i in ids]
                rows = []
                for i, found in zip(ids, sample_batch(pieces, texts, keys, k), strict=True):
                    for r, (x, log_, value, included, same) in enumerate(found):
                        rows.append((i, r, len(x), x.astype("<u2").tobytes(), log_, value, included, same))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
                names = ("id", "sample", "n_pieces", "ids", "log_prob", "perturbed", "inclusion", "round_trip")
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=list(names))
        trim()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(sample, _SCHEMA.replace("best boolean, ", "")).withColumnRenamed("id", id_col)


def op10_subword_sampling(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumn("ids_crc32", F.crc32("ids"))
