"""Incremental decoding and verification: archive bytes per stream become verified blocks.

Rows (stream_id, seq, data) in any batches.  Each block comes out as soon as its
bytes are there; the root is checked when the trailer arrives, one record behind,
as only then the last block is known to be the last.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..codecs import archive, blake, records
from ..operators.archives import _few

OUTPUT = "stream_id string, block_idx long, kind string, status string, corrected long, data binary"
_STATE = "pending binary, header binary, n long, size long, values binary, partial boolean, next long, early array<struct<seq: long, data: binary>>, done boolean"
START = (b"", b"", 0, 0, b"", False, 0, [], False)
_FOUND = ["block_idx", "kind", "status", "corrected", "data", "value", "block_exp"]
_header = lru_cache(256)(records.parse_header)


def advance(state: tuple, rows: list[tuple[int, bytes]]) -> tuple[tuple, list[tuple]]:
    """A stream's state after more rows, and (block_idx, kind, status, corrected, data) found."""
    state, found = collect(state, rows)
    return state, judged(found)


def judged(found: list[tuple]) -> list[tuple]:
    """What ``collect`` found, of any streams, without the last two columns: blocks and roots are hashed side by side."""
    todo = [(data, n << exp, n == 0, value) for n, kind, _, _, data, value, exp in found if kind == "block" and data is not None]
    held = iter(blake.holds(todo))  # whether the first block is the only one wasn't known: either value will do
    ends = [value for _, kind, _, _, _, value, _ in found if kind == "trailer"]
    roots = iter(blake.roots_of([[v[k : k + 32] for k in range(32, len(v), 32)] for v in ends]))
    out = []
    for n, kind, status, corrected, data, value, _ in found:
        if kind == "block" and data is not None:
            status = "ok" if next(held) else "hash"
        elif kind == "trailer" and next(roots) != value[:32]:
            status = "root"
        out.append((n, kind, status, corrected, data))
    return out


def collect(state: tuple, rows: list[tuple[int, bytes]]) -> tuple[tuple, list[tuple]]:
    """A stream's state after more rows, and what they hold, its hashes not yet looked at: columns as _FOUND.

    ``value`` is a block's stored value, or the root with the values of all blocks behind it.
    """
    pending, header, n, size, values, partial, next_, early, done = state
    waiting = dict(early) | {seq: data for seq, data in rows if seq >= next_}
    parts = [pending]
    while next_ in waiting:
        parts.append(waiting.pop(next_) or b"")
        next_ += 1
    pending, at = b"".join(parts), 0  # the open block is copied once a batch
    out: list[tuple] = []
    if not header and len(pending) >= 32 and not done:
        header, at = pending[:32], 32
        _, status, corrected = _header(header)
        out.append((-1, "header", status, max(corrected, 0), None, None, None))
        done = status != "ok"
    options = _header(header)[0] if header else None
    while options and not done and len(pending) - at >= 64:
        record = records.parse_record(pending[at : at + 64])
        if record is None:
            out.append((n, "block", "record_uncorrectable", 0, None, None, None))
            done = True
        elif record.is_trailer:
            status = "size" if size != record.size else "ok"
            out.append((2**62, "trailer", status, record.corrected, None, record.value + values, None))
            done = True
        elif partial:
            out.append((n, "block", "partial_inside", record.corrected, None, None, None))
            done = True
        elif len(pending) - at < 64 + record.size:
            break
        else:
            data, status, corrected = archive.decode_payload(pending[at + 64 : at + 64 + record.size], options)
            out.append((n, "block", status, corrected + record.corrected, data, record.value, options.block_exp))
            at, values = at + 64 + record.size, values + record.value
            n, size, partial = n + 1, size + len(data or b""), record.partial
    return (b"" if done else pending[at:], header, n, size, values, partial, next_, sorted(waiting.items()), done), out


def decode_stream(rows: DataFrame) -> DataFrame:
    """Header, blocks and trailer of each stream with their status, appended as they are verified."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        s = held.get if held.exists else START
        s = (bytes(s[0]), bytes(s[1]), s[2], s[3], bytes(s[4]), s[5], s[6], [(r[0], bytes(r[1])) for r in s[7]], s[8])
        given = [(int(seq), bytes(data) if data is not None else b"") for batch in batches for seq, data in zip(batch["seq"], batch["data"], strict=True)]
        s, out = collect(s, sorted(given))
        held.update(s)
        columns = list(zip(*((key[0], *found) for found in out), strict=True)) or [()] * 8  # as they are: a frame that guesses kinds takes longer than a block
        yield pd.DataFrame({name: np.array(column, object) for name, column in zip(["stream_id", *_FOUND], columns, strict=True)})

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _few(batches, "data"):
            found = judged(list(zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["stream_id", *_FOUND[:5]])

    found = rows.groupBy("stream_id").applyInPandasWithState(step, f"{OUTPUT}, value binary, block_exp int", _STATE, "append", GroupStateTimeout.NoTimeout)
    return found.mapInArrow(judge, OUTPUT)
