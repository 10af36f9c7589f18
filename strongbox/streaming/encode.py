"""Incremental encoding: chunks of bytes per stream become archive segments, block by block.

Rows (stream_id STRING, seq LONG, data BINARY, eos BOOLEAN) arrive in any batches.
State per stream: bytes of the open block, total size, chaining values, the next
seq, and rows that came early.  A block is sealed when the next byte arrives, so
that a full last block is still the last when the stream ends; how rows are cut
into batches doesn't change the archive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..codecs import archive, blake, records
from ..dims import Options

OUTPUT = "stream_id string, ord long, kind string, bytes binary"
_STATE = "pending binary, size long, n long, values binary, next long, early array<struct<seq: long, data: binary, eos: boolean>>, done boolean"


def advance(state: tuple, rows: list[tuple[int, bytes, bool]], o: Options) -> tuple[tuple, list[tuple[int, str, bytes]]]:
    """A stream's state after more rows, and the segments that are final by now."""
    pending, size, n, values, next_, early, done = state
    out: list[tuple[int, str, bytes]] = []
    if next_ == 0 and size == 0 and not early and not done and rows:
        out.append((-1, "header", records.header(o)))
    waiting = {seq: (data, eos) for seq, data, eos in early}
    waiting |= {seq: (data, eos) for seq, data, eos in rows if seq >= next_}
    unit = 1 << o.block_exp

    def seal(block: bytes, only: bool) -> None:
        nonlocal n, values
        (cv,) = blake.block_values([(block, n * unit, only)])
        payload = archive.encode_payload(block, o)
        out.append((n, "block", records.block_header(len(payload), len(block) < unit, cv) + payload))
        n, values = n + 1, values + cv

    parts = [pending]
    while not done and next_ in waiting:
        data, done = waiting.pop(next_)
        parts.append(data or b"")
        size, next_ = size + len(data or b""), next_ + 1
    pending, at = b"".join(parts), 0  # the open block is copied once a batch
    while len(pending) - at > unit:
        seal(pending[at : at + unit], False)
        at += unit
    pending = pending[at:]
    if done and len(parts) > 1:
        if pending:
            seal(pending, n == 0)
        pending = b""
        root = blake.root_of([values[k : k + 32] for k in range(0, len(values), 32)])
        out.append((2**62, "trailer", records.trailer(size, root)))
    return (pending, size, n, values, next_, [(s, d, e) for s, (d, e) in sorted(waiting.items())], done), out


def encode_stream(rows: DataFrame, options: Options) -> DataFrame:
    """Segments of archives, appended as they become final; ``eos`` on a row ends its stream.

    Rows behind the end of a stream and rows that repeat a seq are ignored.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else (b"", 0, 0, b"", 0, [], False)
        state = (bytes(state[0]), state[1], state[2], bytes(state[3]), state[4], [(r[0], bytes(r[1]) if r[1] is not None else b"", r[2]) for r in state[5]], state[6])
        given = [
            (int(seq), bytes(data) if data is not None else b"", bool(eos))
            for batch in batches
            for seq, data, eos in zip(batch["seq"], batch["data"], batch["eos"], strict=True)
        ]
        state, out = advance(state, sorted(given), options)
        held.update(state)
        yield pd.DataFrame([(key[0], *segment) for segment in out], columns=["stream_id", "ord", "kind", "bytes"])

    return rows.groupBy("stream_id").applyInPandasWithState(step, OUTPUT, _STATE, "append", GroupStateTimeout.NoTimeout)
