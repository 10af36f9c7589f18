"""The codecs as SQL functions: one call registers them all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession, functions as F

from ..codecs import archive, bcj, blake, lz, records, rs
from ..dims import preset
from ..memory import trim
from ..operators.archives import _roots
from ..plans.options import resolve

PACKED = "struct<ok: boolean, code: int, data: binary>"
# fixed values: codes of the buffer interface
OK, INVALID_INPUT, DATA_ERROR = 0, -1, -4


def _each(function, *columns: pd.Series) -> pd.Series:
    rows = [None if any(v is None for v in row) else function(*row) for row in zip(*columns, strict=True)]
    return pd.Series(rows, dtype=object)


def bcj_encode(data: pd.Series, prefilter: pd.Series) -> pd.Series:
    return _each(lambda d, p: bcj.apply(bytes(d), int(p), True), data, prefilter)


def bcj_decode(data: pd.Series, prefilter: pd.Series) -> pd.Series:
    return _each(lambda d, p: bcj.apply(bytes(d), int(p), False), data, prefilter)


def bcj_words(word: pd.Series, place: pd.Series, prefilter: pd.Series) -> pd.Series:
    """Single instruction words of a fixed-width prefilter (2, 4, 5, 6) at their places, encoded."""
    out = np.zeros(len(word), np.int64)
    with np.errstate(over="ignore"):
        for kind in prefilter.unique():
            own = (prefilter == kind).to_numpy()
            rule = bcj.word_rule(int(kind))
            out[own] = rule(word[own].to_numpy(np.int64).astype(np.uint32), place[own].to_numpy(np.int64).astype(np.uint32), True)
    return pd.Series(out)


def pack_options(level: pd.Series, size: pd.Series, block_exp: pd.Series, block_count: pd.Series, ecc: pd.Series) -> pd.DataFrame:
    """The options that a preset, the data's size, a block exponent or count (null: not given) and an ECC level lead to."""
    whole = lambda v: None if pd.isna(v) else int(v)
    rows = [
        resolve(int(n), whole(s), block_exp=whole(e), block_count=whole(c), ecc=int(x))
        for n, s, e, c, x in zip(level, size, block_exp, block_count, ecc, strict=True)
    ]
    return pd.DataFrame([(o.ecc, o.block_exp, o.lc, o.lp, o.pb, o.dict_exp) for o in rows], columns=["ecc", "block_exp", "lc", "lp", "pb", "dict_exp"])


def lz_encode(data: pd.Series, level: pd.Series) -> pd.Series:
    return _each(lambda d, n: lz.compress(bytes(d), preset(int(n))), data, level)


def lz_decode(payload: pd.Series, level: pd.Series) -> pd.Series:
    """Null where the payload is damaged."""

    def one(p, n):
        try:
            return lz.decompress(bytes(p), preset(int(n)))
        except lz.FormatError:
            return None

    return _each(one, payload, level)


def rs_encode(payload: pd.Series, ecc: pd.Series) -> pd.Series:
    out: list[bytes | None] = [None] * len(payload)
    for some in _stretches(payload):
        for e, own in _levels(payload, ecc, some):
            for k, stored in zip(own, rs.protect_many([bytes(payload.iat[k]) for k in own], records.level(e)), strict=True):
                out[k] = stored
    return pd.Series(out, dtype=object)


def _levels(data: pd.Series, ecc: pd.Series, some: range) -> Iterator[tuple[int, list[int]]]:
    """Each level among some rows and its rows; rows of nothing have none."""
    whole = [k for k in some if data.iat[k] is not None and not pd.isna(ecc.iat[k])]
    for e in {int(ecc.iat[k]) for k in whole}:
        yield e, [k for k in whole if ecc.iat[k] == e]


def rs_decode(stored: pd.Series, ecc: pd.Series) -> pd.DataFrame:
    rows: list[tuple] = [(None, None, None)] * len(stored)
    for some in _stretches(stored):
        for e, own in _levels(stored, ecc, some):
            for k, found in zip(own, rs.unprotect_many([bytes(stored.iat[k]) for k in own], records.level(e)), strict=True):
                rows[k] = found
    return pd.DataFrame(rows, columns=["data", "corrected", "lost"])


def block_cv(data: pd.Series, offset: pd.Series, root: pd.Series) -> pd.Series:
    """Chaining value of a block at a byte offset, or the hash if it is all there is."""
    out: list[bytes] = []
    for some in _stretches(data):
        out += blake.block_values([(b"" if data.iat[k] is None else bytes(data.iat[k]), int(offset.iat[k]), bool(root.iat[k])) for k in some])
    return pd.Series(out, dtype=object)


def _stretches(column: pd.Series, most: int = 4 << 20) -> Iterator[range]:
    """Places of rows of about ``most`` bytes together; behind them what the allocators keep goes back to the system."""
    first = total = 0
    for k, d in enumerate(column):
        n = 0 if d is None else len(d)
        if total and total + n > most:
            yield range(first, k)
            first, total = k, 0
        total += n
    if len(column):
        yield range(first, len(column))
    trim()


def pack(data: pd.Series, level: pd.Series) -> pd.DataFrame:
    """An archive of a buffer; nothing or no bytes is invalid input, code -1."""
    rows: list[tuple] = [(False, INVALID_INPUT, None)] * len(data)
    for some in _stretches(data):
        for n in {int(level.iat[k]) for k in some}:
            own = [k for k in some if level.iat[k] == n and data.iat[k] is not None and len(data.iat[k])]
            for k, packed in zip(own, archive.pack_many([bytes(data.iat[k]) for k in own], preset(n)), strict=True):
                rows[k] = (True, OK, packed)
    return pd.DataFrame(rows, columns=["ok", "code", "data"])


def unpack(data: pd.Series) -> pd.DataFrame:
    rows: list[tuple] = [(False, INVALID_INPUT, None)] * len(data)
    for some in _stretches(data):
        own = [k for k in some if data.iat[k] is not None and len(data.iat[k])]
        for k, (content, status, _) in zip(own, archive.unpack_many([bytes(data.iat[k]) for k in own]), strict=True):
            rows[k] = (True, OK, content) if status == "ok" else (False, DATA_ERROR, None)
    return pd.DataFrame(rows, columns=["ok", "code", "data"])


class lz_chunks:  # noqa: N801
    """The chunks of a payload, by their headers alone; stops at the first that is damaged."""

    def eval(self, payload: bytes):
        if payload is None:
            return
        try:
            for k, (kind, size, stored, at) in enumerate(lz.chunks(bytes(payload))):
                yield k, kind, size, stored, at
        except lz.FormatError:
            return


class codewords:  # noqa: N801
    """The codewords of a stored payload."""

    def eval(self, stored: bytes, ecc: int):
        level = records.level(ecc)
        if stored is None or level is None:
            return
        for k in range(0, len(stored), 255):
            yield k // 255, bytes(stored[k : k + level[0]]), bytes(stored[k + level[0] : k + 255])


class archive_blocks:  # noqa: N801
    """The block records of an archive."""

    def eval(self, data: bytes):
        for e in archive.directory(bytes(data or b"")).entries:
            yield e.index, e.at, e.record.size, e.record.partial, e.record.value


def _outer(table: type, width: int) -> type:
    """A table function that gives one row of nulls where ``table`` gives none.

    Spark runs LEFT JOIN LATERAL of a Python table function as an inner join, so rows
    without any would be lost.
    """

    class outer:  # noqa: N801
        def eval(self, *given):
            rows = table().eval(*given)
            yield next(rows, (None,) * width)
            yield from rows

    return outer


_SCALAR = {
    "bcj_encode": (bcj_encode, "binary"), "bcj_decode": (bcj_decode, "binary"), "bcj_words": (bcj_words, "long"),
    "pack_options": (pack_options, "struct<ecc: int, block_exp: int, lc: int, lp: int, pb: int, dict_exp: int>"),
    "lz_encode": (lz_encode, "binary"), "lz_decode": (lz_decode, "binary"),
    "rs_encode": (rs_encode, "binary"), "rs_decode": (rs_decode, "struct<data: binary, corrected: long, lost: long>"),
    "block_cv": (block_cv, "binary"), "pack": (pack, PACKED), "unpack": (unpack, PACKED), "tree_root": (_roots, "binary"),
}
_TABLE = {
    "lz_chunks": (lz_chunks, "chunk_idx int, kind string, usize int, csize int, payload_off long"),
    "codewords": (codewords, "cw_idx long, data binary, parity binary"),
    "archive_blocks": (archive_blocks, "block_idx long, header_off long, physical_size long, is_partial boolean, cv binary"),
}


def register(spark: SparkSession) -> None:
    """Make all functions known to SQL under their own names, table functions also as NAME_outer."""
    for name, (function, kind) in _SCALAR.items():
        spark.udf.register(name, F.pandas_udf(function, kind))
    for name, (table, kind) in _TABLE.items():
        spark.udtf.register(name, F.udtf(table, returnType=kind))
        spark.udtf.register(f"{name}_outer", F.udtf(_outer(table, kind.count(",") + 1), returnType=kind))
