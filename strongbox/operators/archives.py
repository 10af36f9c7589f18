"""Archives as DataFrames: pack, list, verify, unpack, repair, append, damage.

Blocks are rows: they are encoded, hashed and decoded side by side by Arrow
functions, and only 32-byte chaining values meet per file.  Errors are statuses
in rows; ``strict`` turns them into a failed query.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..codecs import archive as whole
from ..codecs import blake, records
from ..dims import Options, preset
from ..memory import trim
from ..plans.blocks import block_plan


def _rows(function: Callable[..., tuple], names: list[str], types: list[pa.DataType]):
    """A mapInArrow function: ``function`` of a row's values gives a row (or an iterator of rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = function(*values)
                out.extend([found] if isinstance(found, tuple) else found)
            columns = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def _parts(column: pa.Array, most: int = 4 << 20) -> Iterator[slice]:
    """Stretches of rows of about ``most`` bytes together: what is coded at once stays bounded."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    first = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(first, k)
            first, total = k, 0
        total += n
    if len(sizes):
        yield slice(first, len(sizes))


def _few(batches: Iterator[pa.RecordBatch], column: int | str) -> Iterator[pa.RecordBatch]:
    """Batches cut into stretches of rows of about 4 MiB together: what a worker holds beside what it was sent stays bounded.

    Behind each batch what the allocators keep of it goes back to the system.
    """
    for batch in batches:
        for some in _parts(batch.column(column)):
            yield batch.slice(some.start, some.stop - some.start)
        trim()


def _batches(function: Callable[[list[bytes]], list[tuple]], names: list[str], types: list[pa.DataType]):
    """A mapInArrow function of (id, archive): ``function`` of many archives gives a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _few(batches, 1):
            columns = zip(*function([a or b"" for a in part.column(1).to_pylist()]), strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["id", *names])

    return run


_LONG, _BYTES, _TEXT, _BOOL, _INT = pa.int64(), pa.binary(), pa.string(), pa.bool_(), pa.int32()


def encode_blocks(files: DataFrame, options: Options, raw: bool = False, id_col: str = "file_id", content_col: str = "content") -> DataFrame:
    """file_id, block_idx, is_partial, size, physical_size, cv, payload of each block.

    A block crosses to Python once; its payload and chaining value come back together.
    """
    size = F.octet_length(F.col(content_col))
    plan = block_plan(files, size, options.block_exp, [id_col, content_col])
    unit = 1 << options.block_exp
    slots = files.sparkSession.sparkContext.defaultParallelism
    if _partitions(files) < slots:  # coding is worth more than a shuffle where tasks are too few
        plan = plan.repartition(slots, id_col, "block_idx")
    data = F.expr(f"substring({content_col}, cast(block_offset + 1 AS int), cast(size AS int))")
    blocks = plan.select(F.col(id_col).alias("id"), "block_idx", "is_partial", "is_last", data.alias("data"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _few(batches, 4):
            index, last, data = (part.column(k).to_pylist() for k in (1, 3, 4))
            lone = [x and k == 0 for k, x in zip(index, last, strict=True)]
            values = blake.block_values([(d, k * unit, one) for d, k, one in zip(data, index, lone, strict=True)])
            payloads = whole.encode_payloads(data, options, raw)
            columns = [part.column(0), part.column(1), part.column(2)]
            columns += [pa.array([len(d) for d in data], _LONG), pa.array([len(p) for p in payloads], _LONG), pa.array(values, _BYTES), pa.array(payloads, _BYTES)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "block_idx", "is_partial", "size", "physical_size", "cv", "payload"])

    kind = dict(files.dtypes)[id_col]
    out = blocks.mapInArrow(encode, f"id {kind}, block_idx long, is_partial boolean, size long, physical_size long, cv binary, payload binary")
    return out.withColumnRenamed("id", id_col)


# Functions that workers import are plain; they become UDFs where they are used.
def _roots(values: pd.Series) -> pd.Series:
    return pd.Series(blake.roots_of([[bytes(x) for x in v] for v in values]), dtype=object)


def _joined(parts: pd.Series) -> pd.Series:
    return parts.map(lambda p: b"".join(bytes(x) for x in p))


def _block_headers(size: pd.Series, partial: pd.Series, cv: pd.Series) -> pd.Series:
    return pd.Series(records.block_headers([(int(s), bool(p), bytes(c)) for s, p, c in zip(size, partial, cv, strict=True)]), dtype=object)


def _trailers(size: pd.Series, root: pd.Series) -> pd.Series:
    return pd.Series(records.trailers([(int(s), bytes(r)) for s, r in zip(size, root, strict=True)]), dtype=object)


def tree_root(values: Column) -> Column:
    """Root hash of block values in order (array of binary)."""
    return F.pandas_udf(_roots, "binary")(values)


def file_roots(blocks: DataFrame, id_col: str = "file_id") -> DataFrame:
    """file_id, n_blocks, size, root_hash.  Values are sorted by block within the file; payloads stay where they are."""
    slim = blocks.select(id_col, "block_idx", "size", "cv")
    found = slim.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n_blocks"), F.sum("size").alias("size"),
        F.array_sort(F.collect_list(F.struct("block_idx", "cv"))).alias("_v"),
    )
    return found.select(id_col, "n_blocks", "size", tree_root(F.transform("_v", lambda v: v["cv"])).alias("root_hash"))


def assemble(files: DataFrame, blocks: DataFrame, options: Options, id_col: str = "file_id") -> DataFrame:
    """file_id, archive: header, blocks in order, trailer, joined per file."""
    head = records.header(options)
    make_block, make_end, joined = (F.pandas_udf(f, "binary") for f in (_block_headers, _trailers, _joined))
    segments = blocks.select(id_col, F.col("block_idx").alias("ord"), F.concat(make_block("physical_size", "is_partial", "cv"), "payload").alias("bytes"))
    roots = files.select(id_col).join(file_roots(blocks, id_col), id_col, "left")
    none = blake.root_of([])
    ends = roots.select(id_col, F.lit(2**62).alias("ord"), make_end(F.coalesce("size", F.lit(0).cast("long")), F.coalesce("root_hash", F.lit(none))).alias("bytes"))
    parts = segments.unionByName(ends).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("ord", "bytes"))).alias("_s"))
    return parts.select(id_col, F.concat(F.lit(head), joined(F.transform("_s", lambda s: s["bytes"]))).alias("archive"))


WHOLE = 1 << 20  # bytes of a file up to which its blocks aren't worth a shuffle


def pack(files: DataFrame, options: Options | None = None, raw: bool = False, id_col: str = "file_id", content_col: str = "content") -> DataFrame:
    """file_id, archive of every file; null content counts as empty.  Files of 2 GiB and more go by the sink.

    Blocks of files over 1 MiB are dealt out and meet again; smaller files are packed where they are, many at once.
    """
    options = options or preset(6).with_(ecc=1)
    files = files.select(id_col, F.coalesce(content_col, F.lit(b"")).alias("content"))
    size = F.octet_length("content")
    large = files.where(size > WHOLE)
    return _packed(files.where(size <= WHOLE), options, raw, id_col).unionByName(_gathered(encode_blocks(large, options, raw, id_col), options, id_col))


def _whole(values: pd.Series, sizes: pd.Series, segments: pd.Series) -> pd.Series:
    ends = records.trailers([(int(s), r) for s, r in zip(sizes, _roots(values), strict=True)])
    return pd.Series([b"".join([*map(bytes, own), end]) for own, end in zip(segments, ends, strict=True)], dtype=object)


def _gathered(blocks: DataFrame, options: Options, id_col: str) -> DataFrame:
    """file_id, archive of files of which each has a block; blocks are coded once and meet once, with what their root needs."""
    make_block, make_whole = (F.pandas_udf(f, "binary") for f in (_block_headers, _whole))
    segments = blocks.select(id_col, "block_idx", "size", "cv", F.concat(make_block("physical_size", "is_partial", "cv"), "payload").alias("bytes"))
    found = segments.groupBy(id_col).agg(F.sum("size").alias("size"), F.array_sort(F.collect_list(F.struct("block_idx", "cv", "bytes"))).alias("_s"))
    whole = make_whole(F.transform("_s", lambda s: s["cv"]), "size", F.transform("_s", lambda s: s["bytes"]))
    return found.select(id_col, F.concat(F.lit(records.header(options)), whole).alias("archive"))


def _packed(files: DataFrame, options: Options, raw: bool, id_col: str) -> DataFrame:
    slots = files.sparkSession.sparkContext.defaultParallelism
    if _partitions(files) < slots:
        files = files.repartition(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _few(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(whole.pack_many(part.column(1).to_pylist(), options, raw), _BYTES)], names=["id", "archive"])

    kind = dict(files.dtypes)[id_col]
    return files.select(F.col(id_col).alias("id"), "content").mapInArrow(run, f"id {kind}, archive binary").withColumnRenamed("id", id_col)


def _partitions(rows: DataFrame) -> int:
    """How many tasks read the rows; behind a shuffle they are as many as it is wide, and asking would run it."""
    plan = rows._jdf.queryExecution().executedPlan()
    if plan.toString().find("Exchange") >= 0:
        return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.rdd.getNumPartitions()


def block_directory(archives: DataFrame, id_col: str = "file_id", payloads: bool = True) -> DataFrame:
    """One row per block of every archive, and its archive's options and status."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _few(batches, 1):
            many, rows = [a or b"" for a in part.column(1).to_pylist()], []
            for id_, archive, d in zip(part.column(0).to_pylist(), many, whole.directories(many), strict=True):
                for e in d.entries:
                    o, r = d.options, e.record
                    payload = whole.payload_of(archive, e) if payloads else None
                    rows.append((id_, e.index, e.at, r.size, r.partial, r.value, r.corrected, len(d.entries), o.ecc, o.prefilter, o.block_exp, o.lc, o.lp, o.pb, o.dict_exp, d.status, payload))
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    kind = dict(archives.dtypes)[id_col]
    names = ["id", "block_idx", "header_off", "physical_size", "is_partial", "cv", "corrected", "n_blocks", "ecc", "prefilter", "block_exp", "lc", "lp", "pb", "dict_exp", "status", "payload"]
    types = [_id_type(kind), _LONG, _LONG, _LONG, _BOOL, _BYTES, _LONG, _LONG, *[_INT] * 7, _TEXT, _BYTES]
    schema = f"id {kind}, block_idx long, header_off long, physical_size long, is_partial boolean, cv binary, corrected long, n_blocks long, ecc int, prefilter int, block_exp int, lc int, lp int, pb int, dict_exp int, status string, payload binary"
    out = archives.select(F.col(id_col).alias("id"), "archive").mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def _id_type(kind: str) -> pa.DataType:
    return {"bigint": _LONG, "int": _INT, "string": _TEXT}[kind]


def list_archives(archives: DataFrame, id_col: str = "file_id", validate: bool = True) -> DataFrame:
    """Metadata of every archive by its records alone; no payload is decoded.  Without ``validate`` records are taken as they are."""

    none = Options(ecc=None, prefilter=None, block_exp=None, lc=None, lp=None, pb=None, dict_exp=None)

    def listed(many: list[bytes]) -> list[tuple]:
        out = []
        for archive, d in zip(many, whole.directories(many, validate), strict=True):
            o, packed = d.options or none, sum(e.record.size for e in d.entries)
            size, root = (d.trailer.size, d.trailer.value) if d.trailer else (None, None)
            out.append((d.status, o.ecc, o.prefilter, o.block_exp, o.lc, o.lp, o.pb, o.dict_exp, len(d.entries), packed, len(archive), size, root, d.corrected, packed // len(d.entries) if d.entries else None))
        return out

    kind = dict(archives.dtypes)[id_col]
    names = ["status", "ecc", "prefilter", "block_exp", "lc", "lp", "pb", "dict_exp", "n_blocks", "payload_size", "file_size", "size", "root_hash", "corrected", "average_block"]
    types = [_TEXT, *[_INT] * 7, _LONG, _LONG, _LONG, _LONG, _BYTES, _LONG, _LONG]
    schema = f"id {kind}, status string, ecc int, prefilter int, block_exp int, lc int, lp int, pb int, dict_exp int, n_blocks long, payload_size long, file_size long, size long, root_hash binary, corrected long, average_block long"
    out = archives.select(F.col(id_col).alias("id"), "archive").mapInArrow(_batches(listed, names, types), schema)
    return out.withColumnRenamed("id", id_col)


def decode_blocks(archives: DataFrame, id_col: str = "file_id", validate: bool = True, where: Column | None = None, spread: bool = False) -> DataFrame:
    """file_id, block_idx, status, corrected, cv, data of every block.

    ``where`` selects blocks by directory columns before anything is decoded;
    ``spread`` deals blocks out by their number, for few large archives.
    """
    blocks = block_directory(archives, id_col)
    if where is not None:
        blocks = blocks.where(where)
    if spread:
        blocks = blocks.repartition(F.col(id_col), F.col("block_idx"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _few(batches, "payload"):
            index, cv, n, *values, payload = (c.to_pylist() for c in part.columns[1:])
            options = [Options(**dict(zip(fields, row, strict=True))) for row in zip(*values, strict=True)]
            found = whole.decode_payloads(list(zip(payload, options, strict=True)), validate)
            todo = [(d, k << o.block_exp, m == 1, v) for (d, _, _), k, o, m, v in zip(found, index, options, n, cv, strict=True) if d is not None]
            holds = iter(blake.holds(todo))
            status = [s if d is None or next(holds) else "hash" for d, s, _ in found]
            columns = [part.column(0), part.column(1), pa.array(status, _TEXT), pa.array([c for _, _, c in found], _LONG), part.column(2), pa.array([d for d, _, _ in found], _BYTES)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "block_idx", "status", "corrected", "cv", "data"])

    fields = ["ecc", "prefilter", "block_exp", "lc", "lp", "pb", "dict_exp"]
    kind = dict(archives.dtypes)[id_col]
    slim = blocks.select(F.col(id_col).alias("id"), "block_idx", "cv", "n_blocks", *fields, "payload")
    out = slim.mapInArrow(decode, f"id {kind}, block_idx long, status string, corrected long, cv binary, data binary")
    return out.withColumnRenamed("id", id_col)


def verify(archives: DataFrame, id_col: str = "file_id", validate: bool = True) -> DataFrame:
    """file_id, status, n_blocks, bad_blocks, corrected: records, payloads, block hashes, root and size together."""
    kind, names, types = dict(archives.dtypes)[id_col], ["status", "n_blocks", "bad_blocks", "corrected"], [_TEXT, _LONG, _LONG, _LONG]
    run = _batches(lambda many: whole.verify_many(many, validate), names, types)
    out = archives.select(F.col(id_col).alias("id"), "archive").mapInArrow(run, f"id {kind}, status string, n_blocks long, bad_blocks long, corrected long")
    return out.withColumnRenamed("id", id_col)


def unpack(archives: DataFrame, id_col: str = "file_id", validate: bool = True, strict: bool = False) -> DataFrame:
    """file_id, content, status, corrected.  ``strict``: any status but ok fails the query."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _few(batches, 1):
            found = whole.unpack_many([a or b"" for a in part.column(1).to_pylist()], validate)
            if strict:
                for id_, (_, status, _) in zip(part.column(0).to_pylist(), found, strict=True):
                    if status != "ok":
                        raise ValueError(f"archive {id_}: {status}")
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((_BYTES, _TEXT, _LONG))]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", "content", "status", "corrected"])

    kind = dict(archives.dtypes)[id_col]
    out = archives.select(F.col(id_col).alias("id"), "archive").mapInArrow(decode, f"id {kind}, content binary, status string, corrected long")
    return out.withColumnRenamed("id", id_col)


def _per_archive(archives: DataFrame, rows, id_col: str, columns: list[tuple], inputs=("archive",)) -> DataFrame:
    kind = dict(archives.dtypes)[id_col]
    names, types = ["id", *(n for n, _, _ in columns)], [_id_type(kind), *(t for _, _, t in columns)]
    schema = f"id {kind}, " + ", ".join(f"{n} {t}" for n, t, _ in columns)
    return archives.select(F.col(id_col).alias("id"), *inputs).mapInArrow(_rows(rows, names, types), schema).withColumnRenamed("id", id_col)


def repair(archives: DataFrame, id_col: str = "file_id") -> DataFrame:
    """file_id, archive (corrected), changed bytes, lost places."""
    kind, names, types = dict(archives.dtypes)[id_col], ["archive", "changed", "lost"], [_BYTES, _LONG, _LONG]
    out = archives.select(F.col(id_col).alias("id"), "archive").mapInArrow(_batches(whole.repair_many, names, types), f"id {kind}, archive binary, changed long, lost long")
    return out.withColumnRenamed("id", id_col)


def damage(archives: DataFrame, seed: int, more: int = 0, id_col: str = "file_id") -> DataFrame:
    """file_id, archive with as many bytes changed as can be corrected (and ``more``) in every stretch, changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _few(batches, 1):
            seeds = [seed + zlib.crc32(str(id_).encode()) for id_ in part.column(0).to_pylist()]
            found = whole.damage_many([a or b"" for a in part.column(1).to_pylist()], seeds, more)
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((_BYTES, _LONG))]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", "archive", "changed"])

    kind = dict(archives.dtypes)[id_col]
    rows = archives.select(F.col(id_col).alias("id"), "archive")
    return rows.mapInArrow(run, f"id {kind}, archive binary, changed long").withColumnRenamed("id", id_col)


def _changed(archives: DataFrame, many: Callable[..., list[bytes]], id_col: str, *inputs: str) -> DataFrame:
    """file_id, archive: ``many`` of archives and further columns gives the archives that they become."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _few(batches, 1):
            held = [a or b"" for a in part.column(1).to_pylist()]
            out = many(held, *(c.to_pylist() for c in part.columns[2:]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, _BYTES)], names=["id", "archive"])

    kind = dict(archives.dtypes)[id_col]
    rows = archives.select(F.col(id_col).alias("id"), "archive", *inputs)
    return rows.mapInArrow(run, f"id {kind}, archive binary").withColumnRenamed("id", id_col)


def append(archives: DataFrame, extra_col: str = "extra", id_col: str = "file_id", options: Options | None = None) -> DataFrame:
    """file_id, archive with the bytes of ``extra`` behind its data; full blocks are kept as they are.

    ``options`` are those that the archives were packed by: of them comes the search
    for matches (mode, nice length, depth), the rest from the archives themselves.
    """
    many = lambda held, extras: whole.append_many(held, [x or b"" for x in extras], options)
    return _changed(archives, many, id_col, extra_col)


def replace_block(archives: DataFrame, index_col: str = "block_idx", data_col: str = "data", id_col: str = "file_id", options: Options | None = None) -> DataFrame:
    """file_id, archive with block ``block_idx`` holding ``data`` (null: no block); the root follows, other payloads are kept.

    ``options`` as for ``append``.
    """
    many = lambda held, indexes, datas: whole.replace_many(held, indexes, datas, options)
    return _changed(archives, many, id_col, index_col, data_col)


def best_copies(copies: DataFrame, id_col: str = "file_id", copy_col: str = "copy") -> DataFrame:
    """Of several copies of an archive each block's first that verifies: file_id, block_idx, copy, data (null: all lost)."""
    parts = copies.select(F.struct(id_col, copy_col).alias("_k"), "archive").select(F.to_json("_k").alias("_k"), "archive")
    found = decode_blocks(parts.withColumnRenamed("_k", "_key"), "_key")
    found = found.withColumn("_f", F.from_json("_key", f"struct<{id_col}: {dict(copies.dtypes)[id_col]}, {copy_col}: {dict(copies.dtypes)[copy_col]}>"))
    good = F.when(F.col("status") == "ok", F.struct(F.col(f"_f.{copy_col}").alias(copy_col), "data"))
    out = found.groupBy(F.col(f"_f.{id_col}").alias(id_col), "block_idx").agg(F.min(good).alias("_b"))
    return out.select(id_col, "block_idx", F.col(f"_b.{copy_col}").alias(copy_col), F.col("_b.data").alias("data"))
