"""Archives as a Spark data source: ``spark.read.format("strongbox")`` and the sinks.

Reading: ``mode`` is ``meta`` (a row per archive), ``blocks`` (a row per block
record) or ``data`` (blocks decoded).  The path is an archive, a folder (of which
the files that end in the suffix are read) or a glob (``**`` for folders of any
depth).  ``meta`` and ``blocks`` read 64 bytes per block; an archive of up to 64 KiB
is read at once, in any mode.  Nothing of an archive is read to plan: a partition
of ``data`` is a byte range of an archive, whose task walks the records up to its
end and decodes the blocks that begin in it, so that one large archive feeds many
tasks.  Filters on block_idx and path are pushed into the partitions.  An archive whose records, root hash or size are wrong has a
row in ``data`` with its status and no block_idx; ``strict`` makes that, and a bad
block, fail the query.  With a filter on block_idx only blocks are judged.

Writing: rows (name STRING, content BINARY) become archives ``<name><suffix>``, by
default ``.sba`` (option ``suffix``, also for reading), block by block.  With
``pieces`` rows of one name that follow each other in a task are pieces of one
archive.  A task writes under temporary names in the job's own folder; the commit
renames, an abort removes.  Overwriting replaces the archives of the folder;
otherwise a name that is there, or one that two rows have, fails the commit, and
so does a null name.

Streaming: archives that appear in a folder, and those that change, are read once
each, whatever their names.  What has been read is in the offset, so that a
restart goes on from the checkpoint; ``logPath`` names a folder, one for each
query, for a log that keeps offsets short where a stream reads many archives.
"""

from __future__ import annotations

import contextlib
import glob
import json
import math
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual,
    InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from ..codecs import archive, blake
from ..dims import Options, preset

SUFFIX = ".sba"
WHOLE = 1 << 20  # bytes of rows that are packed together
AT_ONCE = 1 << 16  # bytes of an archive up to which a single read is less than one for each record
SCHEMAS = {
    "meta": "path string, status string, ecc int, prefilter int, block_exp int, dict_exp int, n_blocks long, payload_size long, file_size long, size long, root_hash binary, corrected long",
    "blocks": "path string, block_idx long, header_off long, physical_size long, is_partial boolean, cv binary, corrected long",
    "data": "path string, block_idx long, status string, corrected long, data binary",
}


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" not in path and not path.startswith("/"):
        import os

        path = os.path.abspath(path)
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _split(path: str) -> tuple[str, str | None]:
    """The folder that a glob begins in, and the glob from there; a plain path and None."""
    magic = re.search(r"[*?\[]", path)
    if not magic:
        return path, None
    cut = path.rfind("/", 0, magic.start()) + 1
    return path[:cut] or ".", path[cut:]


def archive_files(path: str, suffix: str = SUFFIX) -> list[tuple[str, int, int]]:
    """(path, size, nanoseconds of change) of an archive, of a folder's files that end in the suffix, or of a glob's files; by name."""
    root, pattern = _split(path)
    store, base = _store(root)
    base = base.rstrip("/") or "/"
    info = store.get_file_info(base)
    if info.type == pyarrow.fs.FileType.File:
        return [(base, info.size, info.mtime_ns or 0)]
    found = store.get_file_info(pyarrow.fs.FileSelector(base, recursive=True))
    files = [f for f in found if f.type == pyarrow.fs.FileType.File and "/_temporary" not in f.path[len(base) :]]
    if pattern is not None:
        fits = re.compile(glob.translate(pattern, recursive=True, include_hidden=True))
        files = [f for f in files if fits.match(f.path[len(base.rstrip("/")) + 1 :])]
    else:
        files = [f for f in files if f.path.endswith(suffix)]
    return sorted((f.path, f.size, f.mtime_ns or 0) for f in files)


@dataclass
class Run:
    """The blocks of an archive that begin in a range of its bytes."""

    path: str
    size: int
    low: int
    high: int
    last: bool


@dataclass
class Runs(InputPartition):
    """What a task reads (all fields plain, as partitions travel pickled)."""

    held: list[Run]


def _reading(store: pyarrow.fs.FileSystem, run: Run, held: contextlib.ExitStack) -> Callable[[int, int], bytes]:
    """``read(at, n)`` of a run's archive; a small one is closed again, so that many don't hold as many files."""
    if run.size <= AT_ONCE and run.low == 0 and run.last:
        with store.open_input_file(run.path) as f:
            whole = f.read_at(run.size, 0)
        return lambda at, n: whole[at : at + n]
    f = held.enter_context(store.open_input_file(run.path))
    return lambda at, n: f.read_at(min(n, run.size - at), at)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict, mode: str):
        self.path, self.mode, self.suffix = options["path"], mode, options.get("suffix", SUFFIX)
        self.run_bytes = int(options.get("runBytes", 32 << 20))
        self.validate = options.get("validate", "true").lower() != "false"
        self.strict = options.get("strict", "false").lower() == "true"
        self.low, self.high, self.name = 0, 2**62, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = getattr(f, "attribute", ())
            if column == ("block_idx",) and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value)
            elif column == ("block_idx",) and isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, f.value)
            elif column == ("block_idx",) and isinstance(f, GreaterThan):
                self.low = max(self.low, f.value + 1)
            elif column == ("block_idx",) and isinstance(f, LessThanOrEqual):
                self.high = min(self.high, f.value)
            elif column == ("block_idx",) and isinstance(f, LessThan):
                self.high = min(self.high, f.value - 1)
            elif column == ("path",) and isinstance(f, EqualTo):
                self.name = f.value
            else:
                yield f

    def runs(self, files: list[tuple], most: int = 1000) -> list[Runs]:
        """Small archives together, up to ``most`` a task, large ones in ranges."""
        out, total = [], 0
        for path, size, _ in files:
            # every task walks from the archive's start: longer ranges, as a root, keep that in proportion
            step = max(self.run_bytes, math.isqrt(size * self.run_bytes)) if self.mode == "data" else max(size, 1)
            parts = max(1, -(-size // step))
            for k in range(parts):
                run = Run(path, size, k * step, (k + 1) * step, k == parts - 1)
                if not out or parts > 1 or total + size > self.run_bytes or len(out[-1].held) >= most:
                    out.append(Runs([]))
                    total = 0
                out[-1].held.append(run)
                total += min(size, step)
        return out

    def partitions(self) -> list[Runs]:
        files = archive_files(self.path, self.suffix)
        return self.runs([f for f in files if self.name in (None, f[0])]) or [Runs([])]

    def read(self, runs: Runs) -> Iterator[tuple]:
        some, total = [], 0
        for run in runs.held:
            own = min(run.size, run.high - run.low)
            if some and (total + own > 4 << 20 or len(some) >= 1000):
                yield from self._rows(some)
                some, total = [], 0
            some.append(run)
            total += own
        if some:
            yield from self._rows(some)

    def _rows(self, runs: list[Run]) -> Iterator[tuple]:
        """Of a few runs: their records are walked, and their blocks decoded and hashed, side by side."""
        store, _ = _store(_split(self.path)[0])
        with contextlib.ExitStack() as held:
            reads = [_reading(store, run, held) for run in runs]
            untils = [None if run.last or self.mode != "data" else run.high for run in runs]
            found = archive.walks([(read, run.size, until) for read, run, until in zip(reads, runs, untils, strict=True)])
            if self.mode == "data":
                yield from self._data(runs, found, reads)
            elif self.mode == "blocks":
                for run, d in zip(runs, found, strict=True):
                    for e in d.entries:
                        if self.low <= e.index <= self.high:
                            yield run.path, e.index, e.at, e.record.size, e.record.partial, e.record.value, e.record.corrected
            else:
                for run, d, status in zip(runs, found, archive.told(found), strict=True):
                    o, t = d.options, d.trailer
                    yield (
                        run.path, status, *((o.ecc, o.prefilter, o.block_exp, o.dict_exp) if o else (None,) * 4), len(d.entries),
                        sum(e.record.size for e in d.entries), run.size, t.size if t else None, t.value if t else None, d.corrected,
                    )

    def _data(self, runs: list[Run], found: list[archive.Directory], reads: list) -> Iterator[tuple]:
        own = lambda run, e: run.low <= e.at < run.high and self.low <= e.index <= self.high
        tail = lambda run, d, e: run.last and e is d.entries[-1] and self._whole()
        todo = [(k, e, d.options) for k, (run, d) in enumerate(zip(runs, found, strict=True)) for e in d.entries if own(run, e) or tail(run, d, e)]
        length = [0] * len(runs)
        for some in archive.stretches(todo, found):
            decoded = archive.decode_payloads([(reads[k](e.at + 64, e.record.size), o) for k, e, o in some], self.validate)
            holds = iter(blake.holds([
                (data, e.index << o.block_exp, len(found[k].entries) == 1, e.record.value)
                for (k, e, o), (data, _, _) in zip(some, decoded, strict=True) if data is not None
            ]))
            for (k, e, _), (data, status, corrected) in zip(some, decoded, strict=True):
                if data is not None:
                    status = "ok" if next(holds) else "hash"
                length[k] = len(data or b"")
                if not own(runs[k], e):
                    continue
                if self.strict and status != "ok":
                    raise ValueError(f"{runs[k].path}, block {e.index}: {status}")
                yield runs[k].path, e.index, status, corrected, data
        if not self._whole():
            return
        for run, d, status, n in zip(runs, found, archive.told(found), length, strict=True):
            if run.last:
                if status == "ok" and d.trailer.size != (max(len(d.entries) - 1, 0) << d.options.block_exp) + n:
                    status = "size"
                if status != "ok":
                    if self.strict:
                        raise ValueError(f"{run.path}: {status}")
                    yield run.path, None, status, 0, None

    def _whole(self) -> bool:
        return self.low <= 0 and self.high >= 2**62


@dataclass
class Written(WriterCommitMessage):
    """The archives of a task, ``<task>-0`` onwards in the job's folder, by name: short, as the driver has those of all tasks."""

    task: str
    names: list[str]


class ArchiveWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.suffix, self.overwrite = options["path"], options.get("suffix", SUFFIX), overwrite
        self.pieces = options.get("pieces", "false").lower() == "true"
        self.held = f"_temporary-{uuid.uuid4().hex}"  # the job's own: it travels to the tasks
        o = preset(int(options.get("preset", 6))).with_(ecc=int(options.get("ecc", 1)))
        values = {k: int(options[n]) for k, n in (("prefilter", "prefilter"), ("block_exp", "blockExponent"), ("dict_exp", "dictExponent")) if n in options}
        self.options = o.with_(**values)

    def write(self, rows) -> Written:
        store, base = _store(self.path)
        store.create_dir(f"{base}/{self.held}", recursive=True)
        done, current, packer, out, some, total = Written(uuid.uuid4().hex, []), None, None, None, [], 0

        def opened(name: str):
            done.names.append(name)
            return store.open_output_stream(f"{base}/{self.held}/{done.task}-{len(done.names) - 1}")

        def flush() -> None:
            for (name, _), packed in zip(some, archive.pack_many([data for _, data in some], self.options), strict=True):
                with opened(name) as whole:
                    whole.write(packed)
            some.clear()

        def close() -> None:
            if out is not None:
                for part in packer.end():
                    out.write(part)
                out.close()

        for row in rows:
            name = row["name"]
            if name is None or ".." in name.split("/"):
                raise ValueError(f"no name for an archive: {name}")
            content = bytes(row["content"] or b"")
            if not self.pieces and len(content) <= WHOLE:
                some.append((name, content))
                total += len(content)
                if total > WHOLE or len(some) >= 1000:
                    flush()
                    total = 0
                continue
            if out is None or not self.pieces or name != current:
                close()
                current, packer, out = name, archive.Packer(self.options), opened(name)
            for part in packer.feed(content):
                out.write(part)
        flush()
        close()
        return done

    def commit(self, messages) -> None:
        store, base = _store(self.path)
        try:
            done = [m for m in messages if m]
            names, many = {name for m in done for name in m.names}, sum(len(m.names) for m in done)
            there = [p for p, _, _ in archive_files(self.path, self.suffix)] if store.get_file_info(base).type == pyarrow.fs.FileType.Directory else []
            if len(names) < many:
                raise ValueError(f"{many - len(names)} names are given more than once")
            if not self.overwrite and (both := [p for p in there if p.removeprefix(f"{base}/").removesuffix(self.suffix) in names]):
                raise ValueError(f"{len(both)} archives are there already, as {min(both)}")
            for old in there if self.overwrite else ():
                store.delete_file(old)
            for folder in {name.rpartition("/")[0] for name in names}:
                store.create_dir(f"{base}/{folder}", recursive=True)
            for m in done:
                for k, name in enumerate(m.names):
                    store.move(f"{base}/{self.held}/{m.task}-{k}", f"{base}/{name}{self.suffix}")
        finally:
            self._clean(store, base)

    def abort(self, messages) -> None:
        store, base = _store(self.path)
        self._clean(store, base)

    def _clean(self, store, base: str) -> None:
        if store.get_file_info(f"{base}/{self.held}").type == pyarrow.fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.held}")


class ArchiveStream(DataSourceStreamReader):
    """A file is known by its name, size and time of change.

    Without a log an offset is the list of all files read so far, and a batch holds
    all that are new: the source isn't told where a query stood, so after a restart
    it can't tell which of them come first.  With a log an offset is the number of
    the last batch, the log has a file for each batch with what was new in it, and
    a batch holds up to ``maxFilesPerTrigger`` archives.
    """

    def __init__(self, options: dict):
        self.reader = ArchiveReader(options, "data")
        self.path, self.most = options["path"], int(options.get("maxFilesPerTrigger", 1000))
        self.log = options.get("logPath")
        self.seen: set[tuple] = set()
        self.known: set[tuple] = set()
        self.waiting: list[tuple] = []
        self.batches: list[list] = []

    def _entries(self) -> list[tuple]:
        return archive_files(self.path, self.reader.suffix)

    def _read_log(self, to: int | None = None) -> None:
        store, base = _store(self.log)
        store.create_dir(base, recursive=True)
        while to is None or len(self.batches) < to:
            name = f"{base}/{len(self.batches) + 1}.json"
            if store.get_file_info(name).type != pyarrow.fs.FileType.File:
                return
            with store.open_input_stream(name) as f:
                self.batches.append([tuple(e) for e in json.loads(f.read())])
            self.known.update(self.batches[-1])

    def initialOffset(self) -> dict:  # noqa: N802
        return {"batch": 0} if self.log else {"seen": "[]"}

    def latestOffset(self) -> dict:  # noqa: N802
        if not self.log:
            self.seen |= set(self._entries())
            return {"seen": json.dumps(sorted(self.seen))}
        self._read_log()
        if new := self._next():
            store, base = _store(self.log)
            number = len(self.batches) + 1
            with store.open_output_stream(f"{base}/{number}.tmp") as out:
                out.write(json.dumps(new).encode())
            store.move(f"{base}/{number}.tmp", f"{base}/{number}.json")
            self.batches.append(new)
            self.known.update(new)
        return {"batch": len(self.batches)}

    def _next(self) -> list[tuple]:
        """New archives for a batch; the folder is listed only when none of its last listing wait, or listings grow with their square."""
        store, _ = _store(_split(self.path)[0])
        while True:
            if not self.waiting:
                self.waiting = [e for e in self._entries() if e not in self.known]
            some, self.waiting = self.waiting[: self.most], self.waiting[self.most :]
            # as they are now: what was listed may have changed since, or gone
            found = store.get_file_info([path for path, _, _ in some]) if some else []
            now = [(f.path, f.size, f.mtime_ns or 0) for f in found if f.type == pyarrow.fs.FileType.File]
            new = [e for e in now if e not in self.known]
            if new or not some:
                return new

    def partitions(self, start: dict, end: dict) -> list[Runs]:
        if self.log:
            self._read_log(end["batch"])
            new = [e for batch in self.batches[start["batch"] : end["batch"]] for e in batch]
        else:
            before = {tuple(e) for e in json.loads(start["seen"])}
            new = [e for e in map(tuple, json.loads(end["seen"])) if e not in before]
        return self.reader.runs(new, max(1, -(-min(len(new), 16000) // 16)))

    def read(self, runs: Runs) -> Iterator[tuple]:
        return self.reader.read(runs)


class Strongbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strongbox"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("mode", "data")]

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options, self.options.get("mode", "data"))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options, overwrite)

    def streamReader(self, schema: StructType) -> ArchiveStream:  # noqa: N802
        return ArchiveStream(self.options)


def register(spark) -> None:
    spark.dataSource.register(Strongbox)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
