"""Token ids in binary files: frequency-ranked ids, byte-aligned, separate control bytes.

File format (version 1, little endian, one block per file):

====================  =========================================================
``TOKB`` 01           magic and version
u32 n_docs            documents in the file
u64 n_ids             ids in the file
u32 n_ranks           distinct ids
u32 x n_ranks         the ids by falling frequency (ties: smaller id first)
i64 x n_docs          doc_id of each document (i64 minimum: null)
u32 x n_docs          ids of each document
u32 n_data            data bytes
ceil(n_ids/4) bytes   control: two bits an id, low bits first, bytes less one
n_data bytes          data: each id's rank in 1 to 4 bytes
====================  =========================================================

As ranks are by frequency, common ids take one byte.  A file decodes by itself.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame, Window, functions as F

from .wordhash import slices
from .work import new_folder

_HEAD = struct.Struct("<4sBIQI")
_NULL = np.iinfo(np.int64).min
_LATIN = "".join(c for c in map(chr, range(0x24F)) if regex.match(r"\p{L}", c))
# fixed values: the split pattern of the vocabulary file, for text of ASCII and Latin letters
_SPLIT = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^ \t\n\r\f\v{_LATIN}0-9]+"
    r"|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"
)
_OTHER = re.compile(rf"[^\x00-\x1b\x20-\x7f{_LATIN}]")
_PLAIN = re.compile(rf" [{_LATIN}]+")
# for each control byte: the lengths of its four ranks
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def encode_block(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The file for documents of ``counts`` ids each."""
    freq = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    by_freq = np.argsort(-freq, kind="stable")
    table = by_freq[freq[by_freq] > 0].astype("<u4")
    rank_of = np.zeros(len(freq), np.uint32)
    rank_of[table] = np.arange(len(table), dtype=np.uint32)
    ranks = rank_of[ids]
    sizes = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    padded[: len(ids)] = sizes - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    at = np.cumsum(sizes, dtype=np.int64) - sizes
    data = np.zeros(int(sizes.sum(dtype=np.int64)), np.uint8)
    for k in range(4):
        has = sizes > k
        if not has.any():
            break
        data[at[has] + k] = (ranks[has] >> np.uint32(8 * k)) & np.uint32(0xFF)
    return b"".join((
        _HEAD.pack(b"TOKB", 1, len(doc_ids), len(ids), len(table)),
        table.tobytes(), doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(),
        struct.pack("<I", len(data)), control.tobytes(), data.tobytes(),
    ))


def decode_block(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, counts and ids (u32) of a file, by table lookup on its control bytes."""
    magic, version, n_docs, n_ids, n_ranks = _HEAD.unpack_from(blob)
    if magic != b"TOKB" or version != 1:
        raise ValueError("not a token file of version 1")
    at = _HEAD.size
    table = np.frombuffer(blob, "<u4", n_ranks, at)
    doc_ids = np.frombuffer(blob, "<i8", n_docs, at := at + 4 * n_ranks)
    counts = np.frombuffer(blob, "<u4", n_docs, at := at + 8 * n_docs)
    (n_data,) = struct.unpack_from("<I", blob, at := at + 4 * n_docs)
    control = np.frombuffer(blob, np.uint8, -(-n_ids // 4), at := at + 4)
    data = np.frombuffer(blob, np.uint8, n_data, at + len(control))
    sizes = _LENGTHS[control].reshape(-1)[:n_ids]
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    ranks = np.zeros(n_ids, np.uint32)
    for k in range(4):
        has = np.flatnonzero(sizes > k) if k else slice(None)
        if k and not len(has):
            break
        ranks[has] |= data[starts[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return doc_ids, counts, table[ranks] if n_ids else np.zeros(0, np.uint32)


class Encoder:
    """The tokenizers library behind a table of the pieces that its pre-tokenizer splits.

    Byte-level BPE never merges across pieces, so a text's ids are its pieces'
    ids in turn; each distinct piece goes through the library once.  A text with
    other characters than ASCII and Latin letters, or with the string of an added
    token, goes through the library whole.  The
    table is emptied when it holds ``most`` pieces, which bounds memory only.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocab = self.library.get_vocab()
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)  # a byte is a character of its own in the vocabulary
        self.bytes[list(vocab.values())] = [len(x) for x in vocab]
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces.  Those of a space and letters go through the library as one
        text, which its pre-tokenizer splits into the same pieces; the bytes of the ids
        then tell where a piece ends."""
        plain, rest = [], []
        for p in pieces:
            (plain if _PLAIN.fullmatch(p) else rest).append(p)
        ids = np.array(self.library.encode_batch_fast(["".join(plain)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(p.encode()) for p in plain])) + 1
        size = np.diff(ends, prepend=0) if plain else np.zeros(0, np.int64)
        if rest:
            found = [x.ids for x in self.library.encode_batch_fast(rest, add_special_tokens=False)]
            ids = np.concatenate([ids, *(np.array(x, np.int64) for x in found)])
            size = np.concatenate([size, [len(x) for x in found]])
        first, n = len(self.codes), len(pieces)
        self.codes.update(zip(plain + rest, range(first, first + n), strict=True))
        while first + n > len(self.at):
            self.at, self.size = (np.concatenate([v, np.zeros_like(v)]) for v in (self.at, self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[first : first + n] = size
        self.at[first : first + n] = self.used + np.cumsum(size) - size
        self.used += len(ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [None if _OTHER.search(t) or any(s in t for s in self.special) else _SPLIT.findall(t) for t in texts]
        pieces = list(chain.from_iterable(x for x in split if x))
        codes = np.fromiter(map(self.codes.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(codes < 0)
        if len(new):
            words = {pieces[k] for k in new.tolist()}
            if len(self.codes) + len(words) > self.most:
                self.clear()
                words, new = set(pieces), np.arange(len(pieces))
            self._learn(list(words))
            codes[new] = [self.codes[pieces[k]] for k in new.tolist()]
        size, at = self.size[codes], self.at[codes]
        ends = np.cumsum(size)
        flat = self.flat[np.repeat(at - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        ends = np.concatenate([[0], ends])[np.cumsum([0, *(len(x) if x else 0 for x in split)])]
        return [
            np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) if x is None else flat[a:b]
            for t, x, a, b in zip(texts, split, ends[:-1].tolist(), ends[1:].tolist(), strict=True)
        ]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    ids_in_file: int = 2_000_000,
) -> DataFrame:
    """Encode every whole text and write the files; one row per file.

    Texts are dealt out by ranges of the id and sorted (null ids first, equal
    ids by text), so that the files, in the order of their names, hold the
    documents by ascending id.  A file is closed at ``ids_in_file`` ids or more;
    a longer text has a file of its own.  The name of a file comes from its
    partition and number alone, and a file appears under its name only when
    whole: a task that runs again writes the same file again.

    ``folder`` is a URI that every executor can write to.  A null text is empty
    and has the end id only.  An empty table has no file.  Returns part, number,
    n_docs, n_ids.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    conf = docs.sparkSession.conf
    parts = max(int(conf.get("spark.sql.shuffle.partitions")), 1)
    # the sampled sort keys reach the driver: a hash stands in for the text there
    dealt = rows.repartitionByRange(parts, F.col("i"), F.xxhash64("t")).sortWithinPartitions("i", "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, number, encoder = context.partitionId(), 0, _encoder(tokenizer)
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        names, held, total = [], [], 0

        def close() -> None:
            nonlocal number, held, total
            if not held:
                return
            blob = encode_block(
                np.array([d for d, _ in held], np.int64),
                np.array([len(x) for _, x in held], np.int64),
                np.concatenate([x for _, x in held]),
            )
            name = f"{base}/part-{part:06d}-{number:06d}.tok"
            with store.open_output_stream(f"{name}.{context.taskAttemptId()}") as out:
                out.write(blob)
            if store.get_file_info(name).type != pyarrow.fs.FileType.NotFound:
                store.delete_file(name)  # of an attempt that failed later; not every store moves onto a file
            store.move(f"{name}.{context.taskAttemptId()}", name)
            names.append((part, number, len(held), total))
            number, held, total = number + 1, [], 0

        for batch in batches:
            for some in slices(batch, 1, 1 << 20):
                texts = encoder.encode(some.column(1).to_pylist())
                for doc, found in zip(some.column(0).to_pylist(), texts, strict=True):
                    held.append((_NULL if doc is None else doc, np.append(found, np.uint32(end_id))))
                    total += len(found) + 1
                    if total >= ids_in_file:
                        close()
        close()
        columns = [pa.array([n[k] for n in names], pa.int64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "number", "n_docs", "n_ids"])

    return dealt.mapInArrow(write, "part long, number long, n_docs long, n_ids long")


def read_token_files(spark, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32.

    Each file is decoded by itself; a document's start is the ids of the files
    before its own plus those before it in its file.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder)
        .select(F.regexp_extract("path", r"part-(\d+-\d+)\.tok$", 1).alias("file"), "content")
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, counts, ids = decode_block(blob.as_buffer())
                ends = np.cumsum(counts, dtype=np.int64)
                crc = [zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file] * len(docs)), pa.array(docs, mask=docs == _NULL), pa.array(ends - counts),
                        pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64()), pa.array(np.full(len(docs), ends[-1])),
                    ],
                    names=["file", "doc_id", "start", "n_tokens", "ids_crc32", "n_ids"],
                )

    return files.mapInArrow(decode, "file string, doc_id long, start long, n_tokens long, ids_crc32 long, n_ids long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, **columns) -> DataFrame:
    """Write ``docs`` as token files and read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    store, base = pyarrow.fs.FileSystem.from_uri(folder)
    store.create_dir(base)
    # one row per file reaches the driver's job, not the texts; the action is what writes
    written = write_token_files(docs, tokenizer, folder, end_id, **columns)
    written.write.parquet(f"{folder}/files")
    sizes = spark.read.parquet(f"{folder}/files").select(
        F.format_string("%06d-%06d", "part", "number").alias("file"), "part", "number", "n_ids"
    )
    # starts of files: a running sum over parts, then inside a part; a row per file, never per document
    per_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("p"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.select("part", F.coalesce(F.sum("p").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(per_part, "part").select(
        "file", (F.col("before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("base")
    )
    return read_token_files(spark, folder).join(starts, "file").select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"
    )


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_files(docs, public_tokenizers.path("byte_bpe_50k.json"))
