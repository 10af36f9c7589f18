"""Reed-Solomon parity and syndromes as joins and XOR aggregates, where no Python runs; parity of long values by the codec."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..codecs.gf import EXP, LOG
from ..codecs.rs import encode, generator_rows


def gf_multiply(a, b):
    """Product of two field elements in INT columns, by literal tables of logarithms and powers."""
    exp, log = F.lit([int(x) for x in EXP]), F.lit([int(x) for x in LOG])
    powers = F.get(log, a) + F.get(log, b)
    return F.when((a == 0) | (b == 0), F.lit(0)).otherwise(F.get(exp, powers))


def bytes_of(rows: DataFrame, key: list[str], column: str) -> DataFrame:
    """key, place, byte of a BINARY column."""
    places = F.sequence(F.lit(0), F.octet_length(column) - 1)
    return rows.where(F.octet_length(column) > 0).select(*key, column, F.explode(places).alias("place")).select(
        *key, "place", F.conv(F.hex(F.substring(F.col(column), F.col("place") + 1, F.lit(1))), 16, 10).cast("int").alias("byte")
    )


def parity(rows: DataFrame, key: list[str], column: str, n: int, k: int) -> DataFrame:
    """key, parity (hexadecimal) of a BINARY column of k bytes each."""
    spark: SparkSession = rows.sparkSession
    shares = [(i, j, int(g)) for i, row in enumerate(generator_rows(n, k)) for j, g in enumerate(row) if g]
    table = spark.createDataFrame(shares, "place int, j int, share int")  # k * (n - k) rows
    found = bytes_of(rows, key, column).where("byte <> 0").join(F.broadcast(table), "place")
    bits = found.groupBy(*key, "j").agg(F.bit_xor(gf_multiply(F.col("byte"), F.col("share"))).alias("p"))
    full = rows.select(*key, F.explode(F.sequence(F.lit(0), F.lit(n - k - 1))).alias("j")).join(bits, [*key, "j"], "left")
    two = F.lpad(F.lower(F.hex(F.coalesce("p", F.lit(0)).cast("long"))), 2, "0")
    ordered = full.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("j", two.alias("x")))).alias("v"))
    return ordered.select(*key, F.array_join(F.transform("v", lambda v: v["x"]), "").alias("parity"))


def _coded_words(n: int, k: int):
    def coded(rows: list[int], values: list[bytes], keys: pa.Array) -> pa.RecordBatch:
        counts = np.array([max(1, -(-len(v) // k)) for v in values])
        padded = b"".join(v.ljust(int(c) * k, b"\0") for v, c in zip(values, counts, strict=True))
        found = encode(np.frombuffer(padded, np.uint8).reshape(-1, k), n, k).tobytes().hex()
        width, total = 2 * (n - k), int(counts.sum())
        places = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        ends = pa.py_buffer(np.arange(total + 1, dtype=np.int32) * width)
        texts = pa.StringArray.from_buffers(total, ends, pa.py_buffer(found.encode()))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(np.repeat(rows, counts))), pa.array(places), texts], names=["key", "word_idx", "parity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, data = batch.columns
            rows, values, size = [], [], 0
            for i, value in enumerate(data):
                rows.append(i)
                values.append(value.as_py() or b"")
                size += len(values[-1])
                if size >= 1 << 20 or len(rows) >= 10_000:
                    yield coded(rows, values, keys)
                    rows, values, size = [], [], 0
            if rows:
                yield coded(rows, values, keys)

    return run


def word_parity(rows: DataFrame, key: str, column: str, n: int, k: int) -> DataFrame:
    """key, word_idx, parity (hexadecimal) of every k bytes in turn of a BINARY column of any length.

    The last word is padded with zeros; an empty or null value is one word of
    zeros, so that every row is there.  A value becomes a row for each k bytes,
    which joins would deal out byte by byte; here they stay in their task.
    """
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, column).mapInArrow(_coded_words(n, k), f"key {kind}, word_idx long, parity string").withColumnRenamed("key", key)


def dirty_codewords(rows: DataFrame, key: list[str], column: str, n: int, k: int) -> DataFrame:
    """key, nonzero: how many syndromes of a stored codeword aren't zero."""
    exp = F.lit([int(x) for x in EXP])
    log = F.lit([int(x) for x in LOG])
    degree = F.when(F.col("place") < k, F.col("place") + (n - k)).otherwise(F.col("place") - k)
    terms = bytes_of(rows, key, column).where("byte <> 0").select(*key, F.get(log, F.col("byte")).alias("l"), degree.alias("d"))
    terms = terms.select(*key, "l", "d", F.explode(F.sequence(F.lit(1), F.lit(n - k))).alias("root"))
    s = terms.groupBy(*key, "root").agg(F.bit_xor(F.get(exp, (F.col("l") + F.col("root") * F.col("d")) % 255)).alias("s"))
    count = s.groupBy(*key).agg(F.sum((F.col("s") != 0).cast("long")).alias("nonzero"))
    return rows.select(*key).join(count, key, "left").select(*key, F.coalesce("nonzero", F.lit(0)).alias("nonzero"))
