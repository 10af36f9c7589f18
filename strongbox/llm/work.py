"""Work tables: reliable, shared, lineage-cutting intermediates.

Executors can be lost at any time, so an intermediate that several later steps
read is written as Parquet below ``spark.checkpoint.dir`` -- a folder that all
executors share -- and read back.  Nothing is ever kept in an executor's own
folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def work_root(spark: SparkSession) -> str:
    """The shared folder for intermediates.

    Reads ``spark.checkpoint.dir`` from the session.  Only a local master may go
    without it (tests), with a folder under the system's temporary folder.  On a
    cluster a missing setting is an error, as a machine-local folder
    would lose data.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "strongbox-work")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark)}/strongbox/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back from there."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def trim() -> None:
    """Give memory that a Python worker no longer uses back to the system, at the end of a task.

    Workers stay for later tasks beside the JVM; what their allocators keep would
    count against the executor meanwhile.
    """
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call, and needs none
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_or_text(docs: DataFrame, id_col: str, text_col: str, last: bool = False):
    """A LONG column that stands for the id, and a function that turns it back into the id.

    Rows without id get a number of their text's hash (62 bits), smaller than all
    ids, or with ``last`` larger.  Ids in that quarter of the numbers are an error
    if, and only if, there are rows without id.
    """
    own = F.col(id_col).cast("long")
    low, high, nulls = docs.select(own.alias("i")).agg(F.min("i"), F.max("i"), F.count_if(F.col("i").isNull())).first()
    if not nulls:
        return own, lambda c: c
    edge = 2**62
    if low is not None and (high >= edge if last else low < -edge):
        raise ValueError(f"{id_col} is null in {nulls} rows, and other ids reach into the range that stands for null ids")
    number = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), 2) + F.lit(edge if last else -(2**63))
    return F.coalesce(own, number), lambda c: F.when(c < edge if last else c >= -edge, c)


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest 64-bit hash in column ``key``.

    Rows beyond three times the bound are left out by the hash's range first, so
    that what partitions send together stays in proportion to the bound and not
    to the table.
    """
    n = rows.count()
    if n > 3 * most:
        rows = rows.where(rows[key] < int(-(2**63) + 2**64 * (3 * most / n)))
    return rows.orderBy(*[key, *(c for c in rows.columns if c != key)]).limit(most)


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", most_broadcast: int = 1_000_000) -> DataFrame:
    """``docs`` without the rows whose id is in ``dropped``'s only column.

    The ids are written and counted; up to ``most_broadcast`` of them are
    broadcast, so that texts stay where they are; more are joined by id.
    Rows with a null id stay.
    """
    ids = written(dropped.toDF("_dropped").where("_dropped IS NOT NULL").distinct(), "dropped")
    few = ids.count() <= most_broadcast
    return docs.join(F.broadcast(ids) if few else ids, docs[id_col] == ids["_dropped"], "left_anti")
