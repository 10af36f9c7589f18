"""Block planning: byte sequences as rows of power-of-two blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import ceil_div


def block_plan(files: DataFrame, size: Column, block_exp, keys: list[str], keep_empty: bool = False) -> DataFrame:
    """keys, block_idx, block_offset, size, is_last, is_partial of each file's blocks.

    Only the last block may be shorter.  A file of no bytes has no block, or one
    empty partial block with ``keep_empty``.  A null size counts as none.  The
    plan is a generator over the file's row: no shuffle, whatever the file's size.
    """
    exp = F.lit(block_exp) if isinstance(block_exp, int) else block_exp
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), exp.cast("int"))
    rows = files.select(*keys, F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("_size"), unit.alias("_unit"))
    rows = rows.withColumn("_n", ceil_div(F.col("_size"), F.col("_unit")))
    if keep_empty:
        rows = rows.withColumn("_n", F.greatest("_n", F.lit(1).cast("long")))
    rows = rows.where("_n > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("block_idx"))
    offset = F.col("block_idx") * F.col("_unit")
    length = F.least("_unit", F.col("_size") - offset)
    return rows.select(
        *keys, "block_idx", offset.alias("block_offset"), length.alias("size"),
        (F.col("block_idx") == F.col("_n") - 1).alias("is_last"), (length < F.col("_unit")).alias("is_partial"),
    )


def physical_offsets(blocks: DataFrame, keys: list[str], physical: str = "physical_size") -> DataFrame:
    """With header_off: where each block's header stands in its archive."""
    before = Window.partitionBy(*keys).orderBy("block_idx").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("header_off", F.coalesce(F.sum(F.col(physical) + 64).over(before), F.lit(0)) + 32)


def data_offsets(blocks: DataFrame, keys: list[str], size: str = "size") -> DataFrame:
    """With data_off: where each block's data begins in its file, which is where its hash counts from."""
    before = Window.partitionBy(*keys).orderBy("block_idx").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("data_off", F.coalesce(F.sum(size).over(before), F.lit(0).cast("long")))


def block_room(size: Column, block_exp: int) -> dict[str, Column]:
    """Whether a block of so many bytes is full, or empty."""
    return {"full": size >= (1 << block_exp), "empty": size == 0}


def state_resets(chunks: DataFrame, keys: list[str], order: str, raw: Column) -> DataFrame:
    """With reset: a coded chunk's state starts anew, as it is the first or stands behind a raw one."""
    along = Window.partitionBy(*keys).orderBy(order)
    return chunks.withColumn("reset", F.coalesce(F.lag(raw).over(along), F.lit(True)))


def partial_order(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks that stand behind a partial block, which no valid archive has."""
    order = Window.partitionBy(*keys).orderBy("block_idx")
    return blocks.withColumn("_before", F.lag("is_partial").over(order)).where("_before").drop("_before")


def tree_shape(n: Column) -> dict[str, Column]:
    """Of a tree over n leaves: stack height after the last push, its merges, merges in all."""
    return {"stack": F.bit_count(n), "last_merges": F.bit_count(n.bitwiseAND(-n) - 1), "merges": F.greatest(n - 1, F.lit(0).cast("long"))}
