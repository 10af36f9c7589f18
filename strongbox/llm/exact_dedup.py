"""Exact deduplication by content hash, with a byte comparison inside groups.

Rows are grouped by the first 128 bits of the SHA-256 of the text.  Every row
of a group is then compared byte for byte with the row that stays; rows that
differ (hash collisions) are regrouped by the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .work import written


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    normalise=lambda text: text,
    hash_bits: int = 128,
    most_broadcast: int = 1_000_000,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep`` is ``min`` or ``max``: which id of a group stays.  ``normalise``
    maps the text column to what is compared.  A null text counts as empty.
    Rows that repeat an id and a text form a group like any other; each of them
    that carries the kept id is marked kept.
    Null ids never win against an id.  An empty table gives an empty result.
    Other columns are ignored, whatever their names.

    The group table is aggregated map-side before its shuffle, so a text that
    makes up a third of the rows arrives as one partial row per task.  Up to
    ``most_broadcast`` groups of several rows are broadcast, as counted, so that
    only texts with copies are dealt out to be compared; beyond it all are dealt.
    The join that brings the kept text to the rows has an exchange of its own on
    either side, which lets adaptive execution split a hot group over many tasks.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    best = F.min if keep == "min" else F.max
    text = F.coalesce(normalise(F.col(text_col)), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    rows = rows.select("_id", "_text", F.sha2("_text", 256).alias("_sha"))
    rows = rows.withColumn("_key", F.substring("_sha", 1, hash_bits // 4))

    groups = (
        rows.groupBy("_key")
        .agg(F.count(F.lit(1)).alias("_n"), best("_id").alias("_keep"))
        .where("_n > 1")
    )
    groups = written(groups.select(F.concat("_key", F.lit("")).alias("_gkey"), "_n", "_keep"), "exact-groups")
    few = groups.count() <= most_broadcast
    known = F.broadcast(groups) if few else groups
    on = F.col("_key") == F.col("_gkey")
    copies = rows.join(known, on).drop("_gkey")
    stays = copies.where(F.col("_id").eqNullSafe(F.col("_keep")))
    # one row for each group, also where the kept id is repeated
    stays = stays.groupBy("_key").agg(F.first("_text").alias("_ktext"))
    # another expression than the grouping key: the join then gets its own exchange
    stays = stays.select(F.concat("_key", F.lit("")).alias("_gkey"), "_ktext")
    met = copies.join(stays, on, "left").select(
        "_id",
        "_sha",
        "_key",
        "_n",
        "_keep",
        F.coalesce(F.col("_text") == F.col("_ktext"), F.lit(True)).alias("_same"),
        F.when(F.col("_text") != F.col("_ktext"), F.col("_text")).alias("_other"),
    )
    none = F.lit(None)
    alone = rows.join(known, on, "left_anti").select(
        "_id", "_sha", "_key", none.cast("long").alias("_n"), none.cast(docs.schema[id_col].dataType).alias("_keep"), F.lit(True).alias("_same"), none.cast("string").alias("_other")
    )
    met = written(met.unionByName(alone), "exact-met")
    same, other = met.where("_same"), met.where("NOT _same")
    keep_id: Column = F.coalesce("_keep", "_id")
    if other.isEmpty():
        out = same.select("_id", "_sha", keep_id.alias("_keep"), F.coalesce("_n", F.lit(1)).alias("_n"))
    else:
        fewer = other.groupBy("_key").agg(F.count(F.lit(1)).alias("_m"))
        out = same.join(fewer, "_key", "left").select(
            "_id",
            "_sha",
            keep_id.alias("_keep"),
            (F.coalesce("_n", F.lit(1)) - F.coalesce("_m", F.lit(0))).alias("_n"),
        )
        exact = other.groupBy("_key", "_other").agg(F.count(F.lit(1)).alias("_en"), best("_id").alias("_ekeep"))
        exact = exact.select(F.col("_key").alias("_ek"), F.col("_other").alias("_eo"), "_en", "_ekeep")
        on = (F.concat("_key", F.lit("")) == F.concat("_ek", F.lit(""))) & (F.col("_other") == F.col("_eo"))
        out = out.unionByName(
            other.join(exact, on).select("_id", "_sha", F.col("_ekeep").alias("_keep"), F.col("_en").alias("_n"))
        )
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs, keep="max")


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g ON t.text = g.text
"""
