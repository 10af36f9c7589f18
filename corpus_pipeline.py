"""The corpus pipeline: from raw documents to sampled token sequences.

``STAGES`` are (name, function) in order; a function takes (spark, docs, sf_dir)
and returns the documents that stay, with the columns of ``docs``, and the last
one the token sequences.  ``run`` writes what a stage returns to the shared
folder and reads it back for the next.

Each stage has the nulls, empty and very long texts, ties and repeated rows of
its operator's docstring: rows without doc_id are judged by their text, and
give way to rows with one.  Null texts count as empty.  Other columns stay as
they are, nulls included, whatever their names but ``_sid``.  An empty table
gives an empty table.  No session setting is left changed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from strongbox.llm.decontamination import overlaps
from strongbox.llm.exact_dedup import exact_dedup
from strongbox.llm.near_dedup import near_dedup
from strongbox.llm.subword_sampling import sample_segmentations
from strongbox.llm.toxicity import fit, training_labels, without_toxic
from strongbox.llm.work import id_or_text, table, without, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; learned from the labels that op1 may learn from."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return without_toxic(docs, fit(docs.select("doc_id", "text"), training_labels(labels)))


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with _sid: doc_id, or a larger number that follows from the text."""
    return docs.withColumn("_sid", id_or_text(docs, "doc_id", "text", last=True)[0])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one of the smallest doc_id; of repeated rows one."""
    docs = identified(docs)
    found = written(exact_dedup(docs, id_col="_sid", keep="min").select("_sid", "kept"), "exact-kept")
    n, ids = found.where("kept").agg(F.count("_sid"), F.count_distinct("_sid")).first()
    out = without(docs, found.where("NOT kept").select("_sid"), "_sid")
    if n != ids:
        out = out.dropDuplicates(["_sid", "text"])
    return out.drop("_sid")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the one of the smallest doc_id."""
    docs = identified(docs)
    return without(docs, near_dedup(docs, id_col="_sid").where("NOT kept").select("_sid"), "_sid").drop("_sid")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    docs = identified(docs)
    return without(docs, overlaps(docs, table(spark, sf_dir, "benchmark"), id_col="_sid").select("_sid"), "_sid").drop("_sid")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Three sampled segmentations of each document."""
    return sample_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), slice_bytes=1 << 18)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontaminated),
    ("tokens", tokens),
]

#: SQL expresses neither the learned toxicity model nor the sampling; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
