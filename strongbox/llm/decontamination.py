"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask keeps some of the positions of a span of words and ignores the others.
The kept words of every span of every benchmark item and of every document are
hashed and the hashes joined.  A hit puts an item on a diagonal of a document;
the words along it are compared, and a window with few substitutions settles it.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from .work import written

# Of every window of 13 words with up to 2 others, one of these finds a span (see misses()).
MASKS = ((0, 1, 2, 3, 6, 7), (0, 1, 3, 5, 6, 7))


def misses(masks, window: int, subs: int) -> list[tuple[int, ...]]:
    """The ways to put up to ``subs`` substitutions into a window that no mask survives."""
    places = [[{s + m for m in mask} for s in range(window - mask[-1])] for mask in masks]
    ways = (c for k in range(subs + 1) for c in combinations(range(window), k))
    return [c for c in ways if all(p & set(c) for one in places for p in one)]


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def hashed_words(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def spans(t: Column, masks, lengths=()) -> Column:
    """For each place in an array of hashed words, the hashes of the masks' words from there, and
    of as many words as each of ``lengths`` says."""

    def at(_, i):
        found = []
        for k, mask in enumerate([*masks, *(range(n) for n in lengths)]):
            kept = [F.get(t, i + m) for m in mask]
            # a null last word: the span leaves the text
            name = k if k < len(masks) else -len(kept)
            found.append(F.when(kept[-1].isNotNull(), F.xxhash64(F.lit(name), *kept)).alias(f"h{k}"))
        return F.array(*found)

    return F.transform(t, at)


def hits(docs: DataFrame, items: DataFrame, masks, most_broadcast: int) -> DataFrame:
    """Distinct (_id, _item, _diagonal) of spans that a document and an item share.

    Items too short for the masks are one span of all their words; documents are
    hashed at those lengths, fewer than the masks' span, that there are.
    """
    span = max(m[-1] for m in masks) + 1
    short = items.where(F.size("_t") < span)
    lengths = sorted(r[0] for r in short.select(F.size("_t")).distinct().collect())

    def exploded(rows: DataFrame, key: str, place: str, sizes=()) -> DataFrame:
        places = rows.select(key, F.posexplode(spans(F.col("_t"), masks, sizes)).alias(place, "_all"))
        return places.select(key, place, F.explode("_all").alias("_h")).where("_h IS NOT NULL")

    seeds = exploded(items, "_item", "_ipos")
    if lengths:
        whole = F.coalesce(*(F.when(F.size("_t") == n, F.xxhash64(F.lit(-n), *(F.get("_t", F.lit(k)) for k in range(n)))) for n in lengths))
        seeds = seeds.unionByName(short.select("_item", F.lit(0).alias("_ipos"), whole.alias("_h")))
    # the table of seeds is broadcast only if it is small as counted; otherwise Spark deals both sides by hash
    if seeds.count() <= most_broadcast:
        seeds = F.broadcast(seeds)
    found = exploded(docs, "_id", "_pos", lengths).join(seeds, "_h")
    return found.select("_id", "_item", (F.col("_pos") - F.col("_ipos")).alias("_diagonal")).distinct()


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    subs: int = 2,
    masks=MASKS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    most_broadcast: int = 500_000,
) -> DataFrame:
    """One row per document and benchmark item that overlap: id, item, matched (words on the best diagonal).

    They overlap if ``window`` words in a row of the item stand in the document
    with at most ``subs`` substitutions.  An item of fewer words has to stand in the
    document whole and unchanged; one without words overlaps with nothing.  Case, punctuation and white space don't count.
    Null and empty texts overlap with nothing; rows that repeat an id are judged
    together; null ids are left out.  Other columns are ignored.
    """
    if gaps := misses(masks, window, subs):
        raise ValueError(f"these masks miss {len(gaps)} ways of {subs} substitutions in {window} words")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    hashed = rows.select("_id", hashed_words(F.col("_text")).alias("_t"))
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("_item"), hashed_words(F.col(item_text_col)).alias("_t"))
    items = items.where(F.size("_t") > 0)
    # written once: its size then says whether the texts have to be dealt by id to meet their hits
    found = written(hits(hashed, items, masks, most_broadcast), "seed-hits")
    if found.count() <= most_broadcast:
        found = F.broadcast(found)

    # the words along a diagonal, from the first place that both texts have
    along = hashed.withColumnRenamed("_t", "_dt").join(found, "_id").join(items.withColumnRenamed("_t", "_it"), "_item")
    skip = F.greatest(-F.col("_diagonal"), F.lit(0))
    dt = F.expr("slice(_dt, greatest(_diagonal, 0) + 1, size(_it))")
    it = F.expr("slice(_it, greatest(-_diagonal, 0) + 1, size(_it))")
    along = along.select("_id", "_item", F.size("_it").alias("_n"), skip.alias("_skip"), dt.alias("_a"), it.alias("_b"))
    along = along.withColumn("_m", F.expr("zip_with(_a, _b, (a, b) -> if(a <=> b AND a IS NOT NULL, 1, 0))"))
    total = F.expr("aggregate(_m, 0, (s, x) -> s + x)")
    near = F.expr(
        f"CASE WHEN _n < {window} THEN _total = _n WHEN _total < {window - subs} OR size(_m) < {window} THEN false "
        f"ELSE exists(sequence(1, size(_m) - {window - 1}), i -> aggregate(slice(_m, i, {window}), 0, (s, x) -> s + x) >= {window - subs}) END"
    )
    kept = along.withColumn("_total", total).where(near).groupBy("_id", "_item").agg(F.max("_total").alias("matched"))
    return kept.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), "matched")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per row of ``docs``: id, contaminated, n_items, matched (most words on a diagonal)."""
    found = overlaps(docs, benchmark, id_col=id_col, **options).groupBy(F.col(id_col).alias("_id"))
    found = found.agg(F.count(F.lit(1)).alias("n_items"), F.max("matched").alias("matched"))
    return docs.select(id_col).join(found, F.col(id_col) == F.col("_id"), "left").select(
        id_col,
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("matched", F.lit(0)).alias("matched"),
    )


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


# fixed values: the defaults of overlaps(), window 13 and 2 substitutions
ORACLE = r"""
WITH dl AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
il AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
dw AS (SELECT doc_id, len(w) AS dn, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM dl),
iw AS (SELECT item_id, len(w) AS n, unnest(w) AS w, generate_subscripts(w, 1) AS ip FROM il),
m AS (SELECT doc_id, item_id, n, dn, p - ip AS g, ip FROM dw JOIN iw USING (w)),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, g ORDER BY ip RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS near,
        count(*) OVER (PARTITION BY doc_id, item_id, g) AS total,
        least(n, dn - g) - greatest(1, 1 - g) + 1 AS common FROM m),
hit AS (SELECT doc_id, item_id, max(total) AS matched FROM c
        WHERE CASE WHEN n < 13 THEN total = n ELSE common >= 13 AND near >= 11 END GROUP BY doc_id, item_id),
per AS (SELECT doc_id, count(*) AS n_items, max(matched) AS matched FROM hit GROUP BY doc_id)
SELECT d.doc_id, per.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(matched, 0)::INT AS matched
FROM documents d LEFT JOIN per ON per.doc_id = d.doc_id
"""
