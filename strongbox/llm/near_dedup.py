"""Near-duplicate classes by order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles, each labelled with how often it
has occurred before.  A sketch takes the shingles with the least hashes and keeps
them in text order, so that it is equal for two texts with the probability that
their least shingles are shared and stand in the same order.  Texts that share a
sketch are candidates.  A candidate pair is linked if the longest common
subsequence of the labelled shingles, within the band of shifts that the wanted
similarity leaves open, holds at least that share of both texts' shingles
together.  Classes are the connected components of the links.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .wordhash import buffers, mix, slices, window_hashes, word_hashes, word_spans
from .work import id_or_text, trim, written



def _labelled(hashes: np.ndarray) -> np.ndarray:
    """Hashes made distinct by the number of equal ones before them."""
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    at = np.arange(len(s))
    seen = at - np.maximum.accumulate(np.where(first, at, 0))
    out = np.empty_like(hashes)
    with np.errstate(over="ignore"):
        out[order] = s + seen.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return out


def shingle_rows(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The labelled shingles of each text in order; a text of fewer words is one shingle of all."""
    raw, offsets = buffers(texts)
    first, end, at = word_spans(raw, offsets)
    hashes = word_hashes(raw, first, end)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = max(min(width, b - a), 0)
        starts = np.arange(max(b - a - width + 1, 1)) if n else np.zeros(0, np.int64)
        if not n:
            yield np.zeros(1, np.uint64)
        else:
            yield _labelled(window_hashes(hashes[a:b], starts, n) + np.uint64(n != width))


def sketches(shingles: np.ndarray, count: int, least: int) -> np.ndarray:
    """``count`` order MinHash sketches of ``least`` shingles each."""
    n, take = len(shingles), min(least, len(shingles))
    out = np.empty(count, np.uint64)
    step = max(1, 500_000 // n)
    with np.errstate(over="ignore"):
        for at in range(0, count, step):
            seeds = mix(np.arange(at, min(at + step, count), dtype=np.uint64), 3)[:, None]
            h = (shingles[None, :] ^ seeds) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xA0761D6478BD642F)
            least_at = np.argpartition(h, take - 1, axis=1)[:, :take] if take < n else np.broadcast_to(np.arange(n), h.shape)
            kept = shingles[np.sort(least_at, axis=1)]  # in text order
            value = seeds[:, 0]
            for k in range(take):
                value = mix(value ^ kept[:, k], 17)
            out[at : at + len(seeds)] = value
    return out


def aligned_similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Share of two texts' labelled shingles that a banded alignment matches; 0 where it can't reach the threshold."""
    total = len(a) + len(b)
    need = int(np.ceil(threshold * total / (1 + threshold) - 1e-9))
    if min(len(a), len(b)) < need:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = max(len(a), len(b)) - need  # a match that far off the diagonal leaves too few others
    inside = np.abs(i - j) <= band
    i, j = i[inside], j[inside]
    if len(i) < need:
        return 0.0
    j = j[np.argsort(i)]
    if np.all(j[1:] > j[:-1]):
        common = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        common = len(tails)
    return common / (total - common)


def _sketch_rows(width: int, count: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                found = [sketches(s, count, least).tobytes() for s in shingle_rows(part.column(1), width)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["doc", "sketch"])
        trim()

    return run


def _shingles_of(width: int):
    """(shingle, doc, n) of every labelled shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                found = list(shingle_rows(part.column(1), width))
                sizes = np.array([len(x) for x in found], np.int64)
                docs = np.repeat(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), sizes)
                columns = [pa.array(np.concatenate(found).view(np.int64)), pa.array(docs), pa.array(np.repeat(sizes, sizes))]
                yield pa.RecordBatch.from_arrays(columns, names=["shingle", "doc", "n"])
        trim()

    return run


def _pairs_of_cell(side: np.ndarray, comp: np.ndarray, doc: np.ndarray, n: np.ndarray, rank: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of documents that hold one shingle, of different components and, if there are two, of
    different sides, that can reach the threshold if the shingle is the first that they share:
    behind it either has to hold enough."""
    rest = n - rank + 1
    one = (side == side[0]).all()
    # the shorter text of a pair needs what two texts of its size would
    tight = np.flatnonzero(rest >= np.ceil(2 * threshold / (1 + threshold) * n - 1e-9))
    for at in range(0, len(tight), 256):
        i = tight[at : at + 256]
        need = np.ceil(threshold / (1 + threshold) * (n[i][:, None] + n[None, :]) - 1e-9)
        fits = (comp[i][:, None] != comp[None, :]) & (np.minimum(rest[i][:, None], rest[None, :]) >= need)
        if not one:
            fits &= side[i][:, None] != side[None, :]
        x, y = np.nonzero(fits)
        a, b = doc[i[x]], doc[y]
        yield np.maximum(a, b), np.minimum(a, b)


def _across(threshold: float):
    """_pairs_of_cell of rows (shingle, cell, side, comp, doc, n, rank) sorted by shingle and cell; a cell is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _and_end(batches):
            if batch is not None:
                rows = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(7)]
                held = rows if held is None else [np.concatenate(p) for p in zip(held, rows, strict=True)]
            if held is None or not len(held[0]):
                continue
            edges = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0)) + 1
            edges = [0, *edges.tolist()] if batch is not None else [0, *edges.tolist(), len(held[0])]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                part = [c[low:high] for c in held[2:]]
                if (part[1] != part[1][0]).any():
                    for a, b in _pairs_of_cell(*part, threshold):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            held = [c[edges[-1] :] for c in held]

    return run


def _and_end(batches):
    yield from batches
    yield None


def _verify(width: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 1 << 20):
                left = shingle_rows(part.column(2), width)
                right = shingle_rows(part.column(3), width)
                close = [aligned_similarity(a, b, threshold) >= threshold for a, b in zip(left, right, strict=True)]
                close = pa.array(close, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(close), part.column(1).filter(close)], names=["a", "b"])
        trim()

    return run


def _small(side: DataFrame, most_broadcast: int) -> DataFrame:
    """A written table, broadcast if its rows as counted are few enough."""
    return F.broadcast(side) if side.count() <= most_broadcast else side


def components(links: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """doc, comp (the least id it is connected to) for every id in ``links`` (a, b).

    Each round takes the least component among a document and its neighbours and
    then that component's own; rounds go on until none changes.  Every table of a
    round is written to the shared folder.
    """
    both = links.union(links.select("b", "a"))
    both = written(both.union(links.select("a", F.col("a").alias("b"))).union(links.select("b", F.col("b").alias("a"))).distinct(), "near-links")
    labels = written(both.groupBy(F.col("a").alias("doc")).agg(F.min("b").alias("comp")), "near-comps")
    total = None
    while True:
        known = _small(labels, most_broadcast)
        seen = both.join(known.select(F.col("doc").alias("b"), "comp"), "b").groupBy(F.col("a").alias("doc")).agg(F.min("comp").alias("near"))
        jump = known.select(F.col("doc").alias("near"), F.col("comp").alias("further"))
        labels = written(seen.join(jump, "near").select("doc", F.col("further").alias("comp")), "near-comps")
        # components only ever fall, so their sum tells whether one did
        before, total = total, labels.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return labels


def merged(comps: DataFrame | None, links: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """``comps`` (doc, comp) after ``links`` (a, b): only the components that links join are searched anew."""
    if comps is None:
        return components(links, most_broadcast)
    known = _small(comps, most_broadcast)
    ends = links.join(known.select(F.col("doc").alias("a"), F.col("comp").alias("ca")), "a", "left")
    ends = ends.join(known.select(F.col("doc").alias("b"), F.col("comp").alias("cb")), "b", "left")
    ends = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    step = components(ends, most_broadcast)
    moved = comps.join(_small(step.select(F.col("doc").alias("from"), F.col("comp").alias("to")), most_broadcast), F.col("comp") == F.col("from"), "left")
    fresh = step.join(known.select("doc"), "doc", "left_anti")
    return written(moved.select("doc", F.coalesce("to", "comp").alias("comp")).unionByName(fresh), "near-merged")


def near_dedup(
    docs: DataFrame,
    width: int = 5,
    threshold: float = 0.8,
    count: int = 20,
    least: int = 3,
    turns: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_broadcast: int = 1_000_000,
    growth: int = 16,
    side_rows: int = 4096,
) -> DataFrame:
    """One row per row of ``docs``: id, class_id (the least id of its class), kept (it has that id).

    Words are runs of other bytes than 0x20 and 0x09-0x0D, unchanged.  A text of
    fewer than ``width`` words is one shingle; null, empty and blank texts have
    one empty shingle and form a class.  Equal texts are in one class and are
    searched once.  A null id counts as smaller than all and is returned as null;
    rows without id are documents of their own by their texts.
    Rows that repeat an id are one document if their texts are equal; ids are
    expected to be unique otherwise.  Other columns are ignored.

    Two texts at the threshold share a sketch with probability threshold **
    least, so all ``count`` are missed with probability (1 - threshold ** least)
    ** count: 6e-7 by default.  Candidates are never all pairs of a sketch: each
    sketch has a leader, and a document is verified with the leader that most of
    its sketches name.  Where a sketch's documents are still in different
    components, other leaders follow, in ``turns`` rounds.  Last,
    documents that share a sketch across components are joined on the rarest of
    their shingles, of which texts at the threshold share at least one far enough
    in front.  One link joins two components, so each component first puts ``growth``
    members a posting and class of size forward, then that many times as many, till
    the posting's components are one or all their members were compared: no link
    depends on which document happened to lead, and pairs inside a component are
    never made.  A posting of more than ``side_rows`` rows is dealt over tasks as
    pairs of its sides.  What can't be avoided this way is one comparison for every
    pair of *unlinked* texts that the rarest shingles and the sizes leave open.
    """
    doc, back = id_or_text(docs, id_col, text_col)
    rows = docs.select(doc.alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = rows.withColumn("key", F.sha2("text", 256))
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("head")).where("n > 1")
    groups = written(groups.select(F.concat("key", F.lit("")).alias("group"), "head"), "near-copies")
    few = groups.count() <= most_broadcast
    marked = keyed.join(F.broadcast(groups) if few else groups, F.col("key") == F.col("group"), "left")
    marked = marked.select("doc", F.coalesce("head", "doc").alias("head"), "text")
    single = marked.where("doc = head").select("doc", "text")

    drawn = written(single.mapInArrow(_sketch_rows(width, count, least), "doc long, sketch binary"), "near-sketches")
    # sketches that several documents share, with how many; what a document shares says how central it is
    places = F.sequence(F.lit(0), F.lit(count - 1))
    keys = F.transform(places, lambda k: F.conv(F.hex(F.substring(F.col("sketch"), k * 8 + 1, F.lit(8))), 16, -10).cast("long"))
    every = drawn.select("doc", F.explode(F.array_distinct(keys)).alias("key"))
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = written(every.join(shared.select(F.expr("key + 0").alias("open"), "n"), F.col("key") == F.col("open")).select("key", "doc", "n"), "near-own")
    central = written(own.groupBy("doc").agg(F.sum("n").alias("weight")), "near-central")

    busy = _small(central, most_broadcast)
    texts = written(single.join(busy, "doc", "left_semi").dropDuplicates(["doc"]), "near-texts")

    def linked(pairs: DataFrame) -> DataFrame:
        met = pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b")
        met = met.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a")
        return written(met.select("a", "b", "ta", "tb").mapInArrow(_verify(width, threshold), "a long, b long"), "near-linked")

    comps = None

    def placed() -> DataFrame:
        rows_ = own.join(busy, "doc")
        if comps is None:
            return rows_.select("key", "doc", "weight", F.col("doc").alias("comp"))
        return rows_.join(_small(comps, most_broadcast), "doc", "left").select("key", "doc", "weight", F.coalesce("comp", "doc").alias("comp"))

    # each sketch has a leader: at first its most central document, then ones drawn by how central they are
    for turn in range(turns):
        rows_ = placed()
        drawn_ = F.pmod(F.xxhash64("doc", F.lit(turn)), F.lit(1 << 20)) if turn else F.lit(1)
        lead = F.max(F.struct((F.col("weight") * drawn_).alias("w"), "doc", "comp")).alias("m")
        leads = rows_.groupBy("key").agg(lead, F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        leads = leads.select(F.expr("key + 0").alias("open"), F.col("m.doc").alias("b"), F.col("m.comp").alias("cb"))
        pairs = rows_.join(leads, F.col("key") == F.col("open")).where("comp <> cb")
        pairs = pairs.groupBy(F.col("doc").alias("a"), "b").agg(F.count(F.lit(1)).alias("votes"))
        pairs = pairs.groupBy("a").agg(F.max(F.struct("votes", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
        more = linked(pairs)
        if comps is None or not more.isEmpty():
            comps = merged(comps, more, most_broadcast)

    # the rest exactly: of documents that share a sketch across components, those that share
    # one of their rarest shingles, as texts at the threshold must
    rows_ = placed()
    spans = rows_.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    open_ = rows_.join(spans.select(F.expr("key + 0").alias("open")), F.col("key") == F.col("open"))
    apart = written(open_.select("doc").distinct(), "near-apart")
    shingles = texts.join(apart, "doc", "left_semi").select("doc", "text")
    shingles = shingles.mapInArrow(_shingles_of(width), "shingle long, doc long, n long")
    often = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select(F.expr("shingle + 0").alias("s"), "df")
    ranked = shingles.join(often, F.col("shingle") == F.col("s"), "left").withColumn("df", F.coalesce("df", F.lit(1)))
    order = Window.partitionBy("doc").orderBy("df", "shingle")
    prefix = ranked.withColumn("rank", F.row_number().over(order))
    prefix = prefix.where((F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1) & (F.col("df") > 1))
    # sizes at the threshold are in the same class of size or in adjoining ones
    size = F.floor(F.log(F.col("n")) / F.log(F.lit(1 / threshold)))
    postings = written(prefix.select("shingle", "doc", "n", "rank", size.alias("size")), "near-postings")

    def joined() -> DataFrame:
        return postings.join(_small(comps, most_broadcast), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))

    # one link between two components is enough: of each component a posting gives ``growth`` members
    # a turn, that many times as many the next time, till its components are one or all were tried
    members, before, tried = growth, 0, None
    while True:
        here = joined()
        groups_ = here.groupBy("shingle", "comp", "size").agg(F.count(F.lit(1)).alias("m"))
        spans = groups_.groupBy(F.expr("shingle + 0").alias("open")).agg(
            F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("m").alias("most"), F.sum(F.least("m", F.lit(members))).alias("rows")
        )
        spans = written(spans.where(f"low <> high AND most > {before}").select("open", "rows"), "near-open")
        if spans.isEmpty():
            break
        first = Window.partitionBy("shingle", "comp", "size").orderBy(F.xxhash64("doc"), "doc")
        here = here.withColumn("k", F.row_number().over(first)).where(F.col("k") <= members)
        here = here.join(_small(spans, most_broadcast), F.col("shingle") == F.col("open"))
        # a posting of many rows is dealt as the pairs of its sides
        sides = F.ceil(F.col("rows") / F.lit(side_rows)).cast("int")
        here = here.withColumn("side", F.pmod(F.xxhash64("doc", F.lit(9)), sides).cast("int"))
        here = here.withColumn("other", F.explode(F.sequence(F.lit(0), sides - 1)))
        cell = F.least("side", "other") * sides + F.greatest("side", "other")
        here = here.select("shingle", cell.alias("cell"), "side", "comp", "doc", "n", "rank")
        dealt = here.repartition(F.col("shingle"), F.col("cell")).sortWithinPartitions("shingle", "cell")
        pairs = dealt.mapInArrow(_across(threshold), "a long, b long").distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "near-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        more = linked(pairs)
        if not more.isEmpty():
            comps = merged(comps, more, most_broadcast)
        members, before = members * growth, members

    comps = comps.where("doc <> comp")
    n = comps.count()
    out = marked.select("doc", "head").join(F.broadcast(comps.withColumnRenamed("doc", "of")) if n <= most_broadcast else comps.withColumnRenamed("doc", "of"), F.col("head") == F.col("of"), "left")
    out = out.select("doc", F.coalesce("comp", "head").alias("class"))
    return out.select(back(F.col("doc")).alias(id_col), back(F.col("class")).alias("class_id"), (F.col("doc") == F.col("class")).alias("kept"))


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
