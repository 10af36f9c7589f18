"""Removal of repeated word windows by difference-cover anchors.

Of each document, short windows are hashed at the positions whose remainder by a
period is in a difference cover.  Whatever their positions, two equal windows of
full length hold at least one such anchor at the same offset, so that windows
without a repeated anchor need no look; the others are extended to full windows,
hashed to 128 bits, and grouped to find the first of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .wordhash import buffers, slices, window_hashes, window_starts, word_hashes, word_spans
from .work import id_or_text, trim, written

# fixed values: perfect difference sets; every remainder is a difference of two members
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and anchor length for windows of so many words: period - 1 + anchor = window."""
    period = max((p for p in COVERS if p <= max(3, window * 2 // 3)), default=3)
    if window < period + 1:
        raise ValueError("windows of at least 4 words")
    return period, COVERS[period], window - period + 1


class _Words:
    """Hashed words of a slice of (id, text): rows' offsets, ids, and each word's place in its row."""

    def __init__(self, batch: pa.RecordBatch):
        self.ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.raw, offsets = buffers(batch.column(1))
        self.first, self.end, self.at = word_spans(self.raw, offsets)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return word_hashes(self.raw, self.first, self.end, seed)

    def place(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and place of words given by their index in the slice."""
        row = np.searchsorted(self.at, words, side="right") - 1
        return row, words - self.at[row]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted row differs from the row before (the first does)."""
    out = np.ones(len(columns[0]), bool)
    if len(out) > 1:
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _anchors(window: int, repeats: bool):
    """Anchors of a slice: with repeats False each hash once, else those of which the slice holds several."""
    period, cover, length = cover_for(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                w = _Words(part)
                starts = window_starts(w.at, length)
                row, place = w.place(starts)
                long_ = np.diff(w.at)[row] >= window
                at = np.flatnonzero(np.isin(place % period, cover) & long_)
                h, row, place = _signed(window_hashes(w.hashes(), starts[at], length)), row[at], place[at]
                order = np.lexsort((place, w.ids[row], h))
                h, doc, place = h[order], w.ids[row[order]], place[order]
                new = _changes(h, doc, place)  # a repeated row isn't an occurrence of its own
                h, doc, place = h[new], doc[new], place[new]
                first = _changes(h)
                several = np.diff(np.append(np.flatnonzero(first), len(h)))[np.cumsum(first) - 1] > 1 if len(h) else first
                take = (several & ~first) if repeats else first
                columns = [pa.array(h[take]), pa.array(doc[take]), pa.array(place[take].astype(np.int32)), pa.array(several[take])]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "doc", "place", "several"])
        trim()

    return run


def _repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h: (doc, place) of those whose h occurs again or has ``several``."""
    held = None  # rows of the hash that the last batch ended with
    for batch in _and_end(batches):
        if batch is not None:
            rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            held = rows if held is None else [np.concatenate(p) for p in zip(held, rows, strict=True)]
            h = held[0]
            if not len(h):
                continue
            cut = int(np.searchsorted(h, h[-1]))
            if len(h) - cut > 200_000:
                # a hash in very many slices: it is repeated for certain, its rows needn't wait
                held[3][cut:] = True
                cut = len(h) - 1
        else:
            if held is None:
                return
            h, cut = held[0], len(held[0])
        now, held = [c[:cut] for c in held], [c[cut:] for c in held]
        if not len(now[0]):
            continue
        first = _changes(now[0])
        group = np.cumsum(first) - 1
        size = np.bincount(group)
        take = (size[group] > 1) | (np.bincount(group, weights=now[3])[group] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(now[1][take]), pa.array(now[2][take])], names=["doc", "place"])


def _and_end(batches):
    yield from batches
    yield None


def _windows(window: int, later: bool):
    """Full windows around repeated anchors: with later False the first of each in its slice, else the others."""
    period = cover_for(window)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                w = _Words(part)
                places = part.column(2)
                row = np.repeat(np.arange(len(part)), np.diff(places.offsets.to_numpy()))
                place = places.flatten().to_numpy()
                marks = np.zeros(len(w.first) + 1, np.int64)
                inside = place < np.diff(w.at)[row]
                marks[w.at[row[inside]] + place[inside]] = 1
                sums = np.concatenate([[0], np.cumsum(marks)])
                starts = window_starts(w.at, window)
                starts = starts[sums[starts + period] > sums[starts]]
                h1 = _signed(window_hashes(w.hashes(), starts, window))
                h2 = _signed(window_hashes(w.hashes(1), starts, window, 1))
                row, place = w.place(starts)
                doc = w.ids[row]
                order = np.lexsort((place, doc, h2, h1))
                h1, h2, doc, place = h1[order], h2[order], doc[order], place[order]
                new = _changes(h1, h2, doc, place)
                h1, h2, doc, place = h1[new], h2[new], doc[new], place[new]
                first = _changes(h1, h2)
                take = ~first if later else first
                columns = [pa.array(c[take]) for c in (h1, h2, doc)] + [pa.array(place[take].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "doc", "place"])
        trim()

    return run


def _not_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h1, h2, doc, place): (doc, place) of all but the first of each hash."""
    before = None
    for batch in batches:
        h1, h2, doc, place = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        if not len(h1):
            continue
        first = _changes(h1, h2)
        same = ~_changes(h1, h2, doc, place)
        if before is not None:
            first[0] = before[:2] != (h1[0], h2[0])
            same[0] = before == (h1[0], h2[0], doc[0], place[0])
        before = (h1[-1], h2[-1], doc[-1], place[-1])
        take = ~first & ~same
        yield pa.RecordBatch.from_arrays([pa.array(doc[take]), pa.array(place[take])], names=["doc", "place"])


def _cut(window: int):
    """Texts without the words of the windows that start at the given places (null: none; whole: all words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                ids, texts, places, whole = part.columns
                out: list[tuple[int, int, str]] = []
                for text, given, all_ in zip(texts, places, whole.to_pylist(), strict=True):
                    words = text.as_py().encode().split()  # at bytes 0x20 and 0x09 to 0x0D
                    n = len(words)
                    if all_ and n >= window:
                        out.append((n, n, ""))
                    elif not given.is_valid:
                        out.append((n, 0, b" ".join(words).decode()))
                    else:
                        starts = given.values.to_numpy(zero_copy_only=False)
                        starts = starts[starts + window <= n]
                        edge = np.zeros(n + 1, np.int64)
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, starts + window, -1)
                        covered = np.cumsum(edge)[:n] > 0
                        kept = [words[k] for k in np.flatnonzero(~covered).tolist()]
                        out.append((n, n - len(kept), b" ".join(kept).decode()))
                columns = list(zip(*out, strict=True)) if out else [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
                    names=["doc", "n_words", "n_removed", "kept_text"],
                )
        trim()

    return run


def _packed(places: DataFrame, name: str) -> DataFrame:
    """One row per document: doc, places."""
    return written(places.groupBy("doc").agg(F.collect_list("place").alias("places")), name)


def _meet(rows: DataFrame, side: DataFrame, most_broadcast: int) -> tuple[DataFrame, DataFrame | None]:
    """rows joined with their row of ``side``, and the other rows.

    Up to ``most_broadcast`` ids are broadcast to tell the two apart, so that
    only texts with something to do are dealt by id; beyond it all texts are,
    and the second result is None.
    """
    if side.count() > most_broadcast:
        return rows.join(side, "doc", "left"), None
    ids = F.broadcast(side.select("doc"))
    return rows.join(ids, "doc", "left_semi").join(side, "doc", "left"), rows.join(ids, "doc", "left_anti")


def substring_dedup(
    docs: DataFrame,
    window: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_broadcast: int = 1_000_000,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_text.

    A word goes if it is in a window of ``window`` words (runs of other bytes
    than 0x20 and 0x09-0x0D) whose word sequence also starts earlier: in a
    document of smaller id, or earlier in the same.  Windows are judged on the
    input.  Kept words are joined by one space.  Null and empty texts have no
    word; a null id counts as smaller than all, and rows without id are documents
    of their own by their texts.  Rows that repeat id and text
    are one document and get the same result; ids are expected to be unique
    otherwise.  Other columns are ignored.

    Of equal texts only that of the smallest id is searched: in the others every
    window has started before.  An anchor or window leaves a slice of texts at
    most once, so that a passage of a third of the documents sends a row per
    slice and no more.
    """
    doc, back = id_or_text(docs, id_col, text_col)
    rows = docs.select(doc.alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = rows.withColumn("key", F.sha2("text", 256))
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("least")).where("n > 1")
    groups = written(groups.select(F.concat("key", F.lit("")).alias("group"), "least"), "window-copies")
    few = groups.count() <= most_broadcast
    marked = keyed.join(F.broadcast(groups) if few else groups, F.col("key") == F.col("group"), "left")
    marked = marked.select("doc", "text", F.coalesce(F.col("doc") > F.col("least"), F.lit(False)).alias("copy"))
    single = marked.where("NOT copy").select("doc", "text")

    form = "h long, doc long, place int, several boolean"
    alone = single.mapInArrow(_anchors(window, False), form)
    more = single.mapInArrow(_anchors(window, True), form)
    dealt = alone.repartition(F.col("h")).sortWithinPartitions("h")
    anchors = dealt.mapInArrow(_repeated_anchors, "doc long, place int").unionByName(more.select("doc", "place"))
    anchors = _packed(anchors, "window-anchors")

    busy = _meet(single, anchors, most_broadcast)[0].where("places IS NOT NULL").select("doc", "text", "places")
    form = "h1 long, h2 long, doc long, place int"
    firsts = busy.mapInArrow(_windows(window, False), form)
    laters = busy.mapInArrow(_windows(window, True), form)
    dealt = firsts.repartition(F.col("h1")).sortWithinPartitions("h1", "h2", "doc", "place")
    starts = dealt.mapInArrow(_not_first, "doc long, place int").unionByName(laters.select("doc", "place"))
    starts = _packed(starts, "window-starts")

    left = marked.where("NOT copy")
    met, rest = _meet(left, starts, most_broadcast)
    none = F.lit(None).cast("array<int>").alias("places")
    todo = met.select("doc", "text", "places", F.lit(False).alias("whole"))
    if rest is not None:
        todo = todo.unionByName(rest.select("doc", "text", none, F.lit(False).alias("whole")))
    todo = todo.unionByName(marked.where("copy").select("doc", "text", none, F.lit(True).alias("whole")))
    out = todo.mapInArrow(_cut(window), "doc long, n_words long, n_removed long, kept_text string")
    return out.select(back(F.col("doc")).alias(id_col), "n_words", "n_removed", "kept_text")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM l),
win AS (SELECT doc_id, p, word,
   string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS s,
   count(*) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS n FROM w),
r AS (SELECT doc_id, p, word, n = 20 AND row_number() OVER (PARTITION BY s, n = 20 ORDER BY doc_id, p) > 1 AS later FROM win),
c AS (SELECT doc_id, p, word, max(later::INT) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM r),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
"""
