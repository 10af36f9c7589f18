"""Toxicity by a lexicon trie intersected with Levenshtein automata, scored in context.

Learned from labelled rows: a lexicon of words and word beginnings that are far
more frequent in toxic texts; a weight for each, apart for exact and misspelled
occurrences; and a logistic model over the context scores of a text's hits,
which keeps hits inside quotations apart from the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from .wordhash import slices
from .work import bounded_sample, trim

# a token is a run of letters, digits, _ @ $ *, or one quotation mark or line end
_QUOTES = "\"“”„«»"
_ALONE = f"([{_QUOTES}\\n])"
_BETWEEN = f"[^\\p{{L}}\\p{{N}}_@$*{_QUOTES}\\n]+"
_EDGE = "_@$*0123456789"
# fixed values: digits and signs that stand in for letters
_LEET = str.maketrans("013457@$", "oieastas")
_WINDOW = 8
_AT_ONCE = 300  # texts of the fit in arrays at a time, on the driver


def tokenised(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct lower-cased tokens of some texts, the texts' tokens by number, and where each text's begin."""
    apart = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), _ALONE, r" \1 ")
    parts = pc.split_pattern_regex(apart, _BETWEEN)
    flat = pc.dictionary_encode(parts.flatten())
    names, ids = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    real = np.array([n != "" for n in names], bool)[ids] if len(ids) else np.zeros(0, bool)
    return names, ids[real], np.concatenate([[0], np.cumsum(real)])[offsets]


def fold(token: str) -> str:
    """The word that a token shows: signs at its ends go, signs and digits inside become letters."""
    if token.isalpha():
        return token
    core = token.strip("_@$*")
    if any(c.isalpha() for c in core):
        return core.translate(_LEET)
    return ""


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class FuzzyTrie:
    """A trie of terms walked by Levenshtein automata of all of them at once.

    A state is the set of trie nodes that can be reached with how many edits; the
    product automaton is made deterministic lazily, so that a word costs one
    look-up a character once its states are known, and a word that can't match
    any more stops early.  ``most`` states are held at once; then they are made anew.
    """

    def __init__(self, words: list[str], stems: list[str], most: int = 100_000):
        self.child: list[dict[str, int]] = [{}]
        self.word: dict[int, str] = {}
        self.stem: dict[int, str] = {}
        self.edits = [0]
        self.most = most
        for terms, held, fuzzy in ((words, self.word, True), (stems, self.stem, False)):
            for term in terms:
                path = [0]
                for c in term:
                    if c not in self.child[path[-1]]:
                        self.child[path[-1]][c] = len(self.child)
                        self.child.append({})
                        self.edits.append(0)
                    path.append(self.child[path[-1]][c])
                held[path[-1]] = term
                if fuzzy:
                    for node in path:
                        self.edits[node] = max(self.edits[node], allowed_edits(term))
        self.start = self._closed({0: 0})
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.next: list[dict[str, int]] = []
        self.state: list[tuple] = []
        self._id(self.start)

    def _closed(self, state: dict[int, int]) -> tuple:
        """With lexicon characters that the word leaves out."""
        todo = list(state)
        while todo:
            node = todo.pop()
            e = state[node] + 1
            for to in self.child[node].values():
                if e <= self.edits[to] and e < state.get(to, 9):
                    state[to] = e
                    todo.append(to)
        return tuple(sorted(state.items()))

    def _id(self, state: tuple) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.state)
            self.state.append(state)
            self.next.append({})
        return self.ids[state]

    def _step(self, at: int, c: str) -> int:
        to: dict[int, int] = {}
        for node, e in self.state[at]:
            if (n := self.child[node].get(c)) is not None and e < to.get(n, 9) and (e == 0 or e <= self.edits[n]):
                to[n] = e
            if e + 1 <= self.edits[node] and e + 1 < to.get(node, 9):
                to[node] = e + 1  # the word has a character more
            for n in self.child[node].values():
                if e + 1 <= self.edits[n] and e + 1 < to.get(n, 9):
                    to[n] = e + 1  # another character
        found = self._id(self._closed(to)) if to else -1
        self.next[at][c] = found
        return found

    def find(self, word: str) -> tuple[str, int] | None:
        """The best term for a word and its edits; -1 edits: the word begins with the stem.

        An exact word is better than a stem, a longer stem than a shorter one, a
        stem than a misspelling, and of misspellings the one of fewest edits, then
        the first by alphabet.
        """
        if len(self.state) > self.most:
            self._forget()
        at, stem = 0, None
        for c in word:
            to = self.next[at].get(c)
            at = self._step(at, c) if to is None else to
            if at < 0:
                return (stem, -1) if stem else None
            if self.stem:
                for node, e in self.state[at]:
                    if e == 0 and node in self.stem:
                        stem = self.stem[node]
        ends = [(e, t) for node, e in self.state[at] if (t := self.word.get(node)) and e <= allowed_edits(t)]
        if ends and min(ends)[0] == 0:
            return min(ends)[1], 0
        if stem:
            return stem, -1
        return (min(ends)[1], min(ends)[0]) if ends else None


class Occurrences:
    """Which word and which word beginning occurs in which text, as arrays of numbers."""

    def __init__(self, texts: list[set[str]]):
        ids: dict[str, int] = {}
        sizes = [len(t) for t in texts]
        self.word = np.fromiter((ids.setdefault(w, len(ids)) for t in texts for w in sorted(t)), np.int64, sum(sizes))
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        self.words, self.n = list(ids), len(texts)

    def unique(self, value_of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, value) pairs, for a value of each word (-1: none)."""
        value = value_of_word[self.word]
        has = value >= 0
        wide = int(value_of_word.max(initial=-1)) + 1
        key = np.unique(self.doc[has] * max(wide, 1) + value[has])
        return key // max(wide, 1), key % max(wide, 1)

    def features(self):
        """(kind, names, texts, numbers of names) of words and of beginnings of 4 to 9 letters."""
        yield "word", self.words, self.doc, self.word
        for n in range(4, 10):
            ids: dict[str, int] = {}
            value = np.fromiter((ids.setdefault(w[:n], len(ids)) if len(w) > n else -1 for w in self.words), np.int64, len(self.words))
            yield "stem", list(ids), *self.unique(value)


class Lexicon:
    """Weights of (kind, term); kind: word, stem, near."""

    def __init__(self, seen: Occurrences, toxic: np.ndarray, use: np.ndarray, most_terms: int = 3000, least_docs: int = 3):
        """Learned from the texts with ``use``, of which those with ``toxic`` are toxic."""
        pos_docs, neg_docs = use & toxic, use & ~toxic
        ratio = (pos_docs.sum() + 1) / (neg_docs.sum() + 1)

        def weight(p, n):
            return np.log((p + 0.25) / (n * ratio + 0.75))

        least, scored = max(least_docs, 0.002 * pos_docs.sum()), []
        for kind, names, doc, feature in seen.features():
            p = np.bincount(feature[pos_docs[doc]], minlength=len(names))
            n = np.bincount(feature[neg_docs[doc]], minlength=len(names))
            w = weight(p, n)
            for k in np.flatnonzero((p >= least) & (w > 1.6)).tolist():
                scored.append((-w[k] * math.sqrt(p[k]), kind, names[k], float(w[k])))
        self.weight = {(kind, term): w for _, kind, term, w in sorted(scored)[:most_terms]}
        self.trie = FuzzyTrie([t for k, t in self.weight if k == "word"], [t for k, t in self.weight if k == "stem"])
        terms = {t: k for k, t in enumerate(sorted({t for k, t in self.weight if k == "word"}))}
        near = np.fromiter((terms[hit[0]] if (hit := self.trie.find(w)) and hit[1] > 0 else -1 for w in seen.words), np.int64, len(seen.words))
        doc, term = seen.unique(near)
        p = np.bincount(term[pos_docs[doc]], minlength=len(terms))
        n = np.bincount(term[neg_docs[doc]], minlength=len(terms))
        for t, k in terms.items():
            if allowed_edits(t):
                # few sightings leave a misspelling the word's weight; clean sightings take it away
                w = self.weight["word", t]
                self.weight["near", t] = w if p[k] + n[k] == 0 else max(0.0, min(w, float(weight(p[k], n[k]))))

    def look(self, token: str) -> tuple[float, str] | None:
        word = fold(token)
        hit = self.trie.find(word) if len(word) >= 3 else None
        if not hit:
            return None
        w = self.weight["word" if hit[1] == 0 else "stem" if hit[1] < 0 else "near", hit[0]]
        return (w, hit[0]) if w > 0 else None


class Scorer:
    """A lexicon and a logistic model over a text's context scores."""

    def __init__(self, lexicon: Lexicon | None, coef: np.ndarray | None, most: int = 300_000):
        self.lexicon, self.coef, self.most = lexicon, coef, most

    def _tables(self) -> tuple[dict, set]:
        if not hasattr(self, "_hits"):
            self._hits: dict[str, tuple[float, str]] = {}
            self._clean: set[str] = set()
        if len(self._clean) + len(self._hits) > self.most:  # bounds memory; words are looked up anew
            self._hits, self._clean = {}, set()
        return self._hits, self._clean

    def forget(self) -> None:
        """Let go of what was looked up, at the end of a task: idle workers hold memory."""
        self._hits, self._clean = {}, set()
        trim()

    def __getstate__(self):
        return {"lexicon": self.lexicon, "coef": self.coef, "most": self.most}

    def features(self, texts: pa.Array) -> np.ndarray:
        """The context scores of each text.  Words are looked up once a batch, all else is arrays."""
        hits, clean = self._tables()
        names, ids, offsets = tokenised(texts)
        for w in names:
            if w not in clean and w not in hits:
                found = self.lexicon.look(w)
                if found:
                    hits[w] = found
                else:
                    clean.add(w)
        n = len(offsets) - 1
        out = np.zeros((n, 7))
        terms: dict[str, int] = {}
        term_of = np.array([terms.setdefault(hits[w][1], len(terms)) if w in hits else -1 for w in names], np.int64)
        at = np.flatnonzero(term_of[ids] >= 0) if len(ids) else np.zeros(0, np.int64)
        if not len(at):
            return out
        # weights are multiples of a power of two, so that no sum depends on what else is in the batch
        weight_of = np.array([round(hits[w][0] * 2**20) / 2**20 if w in hits else 0.0 for w in names])
        weights, row = weight_of[ids[at]], np.searchsorted(offsets, at, side="right") - 1
        # a quotation opens and closes on one line of one text; an unclosed one doesn't count
        mark = np.array([w in _QUOTES and w != "" for w in names], bool)[ids]
        ends = np.array([w == "\n" for w in names], bool)[ids]
        ends[offsets[1:-1][offsets[1:-1] < len(ids)]] = True
        line, marks = np.cumsum(ends), np.concatenate([[0], np.cumsum(mark)])
        first = np.searchsorted(line, line[at], side="left")
        last = np.searchsorted(line, line[at], side="right")
        inside = ((marks[at] - marks[first]) % 2 == 1) & (marks[last] > marks[at])
        free = np.where(inside, 0.25 * weights, weights)
        sums = np.concatenate([[0], np.cumsum(free)])
        places = at + row * (2 * _WINDOW)  # texts stand further apart than a window
        near = sums[np.searchsorted(places, places + _WINDOW, side="right")] - sums[np.searchsorted(places, places - _WINDOW)]
        has, begin = np.unique(row, return_index=True)
        size = np.diff(offsets)[has]
        by_size = np.lexsort((-free, row))
        rank = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
        distinct = np.unique(row * len(terms) + term_of[ids[at]]) // len(terms)
        out[has] = np.stack([
            np.log1p(np.add.reduceat(np.where(inside, 0, weights), begin)), np.log1p(np.add.reduceat(np.where(inside, weights, 0), begin)),
            np.log1p(np.maximum.reduceat(near, begin)), np.log1p(100 * np.add.reduceat(free, begin) / (size + 20)),
            np.log1p(np.bincount(distinct, minlength=n)[has]), np.maximum.reduceat(weights, begin),
            np.log1p(np.add.reduceat(np.where(rank < 3, free[by_size], 0), begin)),
        ], axis=1)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Between 0 and 1 for each text; null texts are empty."""
        if self.coef is None:
            return np.zeros(len(texts))
        x = self.features(texts) if self.lexicon else np.zeros((len(texts), 7))
        value = (x * self.coef[:-1]).sum(axis=1) + self.coef[-1]
        return 1 / (1 + np.exp(-np.clip(value, -30, 30)))

    def score(self, text: str | None) -> float:
        return float(self.scores(pa.array([text], pa.string()))[0])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    design, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-3
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hess = design.T @ (design * (weight * p * (1 - p))[:, None]) + penalty
        step = np.linalg.solve(hess, design.T @ (weight * (p - y)) + penalty @ w)
        w -= step * min(1, 2 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return w


def _family(words: list[str]) -> int:
    """The least hash of five words in a row: the same for most copies of a text."""
    return min(xxhash.xxh3_64_intdigest(" ".join(words[i : i + 5])) for i in range(max(len(words) - 4, 1)))


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = 3000, most_clean: int = 6000, most_chars: int = 20_000) -> Scorer:
    """Learn from a bounded sample of labelled rows.

    At most ``most_toxic`` and ``most_clean`` labels are taken, by the smallest
    hash of their doc_id, and of their texts those of at most ``most_chars``
    characters, whole; of rows that repeat a doc_id, one.  These numbers bound what
    reaches the driver.  Copies count once in the lexicon.  The logistic model is
    fitted on scores from lexicons that didn't see the text (three folds), with
    weights that give the classes their true shares.  Without a toxic and a
    clean row every score is 0.
    """
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    known = known.select(F.xxhash64("doc_id").alias("h"), "doc_id", "y")
    shares = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [bounded_sample(known.where(F.col("y") == y), "h", m) for y, m in ((1, most_toxic), (0, most_clean))]
    few = F.broadcast(parts[0].unionByName(parts[1]).select(F.col("doc_id").alias("k"), "h", "y"))  # bounded by the two parameters
    texts = docs.select("doc_id", F.col("text").alias("t")).where(F.length("t") <= most_chars)
    rows = texts.join(few, F.col("doc_id") == F.col("k")).groupBy("h", "y", "k").agg(F.min(F.struct(F.xxhash64("t").alias("th"), "t"))["t"].alias("t"))
    rows = rows.select("h", "y", "t").collect()
    rows = sorted((r.h, r.t, r.y) for r in rows)
    y, texts = np.array([r[2] for r in rows], np.int64), [r[1] for r in rows]
    del rows
    if not (y == 1).any() or not (y == 0).any():
        return Scorer(None, None)
    families, first, words, before = np.empty(len(y), np.int64), np.empty(len(y), bool), [], set()
    shared: dict[str, str] = {}
    for at in range(0, len(y), _AT_ONCE):
        names, ids, offsets = tokenised(pa.array(texts[at : at + _AT_ONCE], pa.large_string()))
        folded = [shared.setdefault(f, f) if len(f := fold(t)) >= 3 else "" for t in names]
        for k in range(len(offsets) - 1):
            own = ids[offsets[k] : offsets[k + 1]].tolist()
            words.append({folded[i] for i in own} - {""})
            family = (_family([names[i] for i in own if names[i] != "\n"]) if own else 0, int(y[at + k]))
            first[at + k], families[at + k] = family not in before, family[0] % 3
            before.add(family)
    seen = Occurrences(words)
    del words, before
    trim()
    x = np.zeros((len(y), 7))
    for part in range(3):
        scorer = Scorer(Lexicon(seen, y == 1, first & (families != part)), None)
        out = np.flatnonzero(families == part)
        for at in range(0, len(out), _AT_ONCE):
            some = out[at : at + _AT_ONCE]
            x[some] = scorer.features(pa.array([texts[k] for k in some.tolist()], pa.large_string()))
        del scorer
        trim()
    del texts
    weight = np.where(y == 1, shares[1] / (y == 1).sum(), shares[0] / (y == 0).sum())
    coef = _logistic(x, y, weight * len(y) / weight.sum())
    lexicon = Lexicon(seen, y == 1, first)
    lexicon.trie._forget()  # what it learned on the way; words are looked up anew
    del seen
    trim()
    return Scorer(lexicon, coef)


def score_texts(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for every row, from its whole text.

    Null, empty and blank texts have the score of a text without hits.  Rows that
    repeat an id, and rows without id, are scored one by one; equal texts have equal
    scores.  Other columns are ignored; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # at most 3000 terms and 8 numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(known.scores(part.column(1)))], names=["id", "score"])
        known.forget()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(score, "id long, score double").withColumnRenamed("id", id_col)


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scorer = fit(docs.select("doc_id", "text"), training_labels(labels))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return score_texts(docs, scorer).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, scorer: Scorer, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose whole text scores ``threshold`` or more; all columns stay, whatever their names.

    Null and empty texts score as score_texts() says; each of repeated rows is
    judged by itself, so all or none stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(shared.value.scores(part.column(at)) < threshold))
        shared.value.forget()

    return docs.mapInArrow(clean, docs.schema)
