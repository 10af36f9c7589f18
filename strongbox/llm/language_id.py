"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a binary n-gram classifier (naive
Bayes log odds of hashed byte n-grams, scaled by a logistic fit) predicts
whether the language's codeword has it.  Loss-weighted decoding adds up, for
each language, the logistic loss of its codeword under the predicted margins,
each bit weighted by what its classifier knew in training, and takes the least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .wordhash import buffers, slices

_DIMS_LOG2 = 14
_DIMS = 1 << _DIMS_LOG2
# bytes of lower-cased text: ASCII that is no letter counts as a space
_FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def codewords(k: int, seed: int = 11) -> np.ndarray:
    """k codewords of -1 and 1: all ways to split up to 5 languages, else random splits.

    Random columns are drawn until every pair of codewords differs in at least a
    quarter of the bits and no column is constant or repeated (as is or negated).
    """
    if k <= 5:
        columns = [[1 if (c >> i) & 1 else -1 for i in range(k)] for c in range(1, 1 << max(k - 1, 0))]
        return np.array(columns, np.int8).T.reshape(k, -1) if columns else np.ones((k, 1), np.int8)
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    best, best_apart = None, -1
    for _ in range(200):
        code = np.where(rng.random((k, bits)) < 0.5, -1, 1).astype(np.int8)
        code = code[:, np.abs(code.sum(axis=0)) < k]
        apart = min((int((code[i] != code[j]).sum()) for i in range(k) for j in range(i)), default=0)
        if apart > best_apart:
            best, best_apart = code, apart
        if apart * 4 >= bits:
            break
    return best


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 4-byte and 3-byte grams of each row, and the n + 1 offsets of the rows' grams.

    A row gets a space in front and three behind; grams of spaces only stay out
    of the sums by weight, as their weight is set to nothing.
    """
    raw, offsets = buffers(pc.utf8_lower(texts))
    n = len(offsets) - 1
    folded = np.full(len(raw) + 4 * n, 32, np.uint8)
    row = np.repeat(np.arange(n), np.diff(offsets))
    folded[np.arange(len(raw)) + 4 * row + 1] = _FOLD[raw]
    wide = folded.astype(np.uint32)
    wide = np.concatenate([wide, np.full(3, 32, np.uint32)])
    four = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    return four, offsets + 4 * np.arange(n + 1)


def _hashed(four: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint32(32 - _DIMS_LOG2 + 1)
    with np.errstate(over="ignore"):
        a = (four * np.uint32(2654435761)) >> shift
        b = ((four & np.uint32(0xFFFFFF)) * np.uint32(2246822519) >> shift) + np.uint32(_DIMS // 2)
    return a.astype(np.int32), b.astype(np.int32)


class Model:
    """langs; code [k, bits]; weight [bits, dims]; scale, shift and trust [bits]."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        self.code = codewords(len(self.langs))
        index = {x: i for i, x in enumerate(self.langs)}
        y = np.array([index[x] for x in langs], np.int64)
        counts = np.zeros((len(self.langs), _DIMS))
        held = []
        for at in range(0, len(texts), 64):
            four, offsets = _grams(pa.array(texts[at : at + 64], pa.string()))
            a, b = _hashed(four)
            held.append((a, b, offsets))
            for k in range(len(offsets) - 1):
                s = slice(offsets[k], offsets[k + 1])
                counts[y[at + k]] += np.bincount(a[s], minlength=_DIMS) + np.bincount(b[s], minlength=_DIMS)
        # each language counts alike, whatever its share of the sample
        rate = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * _DIMS)
        bits = self.code.shape[1]
        self.weight = np.zeros((bits, _DIMS), np.float32)
        for b in range(bits):
            yes, no = self.code[:, b] > 0, self.code[:, b] < 0
            if yes.any() and no.any():
                self.weight[b] = np.log(rate[yes].mean(axis=0)) - np.log(rate[no].mean(axis=0))
        blank = _hashed(np.array([0x20202020], np.uint32))
        self.weight[:, [int(blank[0][0]), int(blank[1][0])]] = 0
        means = np.concatenate([self._sums(a, b, o)[0] for a, b, o in held]) if held else np.zeros((0, bits))
        target = self.code[y]
        self.scale, self.shift, self.trust = np.ones(bits), np.zeros(bits), np.ones(bits)
        for b in range(bits):
            self.scale[b], self.shift[b] = _logistic(means[:, b], target[:, b])
            right = np.mean((means[:, b] * self.scale[b] + self.shift[b] > 0) == (target[:, b] > 0)) if len(y) else 1
            self.trust[b] = max(2 * right - 1, 0.01)

    def _sums(self, a: np.ndarray, b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean weight of each row's grams by bit (a row has grams always)."""
        n = np.diff(offsets)
        out = np.empty((len(n), len(self.weight)))
        for bit, w in enumerate(self.weight):
            out[:, bit] = np.add.reduceat(w[a], offsets[:-1]) + np.add.reduceat(w[b], offsets[:-1])
        return out / n[:, None], n

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword's language, its score, and its loss lead over the second."""
        four, offsets = _grams(texts)
        means, _ = self._sums(*_hashed(four), offsets)
        margin = means * self.scale + self.shift
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ (self.trust / self.trust.sum())
        order = np.argsort(loss, axis=1, kind="stable")
        first = order[:, 0]
        least = loss[np.arange(len(loss)), first]
        lead = loss[np.arange(len(loss)), order[:, 1]] - least if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        power = np.exp(-len(self.trust) * (loss - least[:, None]))
        return first, 1 / power.sum(axis=1), lead


def _logistic(x: np.ndarray, sign: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Scale and shift of a one-feature logistic fit (Newton with a small ridge; scale stays positive)."""
    if not len(x) or np.ptp(x) == 0:
        return 1.0, 0.0
    spread = x.std() or 1.0
    design = np.stack([x / spread, np.ones(len(x))], axis=1)
    y, w = (sign > 0).astype(float), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hess = design.T @ (design * (p * (1 - p))[:, None]) + 1e-1 * np.eye(2)
        step = np.linalg.solve(hess, design.T @ (p - y) + 1e-1 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return max(w[0], 1e-3) / spread, w[1]


def fit(docs: DataFrame, sample_docs: int = 3000, sample_chars: int = 20_000, text_col="text", lang_col="lang", id_col="doc_id") -> Model:
    """Learn from at most ``sample_docs`` labelled rows of at most ``sample_chars`` characters.

    The rows with the smallest hash of id and text are taken, whole, of each
    language an equal share of ``sample_docs`` at least where it has as many, so
    that rare languages are learned too; shares that a language doesn't fill go to
    the others.  These two numbers bound what reaches the driver; of more than
    ``sample_docs`` languages those with the most rows are learned.
    """
    rows = docs.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.xxhash64(id_col, text_col).alias("h"))
    rows = rows.where(F.col("l").isNotNull() & F.col("t").isNotNull() & (F.length("t") <= sample_chars) & (F.col("t") != ""))
    counts = [(r.n, r.l) for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(sample_docs).collect()]
    left, want = sample_docs, {}
    for k, (n, lang) in enumerate(sorted(counts)):  # the rarest first: what it leaves is shared by the rest
        want[lang] = min(n, left // (len(counts) - k))
        left -= want[lang]
    if not want:
        return Model([], [])
    # by hash: first a range that holds about three times a language's share, then exactly that many
    sizes = {lang: n for n, lang in counts}
    near = [(lang, int(min(-(2**63) + 2**64 * (3 * m / sizes[lang]), 2**63 - 1)), m) for lang, m in want.items()]
    shares = F.broadcast(docs.sparkSession.createDataFrame(near, "_l string, _below long, _m long"))  # at most sample_docs rows
    rows = rows.join(shares, F.col("l") == F.col("_l")).where("h <= _below")
    place = F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))
    rows = rows.withColumn("_place", place).where("_place <= _m").orderBy("h", "t").select("t", "l").collect()
    return Model([r.t for r in rows], [r.l for r in rows])


def identify(docs: DataFrame, model: Model, ambiguous_below: float = 0.05, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row, from its whole text.

    ``und`` with score 0 where the text is null or has no letter, and where
    nothing was learned.  ``ambiguous`` marks rows whose nearest two codewords
    differ in loss by less than ``ambiguous_below``; of languages at the same loss
    the first by name is predicted.  Rows that repeat an id or have none are
    predicted one by one; other columns are ignored; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: bits x 2^14 weights

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1)
                lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                if known.langs:
                    first, score, lead = known.predict(texts)
                    names = np.where(lettered, np.array(known.langs, object)[first], "und")
                    score, ambiguous = np.where(lettered, score, 0.0), lettered & (lead < ambiguous_below)
                else:
                    names, score, ambiguous = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts), bool)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(ambiguous)],
                    names=["id", "lang_pred", "score", "ambiguous"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    found = rows.mapInArrow(predict, "id long, lang_pred string, score double, ambiguous boolean")
    return found.withColumnRenamed("id", id_col)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit(docs.where(~held_out))
    found = identify(docs, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
