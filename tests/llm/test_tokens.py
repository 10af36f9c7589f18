"""Token files and sampled segmentations, by round trip, brute force and frequencies."""

import math
import os
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from strongbox.llm import subword_sampling as sw
from strongbox.llm import token_files as tf
from strongbox.llm import wordhash as wh

from .helpers import frame, odd_texts, prose

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "  a  b\n\n c", "don't we'll 12³ \x1c x", "日本 text", "a<|endoftext|>b", "\xa0x ª²", "x" * 5000, " " * 500 + "a", "\t\n\x0b y\r\n", "\x00", "'s 's", "▁ a▁b"]


@pytest.mark.parametrize("most", [3, 10**6])
def test_encoder_is_the_library(most):
    rng = random.Random(1)
    texts = ODD + [prose(rng, 50) for _ in range(20)] + ["".join(rng.choice("ab é'1!\n\t日") for _ in range(60)) for _ in range(200)]
    encoder = tf.Encoder(BPE, most)
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert ids.tolist() == encoder.library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("top", [1, 300, 70_000, 20_000_000])
def test_block_format(top):
    rng = np.random.default_rng(top)
    counts = rng.integers(0, 50, 40)
    ids = (rng.integers(0, top, counts.sum()) if top < 10**6 else np.arange(counts.sum()) * 17).astype(np.uint32)
    docs = rng.integers(-5, 10**12, 40)
    blob = tf.encode_block(docs, counts, ids)
    found = tf.decode_block(blob)
    assert all((a == b).all() for a, b in zip(found, (docs, counts, ids), strict=True))
    if top == 300:  # the commonest 256 ids take a byte, and a fourth of a control byte
        assert len(blob) < 1.5 * len(ids) + 4 * 300 + 12 * 40 + 40
    empty = tf.decode_block(tf.encode_block(np.zeros(2, np.int64), np.zeros(2, np.int64), np.zeros(0, np.uint32)))
    assert empty[1].tolist() == [0, 0] and not len(empty[2])
    with pytest.raises(ValueError):
        tf.decode_block(b"XXXX" + blob[4:])


def test_wide_ranks():
    ids = np.arange(70_000, dtype=np.uint32)[::-1].copy()
    assert (tf.decode_block(tf.encode_block(np.array([1]), np.array([len(ids)]), ids))[2] == ids).all()


def test_token_files(spark, tmp_path):
    texts = [(i * 7 % 101, t) for i, t in enumerate(t for _, t in odd_texts())] + [(200 + k, t) for k, t in enumerate(ODD)] + [(None, "null id"), (5000, "twice"), (5000, "twice")]
    docs = frame(spark, texts, extra=True)
    folder = f"file://{tmp_path}/tokens"
    rows = tf.token_files(docs.repartition(5), BPE, folder=folder).collect()
    library, start, want = tf.Encoder(BPE).library, 0, []
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    names = sorted(n for n in os.listdir(tmp_path / "tokens") if n.endswith(".tok"))
    held = [tf.decode_block((tmp_path / "tokens" / n).read_bytes())[0].tolist() for n in names]
    assert sum(held, []) == sorted((-(2**63) if i is None else i for i, _ in texts)) and not [n for n in os.listdir(tmp_path / "tokens") if ".tok." in n]


def test_small_files_and_no_rows(spark, tmp_path):
    docs = frame(spark, [(k, "some words here") for k in range(50)])
    tf.write_token_files(docs, BPE, f"file://{tmp_path}", ids_in_file=10).collect()
    assert len(list(tmp_path.glob("*.tok"))) >= 15
    assert tf.token_files(frame(spark, []), BPE, folder=f"file://{tmp_path}/none").count() == 0


def brute_paths(pieces, text):
    shown = "▁" + text.replace(" ", "▁") if text else ""
    ids = {n: i for i, n in enumerate(pieces.names) if i > 2 and not pieces.model.is_byte(i)}
    out = []

    def go(at, path, w):
        if at == len(shown):
            out.append((tuple(path), w))
            return
        if shown[at] not in ids:
            raw = [int(pieces.byte_id[b]) for b in shown[at].encode()]
            go(at + 1, path + raw, w + len(raw) * pieces.log_weight[pieces.byte_id[0]])
        for n in range(1, min(16, len(shown) - at) + 1):
            if shown[at : at + n] in ids:
                i = ids[shown[at : at + n]]
                go(at + n, [*path, i], w + pieces.log_weight[i])

    go(0, [], 0.0)
    z = np.logaddexp.reduce([w for _, w in out])
    return {p: w - z for p, w in out}


@pytest.mark.parametrize("text", ["ab c\n", "thing", "x y", "\x01日é", "a", ""])
def test_samples_without_replacement(text):
    pieces = sw.pieces_of(PIECES, 0.3)
    exact = brute_paths(pieces, text)
    n, k = 3000, 3
    found = sw.sample_batch(pieces, [text] * n, [int(wh.mix(np.array([i], np.uint64))[0]) for i in range(n)], k)
    first, within = Counter(), Counter()
    for rows in found:
        paths = [tuple(r[0].tolist()) for r in rows]
        assert len(set(paths)) == len(paths) == min(k, len(exact)) and all(p in exact for p in paths)
        assert all(a[2] >= b[2] for a, b in zip(rows, rows[1:], strict=False))
        assert all(abs(r[1] - exact[p]) < 1e-4 for r, p in zip(rows, paths, strict=True))
        first[paths[0]] += 1
        within.update(paths)
        assert all(0 < r[3] <= 1 for r in rows) and (len(exact) > k or all(r[3] == 1 for r in rows))
    p = {path: math.exp(v) for path, v in exact.items()}
    for path in sorted(p, key=p.get)[-4:]:
        assert abs(first[path] / n - p[path]) < 5 * math.sqrt(p[path] * (1 - p[path]) / n) + 2e-3
    if k < len(p) < 40:
        chance = Counter()
        for a, b, c in permutations(p, 3):
            q = p[a] * p[b] / (1 - p[a]) * p[c] / (1 - p[a] - p[b])
            chance.update({a: q, b: q, c: q})
        for path in sorted(p, key=p.get)[-5:]:
            assert abs(within[path] / n - chance[path]) < 0.04


def test_inclusion_is_unbiased():
    """Each sample counts for one over its inclusion: the counts' mean is one for every path."""
    pieces = sw.pieces_of(PIECES, 0.3)
    n, total = 4000, Counter()
    for rows in sw.sample_batch(pieces, ["thing"] * n, [i * 7919 + 1 for i in range(n)], 3):
        total.update({tuple(r[0].tolist()): 1 / r[3] for r in rows})
    exact = brute_paths(pieces, "thing")
    for path in sorted(exact, key=exact.get)[-3:]:
        assert abs(total[path] / n - 1) < 0.06


def test_sampling_query_form(spark):
    texts = odd_texts() + [(300 + k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (900, "same same"), (900, "same same")]
    docs = frame(spark, texts, extra=True)
    rows = sw.sample_segmentations(docs, PIECES, k=3).collect()
    again = sw.sample_segmentations(docs.repartition(7), PIECES, k=3).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))  # by seed and id alone
    pieces, by_id = sw.pieces_of(PIECES, 0.3), dict(texts)
    for r in rows:
        ids, text = np.frombuffer(r.ids, "<u2").astype(np.int64), by_id[r.doc_id] or ""
        assert len(ids) == r.n_pieces and r.round_trip == ("▁" not in text)
        assert pieces.decode(ids) == text.replace("▁", " ").encode()
        assert pieces.model.decode(ids.tolist()) == text.replace("▁", " ") or "\x00" in text
    per = Counter(r.doc_id for r in rows)
    assert per[12] == 1 and per[0] == 3 and per[900] == 6  # 12: an empty text
    assert sw.sample_segmentations(frame(spark, []), PIECES).count() == 0


def test_word_spans_and_hashes():
    texts = ["a b", None, "", " \tlead", "trail\n", "é x \x0b\x0cz", "abcab"]
    raw, offsets = wh.buffers(pa.array(texts))
    first, end, at = wh.word_spans(raw, offsets)
    words = [raw[a:b].tobytes() for a, b in zip(first, end, strict=True)]
    assert words == [w for t in texts for w in (t or "").encode().split()] and np.diff(at).tolist() == [len((t or "").encode().split()) for t in texts]
    raw, offsets = wh.buffers(pa.array(["a b", "ab", "ba a b", "b"]).slice(1))
    first, end, at = wh.word_spans(raw, offsets)
    h = wh.word_hashes(raw, first, end)
    assert len({*h.tolist()}) == 4 - 0 and h[3] == h[4]  # ab, ba, a, b, b
    w = wh.window_hashes(np.array([5, 6, 5, 6, 5], np.uint64), np.arange(4), 2)
    assert w[0] == w[2] and w[1] == w[3] and w[0] != w[1]


def test_a_missing_piece_is_looked_for_once():
    """op10: most keys have no piece; a free slot ends their search, and pieces are found as before."""
    import numpy as np
    import public_tokenizers

    from strongbox.llm import subword_sampling as s

    class Counted:
        def __init__(self, held):
            self.held, self.n = held, 0

        def __getitem__(self, at):
            self.n += len(at)
            return self.held[at]

    pieces = s.Pieces(public_tokenizers.path("piece_bpe_32k.model"), 0.3)
    there = np.flatnonzero(pieces.ids >= 0)
    assert (pieces.find(pieces.keys[there]) == pieces.ids[there]).all()
    absent = np.setdiff1d(np.random.default_rng(1).integers(0, 2**63, 50_000).astype(np.uint64), pieces.keys[there])
    real, pieces.ids = pieces.ids, Counted(pieces.ids)
    assert (pieces.find(absent) == -1).all() and pieces.ids.n < 1.5 * len(absent)
    mixed = np.concatenate([absent[:100], pieces.keys[there][:100]])
    assert pieces.find(mixed).tolist() == [-1] * 100 + real[there][:100].tolist()


def test_one_truncated_value_is_as_many_are():
    """op10"""
    import numpy as np

    from strongbox.llm import subword_sampling as s

    for mass, bound, u in ((-3.0, 2.0, 0.3), (0.5, -40.0, 1e-12), (-700.0, 5.0, 1 - 1e-12), (-1.0, 60.0, 0.5)):
        assert abs(s._truncated_one(mass, bound, u) - s._truncated(np.array([mass]), bound, np.array([u]))[0]) < 1e-9
