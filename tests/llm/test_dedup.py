"""Exact, substring and near dedup against brute force."""

import hashlib
import os
import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strongbox.llm import near_dedup as near
from strongbox.llm import substring_dedup as sub
from strongbox.llm.exact_dedup import exact_dedup

from .helpers import frame, odd_texts, prose


@pytest.mark.parametrize("bits", [128, 4])
@pytest.mark.parametrize("keep,few", [("min", 10**6), ("max", 10**6), ("min", 0)])
def test_exact(spark, bits, keep, few):
    """With 4 bits of hash almost every group collides: bytes decide."""
    texts = odd_texts()
    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    pick = min if keep == "min" else max
    want = {i: (pick(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts}
    rows = exact_dedup(frame(spark, texts, extra=True), keep=keep, hash_bits=bits, most_broadcast=few).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in rows} == want and len(rows) == len(texts)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)


def test_exact_nulls_repeats_and_nothing(spark):
    assert exact_dedup(frame(spark, [])).count() == 0
    rows = exact_dedup(frame(spark, [(None, "a"), (3, "a"), (3, "a"), (None, "b")])).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows) == {(None, 3, 3, False): 1, (3, 3, 3, True): 2, (None, None, 1, True): 1}


def brute_windows(texts, window):
    seen, out = {}, {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone[s : s + window] = [True] * window
            else:
                seen[w] = (i, s)
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


def passages(seed, n=60):
    rng = random.Random(seed)
    common = [prose(rng, rng.randrange(18, 60)) for _ in range(6)]
    texts = odd_texts(seed)
    for k in range(n):
        parts = [prose(rng, rng.randrange(0, 40)) if rng.random() < 0.5 else rng.choice(common) for _ in range(rng.randrange(1, 5))]
        texts.append((100 + k, " ".join(parts)))
    texts.append((500, " ".join(["again"] * 90)))
    return texts


@pytest.mark.parametrize("window", [5, 20])
@pytest.mark.parametrize("few", [10**6, 0])
def test_substrings(spark, window, few):
    """few = 0: nothing is broadcast, texts are dealt by id."""
    texts = passages(window)
    rows = sub.substring_dedup(frame(spark, texts, extra=True).repartition(5), window, most_broadcast=few).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in rows} == brute_windows(texts, window)


def test_substrings_repeats_and_nothing(spark):
    assert sub.substring_dedup(frame(spark, [])).count() == 0
    text = prose(random.Random(3), 50)
    rows = sub.substring_dedup(frame(spark, [(1, text), (1, text), (2, text), (None, "few words")])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 0), (1, 0), (1, 0), (2, 50)]


def test_null_ids_of_different_texts(spark):
    rng = random.Random(8)
    shared, a, b, c = (prose(rng, n) for n in (30, 40, 40, 40))
    texts = [(None, f"{shared} {a}"), (None, f"{shared} {b}"), (1, c), (2, f"{c} {b}"), (3, f"{a} {shared}")]
    rows = sub.substring_dedup(frame(spark, texts)).collect()
    assert {r.doc_id for r in rows} == {None, 1, 2, 3}
    # the passage stays in one row without id and goes from the other; their own words stay
    assert sorted((r.n_words, r.n_removed) for r in rows if r.doc_id is None) == [(70, 0), (70, 30)]
    assert {r.doc_id: r.n_removed for r in rows if r.doc_id} == {1: 0, 2: 80, 3: 70}
    close = [(None, a), (None, b), (1, a + " tail"), (2, b + " tail"), (3, c)]
    rows = near.near_dedup(frame(spark, close)).collect()
    assert sorted((r.doc_id or 0, r.class_id, r.kept) for r in rows if r.doc_id != 3) == [(0, None, True), (0, None, True), (1, None, False), (2, None, False)]
    with pytest.raises(ValueError, match="null ids"):
        near.near_dedup(frame(spark, [(None, a), (-(2**63) + 5, b)]))


@pytest.mark.parametrize("window", [4, 7, 20, 50])
def test_every_shift_shares_an_anchor(window):
    period, cover, length = sub.cover_for(window)
    for i in range(period):
        for j in range(period):
            shared = [d for d in range(period) if (i + d) % period in cover and (j + d) % period in cover]
            assert shared and shared[0] + length <= window


def labelled(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))]
    seen = Counter()
    out = []
    for g in grams:
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def similarity(a, b):
    place, tails = {x: k for k, x in enumerate(b)}, []
    for x in a:
        if x in place:
            k = bisect_left(tails, place[x])
            tails[k : k + 1] = [place[x]]
    return len(tails) / (len(a) + len(b) - len(tails))


def brute_classes(texts):
    grams = {i: labelled(t) for i, t in texts}
    parent = {i: i for i, _ in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(parent)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if similarity(grams[i], grams[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in ids}


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = "new%d" % rng.randrange(1000)
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, "more%d" % rng.randrange(1000))
    return " ".join(words)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("few", [10**6, 0])
def test_near(spark, seed, few):
    """Families of edits of all degrees: many pairs are just above or below the threshold."""
    rng = random.Random(seed)
    texts = odd_texts(seed)
    for f in range(4):
        base = prose(rng, rng.randrange(80, 200))
        texts += [(1000 * (f + 1) + k, edited(rng, base, rng.randrange(0, 8))) for k in range(30)]
    rows = near.near_dedup(frame(spark, texts, extra=True).repartition(4), most_broadcast=few).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute_classes(texts) and len(rows) == len(texts)
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)


@pytest.mark.parametrize("side_rows", [3, 50])
def test_near_postings_dealt_as_sides(spark, side_rows):
    """Hot postings as pairs of sides, and components that put few members forward at a time."""
    rng = random.Random(21)
    base = prose(rng, 150)
    texts = [(k, edited(rng, base, rng.randrange(2, 12))) for k in range(90)]
    rows = near.near_dedup(frame(spark, texts), turns=1, growth=2, side_rows=side_rows).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute_classes(texts)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_recall_on_documents(spark):
    """All links among the driver's documents, by brute force over those that share a shingle and fit in size."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    heads = {}
    for r in docs.orderBy("doc_id").collect():
        heads.setdefault(r.text or "", r.doc_id)
    grams = {i: labelled(t) for t, i in heads.items()}
    holders = defaultdict(list)
    for i, g in grams.items():
        for x in g:
            holders[x].append(i)
    shared = Counter()
    for ids in holders.values():
        for k, i in enumerate(ids):
            shared.update((i, j) for j in ids[:k])
    links = [(i, j) for (i, j), n in shared.items() if n >= 0.8 * (len(grams[i]) + len(grams[j]) - n) and similarity(grams[i], grams[j]) >= 0.8]
    found = {r.doc_id: r.class_id for r in near.near_dedup(docs).collect()}
    assert links and all(found[i] == found[j] for i, j in links)


def test_near_pairs_of_one_sketch_that_no_leader_verified(spark):
    rng = random.Random(5)
    bodies = [prose(rng, 40) for _ in range(3)]
    texts = [(1, bodies[0]), (2, bodies[0] + " tail"), (3, bodies[1]), (4, bodies[1] + " tail"), (9, bodies[2])]
    while True:  # a passage whose shingle is the only sketch of all
        passage = prose(rng, 5)
        given = [(i, passage + " " + t) for i, t in texts]
        rows = near.shingle_rows(pa.array([t for _, t in given]), 5)
        if len({int(near.sketches(x, 1, 1)[0]) for x in rows}) == 1:
            break
    rows = near.near_dedup(frame(spark, given), count=1, least=1, turns=1).collect()
    assert {r.doc_id: r.class_id for r in rows} == brute_classes(given) == {1: 1, 2: 1, 3: 3, 4: 3, 9: 9}


def test_near_nulls_repeats_and_nothing(spark):
    assert near.near_dedup(frame(spark, [])).count() == 0
    rows = near.near_dedup(frame(spark, [(None, "a b c d e f"), (1, "a  b c d e f"), (2, None), (3, " "), (4, "a b"), (4, "a b"), (5, "x y z")])).collect()
    assert Counter((r.doc_id, r.class_id, r.kept) for r in rows) == {(None, None, True): 1, (1, None, False): 1, (2, 2, True): 1, (3, 2, False): 1, (4, 4, True): 2, (5, 5, True): 1}


def test_sketch_follows_similarity_and_order():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = a.copy()
    b[rng.choice(400, 44, replace=False)] = rng.integers(0, 2**63, 44).astype(np.uint64)  # similarity 0.8
    same = np.mean(near.sketches(a, 4000, 3) == near.sketches(b, 4000, 3))
    assert abs(same - 0.8**3) < 0.06
    assert np.mean(near.sketches(a, 500, 3) == near.sketches(a[::-1].copy(), 500, 3)) < 0.3


def test_alignment_band():
    a = np.arange(100, dtype=np.uint64)
    assert near.aligned_similarity(a, a, 0.8) == 1.0
    assert near.aligned_similarity(a, a[::-1].copy(), 0.8) <= 0.1
    assert near.aligned_similarity(a, a[:70], 0.8) == 0.0
    assert near.aligned_similarity(a, np.concatenate([a[50:], a[:50]]), 0.8) < 0.8
