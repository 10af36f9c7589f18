"""Small tables with everything that can go wrong in them."""

import random

WORDS = "the of and tion ing er on re at en is it or an ed to in that this with was are be from by not have".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) * rng.randrange(2) for _ in range(n))


def frame(spark, texts, extra=False):
    """Documents from (doc_id, text) pairs; with extra columns whose names operators use inside."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    out = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("key", "id", "t", "_id", "_text", "doc", "comp", "score", "places", "kept", "h"):
            out = out.selectExpr("*", f"'x' AS {name}")
    return out


def odd_texts(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(1, 120)) for _ in range(12)]
    texts = base + ["", " \t\n", "word", "ünïcödé 日本 😀 text", None, "x" * 30_000, prose(rng, 9_000)]
    texts += base[:5] + ["", None] + [base[0] + " tail", base[1].replace(" ", "\n")]
    return [(i, t) for i, t in enumerate(texts)]
