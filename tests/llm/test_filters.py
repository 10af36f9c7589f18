"""Url rules, decontamination, language and toxicity."""

import random
import re
from itertools import product

import duckdb
import numpy as np
import pytest

from strongbox.llm import decontamination as dec
from strongbox.llm import language_id as lang
from strongbox.llm import toxicity as tox
from strongbox.llm import url_rules as url

from .helpers import WORDS, frame, odd_texts, prose

RULES = url.RULES + [("a.b.example.org", "/x", "block"), ("b.example.org", "", "allow"), ("org", "/x/y", "block"), ("org", "/x/y", "allow"), ("", "/", "block"), (None, "/", "block"), ("de", None, "block")]


def brute_rule(text):
    host = path = ""
    if text and "://" in text:
        rest = text.split("://", 1)[1]
        end = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
        host, rest = rest[:end], rest[end:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[: next((k for k, c in enumerate(rest) if c in "?#"), len(rest))]
    rules = {}
    for h, p, action in RULES:
        if h:
            rules[h, p or ""] = max(action, rules.get((h, p or ""), ""))
    fits = [(len(h + p), len(h), p, h + p, a) for (h, p), a in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("parts", [4, 40])
def test_urls(spark, parts):
    hosts = ["example.com", "www.example.com", "EXAMPLE.com", "x.a.b.example.org", "b.example.org", "org", "xorg", "example.net", "notexample.com", "de", "a.de:80", "", "com.", "éxample.com"]
    paths = ["", "/", "/en/", "/en", "/en/x?q=/fr/", "/es/#a", "/x/y/z", "/X", "?en/", "#://b/"]
    urls = ["http://" + h + p for h, p in product(hosts, paths)] + [None, "", "no scheme", "://com/", "http://www.example.com/en/1"] + ["http://hot.example.com/en/7"] * 300
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' AS key", "'y' AS path", "1 AS salt")
    rows = url.url_filter(pages, rules).collect()
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == {k: brute_rule(u) for k, u in enumerate(urls)} and len(rows) == len(urls)
    assert url.url_filter(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url.url_filter(pages.limit(5), rules.limit(0), default="block").collect()} == {"block"}


def test_masks_are_lossless():
    assert not dec.misses(dec.MASKS, 13, 2) and dec.misses(dec.MASKS, 13, 4) and dec.misses(dec.MASKS[:1], 13, 2)


@pytest.mark.parametrize("few", [500_000, 0])
def test_decontamination(spark, few):
    rng = random.Random(7)
    items = [(k, prose(rng, n)) for k, n in enumerate([30, 13, 40, 9, 5, 0, 60])] + [(90, None), (None, "a b c")]
    texts = odd_texts(3)
    for k in range(60):
        words = items[rng.choice([0, 1, 2, 6])][1].upper().split()
        at = rng.randrange(max(1, len(words) - 12))
        cut = words[at : at + rng.choice([8, 12, 13, 20])]
        for _ in range(rng.randrange(4)):
            cut[rng.randrange(len(cut))] = "other"
        texts.append((200 + k, prose(rng, rng.randrange(20)) + " " + ", ".join(cut) + "\n" + prose(rng, rng.randrange(20))))
    texts += [(300, "%s!" % items[3][1]), (301, items[4][1]), (None, items[0][1])]
    docs, bench = frame(spark, texts, extra=True), spark.createDataFrame(items, "item_id long, text string")
    rows = dec.decontaminate(docs, bench, most_broadcast=few).collect()
    con = duckdb.connect()
    documents, benchmark = frame(spark, texts).toPandas().astype({"doc_id": "Int64"}), bench.toPandas().astype({"item_id": "Int64"})  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT * FROM documents")
    con.execute("CREATE TABLE benchmark AS SELECT * FROM benchmark WHERE item_id IS NOT NULL")
    want = {r[0]: r[1:] for r in con.execute(dec.ORACLE.replace("FROM documents)", "FROM documents WHERE doc_id IS NOT NULL)")).fetchall()}
    assert {r.doc_id: (r.contaminated, r.n_items, r.matched) for r in rows} == want
    hit = {r.doc_id for r in rows if r.contaminated}
    assert len(hit) > 20 and 301 in hit and None not in hit  # 301 is an item of five words


@pytest.mark.parametrize("few", [10**6, 0])
def test_short_items(spark, few):
    """Items of one to eight words stand in a text whole and unchanged, or they don't."""
    rng = random.Random(11)
    items = [(k, prose(rng, n)) for k, n in enumerate([1, 2, 2, 3, 4, 5, 6, 7, 8])] + [(20, "!?"), (21, None), (22, "Zebra zebra")]
    texts = [(100 + k, prose(rng, 12)) for k in range(30)]
    for k, (_, t) in enumerate(items[:9]):
        words = t.split()
        texts += [(200 + k, "- " + t.upper() + "."), (300 + k, prose(rng, 3) + "\n" + ", ".join(words) + " " + prose(rng, 3)), (400 + k, " ".join(words[:-1]))]
    texts += [(500, "zebra, ZEBRA zebra"), (501, "zebra"), (502, None), (503, "")]
    find = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want = set()
    for i, t in texts:
        words = find(t)
        for j, x in items:
            own = find(x)
            if own and any(words[a : a + len(own)] == own for a in range(len(words) - len(own) + 1)):
                want.add((i, j, len(own)))
    found = dec.overlaps(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"), most_broadcast=few).collect()
    assert {(r.doc_id, r.item_id, r.matched) for r in found} == want and len(found) == len(want) > 15


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dec.decontaminate(frame(spark, []), bench).count() == 0
    assert not any(r.contaminated for r in dec.decontaminate(frame(spark, odd_texts()), bench).collect())


SPOKEN = {
    "en": "the and that with this from have which would there their about other people".split(),
    "de": "der die und nicht eine werden auch über zwischen möglich schön können straße".split(),
    "fr": "les des une dans être très où français beaucoup même après élève ça".split(),
    "es": "los las que una también más está niño años después cómo mañana".split(),
    "it": "gli della che sono anche perché più città essere questo molto degli".split(),
    "nl": "het een van zijn niet ook maar worden tussen mogelijk veel goed huis".split(),
}


def spoken(code, rng, n):
    return " ".join(rng.choice(SPOKEN[code]) for _ in range(n))


@pytest.mark.parametrize("known", [1, 2, 4, 6])
def test_language(spark, known):
    rng = random.Random(known)
    codes = list(SPOKEN)[:known]
    rows = [(k, spoken(c := codes[k % known], rng, rng.randrange(8, 60)), c) for k in range(240)]
    train = spark.createDataFrame(rows[:180] + [(900, None, "en"), (901, "text", None), (902, "", "en")], "doc_id long, text string, lang string")
    model = lang.fit(train)
    odd = [(1000, None), (1001, ""), (1002, "123 !? 456"), (1003, "x"), (1004, "日本"), (1005, "the " * 200_000)]
    found = lang.identify(frame(spark, [(k, t) for k, t, _ in rows[180:]] + odd + odd[:1], extra=True), model).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == 67 and np.mean([got[k].lang_pred == c for k, _, c in rows[180:]]) > 0.97
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0
    assert got[1003].lang_pred in codes and got[1004].lang_pred in codes and got[1005].lang_pred == ("en" if "en" in codes else codes[0])
    assert all(0 <= r.score <= 1 for r in found)


def test_language_without_labels(spark):
    model = lang.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in lang.identify(frame(spark, odd_texts()), model).collect()} == {"und"}
    assert lang.identify(frame(spark, []), model).count() == 0


@pytest.mark.parametrize("k", [2, 3, 5, 6, 20])
def test_codewords(k):
    code = lang.codewords(k)
    apart = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
    assert code.shape[0] == k and apart >= 1 and (k <= 5 or apart * 4 >= code.shape[1] - 1)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_trie_is_levenshtein():
    rng = random.Random(4)
    letters = "abc"
    terms = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(3, 11))) for _ in range(40)})
    trie = tox.FuzzyTrie(terms, [], most=50)
    for _ in range(3000):
        t = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randrange(2)] = rng.choice(["", "a", "b", "c"])
        word = "".join(t)
        want = min(((d, x) for x in terms if (d := distance(word, x)) <= tox.allowed_edits(x)), default=None)
        assert trie.find(word) == (want and (want[1], want[0]))
    stems = tox.FuzzyTrie(["stupid"], ["stu", "stup"])
    assert stems.find("stupid") == ("stupid", 0) and stems.find("stupor") == ("stup", -1) and stems.find("xtupid") == ("stupid", 1)


def labelled(rng, n):
    bad = ["blockhead", "numbskull", "dimwitted"]
    out = []
    for k in range(n):
        words, toxic = prose(rng, rng.randrange(10, 60)).split(), k % 4 == 0
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        out.append((k, " ".join(words), int(toxic)))
    return out


def test_toxicity(spark):
    rows = labelled(random.Random(2), 600)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows[:400]] + [(None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    docs = frame(spark, [(k, t) for k, t, _ in rows] + [(None, "blockhead"), (900, None), (901, "")], extra=True)
    scorer = tox.fit(docs, labels)
    got = {r.doc_id: r.score for r in tox.score_texts(docs, scorer).collect()}
    assert len(got) == 603 and all(0 <= s <= 1 for s in got.values()) and got[900] < 0.5 and got[901] < 0.5
    assert np.mean([(got[k] >= 0.7) == bool(y) for k, _, y in rows[400:]]) > 0.97
    plain = " ".join(WORDS)
    score = lambda t: scorer.score(plain + t + plain)
    assert score(" you blokhead and numbskul ") > 0.7 > score(" ")  # misspelled
    assert score(" you bl0ckhead, $numbskull$ ") > 0.7
    assert score(' he said "blockhead and numbskull" then ') < score(" he said blockhead and numbskull then ")
    left = tox.without_toxic(docs, scorer)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {k for k, s in got.items() if s < 0.7}


def test_toxicity_without_labels(spark):
    scorer = tox.fit(frame(spark, odd_texts()), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in tox.score_texts(frame(spark, odd_texts()), scorer).collect()} == {0.0}
    assert tox.score_texts(frame(spark, []), scorer).count() == 0


def brute_score(scorer, text):
    """The score by walking the tokens one by one."""
    tokens = re.findall(r"[^\W]+(?:[@$*\w]+)?|[\w@$*]+|[\"“”„«»\n]", text.lower())
    hits = [(i, *found) for i, t in enumerate(tokens) if (found := scorer.lexicon.look(t))]
    quoted, opened = [], None
    for i, t in enumerate(tokens):
        if t == "\n":
            opened = None
        elif t in "\"“”„«»":
            if opened is None:
                opened = i
            else:
                quoted.append((opened, i))
                opened = None
    x = [0.0] * 7
    if hits:
        inside = [any(a < i < b for a, b in quoted) for i, _, _ in hits]
        free = [w / 4 if q else w for (_, w, _), q in zip(hits, inside, strict=True)]
        near = [sum(f for f, (j, _, _) in zip(free, hits, strict=True) if abs(i - j) <= 8) for i, _, _ in hits]
        x = [
            np.log1p(sum(w for (_, w, _), q in zip(hits, inside, strict=True) if not q)), np.log1p(sum(w for (_, w, _), q in zip(hits, inside, strict=True) if q)),
            np.log1p(max(near)), np.log1p(100 * sum(free) / (len(tokens) + 20)), np.log1p(len({t for _, _, t in hits})), max(w for _, w, _ in hits),
            np.log1p(sum(sorted(free)[-3:])),
        ]
    return 1 / (1 + np.exp(-(np.dot(x, scorer.coef[:-1]) + scorer.coef[-1])))


def toxic_rows(n=200, seed=5):
    rng = random.Random(seed)
    bad = ["blockhead", "numbskull", "dimwit", "halfbrain"]
    rows = []
    for k in range(n):
        words = prose(rng, rng.randrange(5, 60)).split()
        if k % 2:
            for _ in range(rng.randrange(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words), k % 2))
    return rows


def test_score_by_brute_force(spark):
    rows = toxic_rows()
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    scorer = tox.fit(frame(spark, [(k, t) for k, t, _ in rows]), labels)
    rng = random.Random(9)
    texts = ["", None, " \n ", '"', "blockhead", '"blockhead"', '"blockhead\n"', "x" * 50_000, '«numbskull» and "dimwit', "Blokhead numb5kull " * 3000]
    for _ in range(80):
        words = prose(rng, rng.randrange(1, 40)).split()
        for _ in range(rng.randrange(6)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["blockhead", "dimwits", "DIMWIT!", "halfbrian", '"', "\n", "“", "”", "numbskul", "$dimwit$"]))
        texts.append(" ".join(words))
    got = {r.doc_id: r.score for r in tox.score_texts(frame(spark, list(enumerate(texts))), scorer).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert abs(got[i] - brute_score(scorer, t or "")) < 1e-5, t
    # what else is in a batch makes no difference
    assert [got[i] for i in range(len(texts))] == [scorer.score(t) for t in texts]


def test_fit_takes_one_text_of_a_repeated_id(spark):
    rows = toxic_rows()
    texts = [(k, t) for k, t, _ in rows] + [(1, f"another {k} text") for k in range(50)] + [(3, rows[3][1])] * 20
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(1, 1)] * 30 + [(None, 1), (2, None)], "doc_id long, toxic int")
    scorer = tox.fit(frame(spark, texts), labels)
    assert scorer.score("you blockhead, you numbskull") > 0.7


def test_rare_languages_are_learned(spark):
    rng = random.Random(4)
    made = {"aa": "the of and to", "bb": "der und die das", "cc": "los las para con"}
    texts = [(i, " ".join(rng.choice(made[lang].split()) for _ in range(12)), lang) for i, lang in enumerate(["aa"] * 600 + ["bb"] * 80 + ["cc"] * 3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = lang.fit(docs, sample_docs=30)
    assert sorted(model.langs) == ["aa", "bb", "cc"]
    found = {r.doc_id: r.lang_pred for r in lang.identify(docs, model).collect()}
    assert sum(found[i] == x for i, _, x in texts) > 0.95 * len(texts)
    assert lang.fit(docs.limit(0)).langs == []


def test_decoding_by_brute_force():
    """The nearest codeword by the sum of its bits' logistic losses, each with its weight."""
    import pyarrow as pa

    rng = random.Random(6)
    words = {"aa": "the of and to it", "bb": "der und die das ist", "cc": "los las para con que", "dd": "les des pour avec est"}
    rows = [(" ".join(rng.choice(words[x].split()) for _ in range(15)), x) for x in words for _ in range(30)]
    model = lang.Model([t for t, _ in rows], [x for _, x in rows])
    texts = [t for t, _ in rows[::7]] + ["los und the pour", "", "zzz", "the " * 4000]
    first, score, lead = model.predict(pa.array(texts))
    four, offsets = lang._grams(pa.array(texts))
    means, _ = model._sums(*lang._hashed(four), offsets)
    for k in range(len(texts)):
        losses = []
        for code in model.code:
            total = sum(t * np.log1p(np.exp(-c * (m * s + h))) for t, c, m, s, h in zip(model.trust, code, means[k], model.scale, model.shift, strict=True))
            losses.append(total / sum(model.trust))
        assert first[k] == int(np.argmin(losses)) and abs(lead[k] - (sorted(losses)[1] - min(losses))) < 1e-9
        power = [np.exp(-len(model.trust) * (x - min(losses))) for x in losses]
        assert abs(score[k] - 1 / sum(power)) < 1e-9


def test_many_paths_of_one_host(spark):
    rules = [("a.example.org", f"/p{k}/", "block" if k % 2 else "allow") for k in range(300)] + [("a.example.org", "", "block"), ("org", "/p7/x", "allow")]
    urls = [(k, f"https://b.a.example.org/p{k}/x/y") for k in range(320)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    found = {r.page_id: (r.rule, r.verdict) for r in url.url_filter(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect()}
    for k, _ in urls:
        assert found[k] == ((f"a.example.org/p{k}/", "block" if k % 2 else "allow") if k < 300 else ("a.example.org", "block"))
