"""The subpackage's queries against their SQL and each other, on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from strongbox.llm import queries
from strongbox.llm.decontamination import overlaps
from strongbox.llm.near_dedup import near_dedup

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    mine, sql = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(sql.columns)
    assert columns == sorted(mine.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (mine, sql))
    assert a.equals(b)


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").toPandas()
    found = queries.QUERIES["op4_language_id"](spark, data).toPandas().merge(docs, on="doc_id")
    held = found[found.held_out]
    assert len(found) == 1000 and 150 < len(held) < 250 and (held.lang == held.lang_pred).mean() > 0.97
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "toxic").toPandas()
    scored = queries.QUERIES["op1_toxicity"](spark, data).toPandas()
    assert len(scored) == 1000 and ((scored.score >= 0.7) == (scored.predicted == 1)).all()
    held = scored.merge(labels, on="doc_id").query("held_out")
    assert (held.toxic == held.predicted).mean() > 0.93 and held[held.toxic == 1].predicted.mean() > 0.7


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "tokens"]
    scores = {r.doc_id: r.score for r in queries.QUERIES["op1_toxicity"](spark, DATA).collect()}
    clean = stages["toxicity"](spark, docs, DATA)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, s in scores.items() if s < 0.7}
    texts = {r.doc_id: r.text for r in docs.collect()}
    exact = stages["exact_dedup"](spark, docs.union(docs.limit(3)), DATA)
    least = {}
    for i in sorted(texts):
        least.setdefault(texts[i], i)
    rows = exact.collect()
    assert sorted(r.doc_id for r in rows) == sorted(least.values()) and exact.columns == docs.columns
    near = {r.doc_id for r in stages["near_dedup"](spark, docs, DATA).collect()}
    assert near == {r.class_id for r in near_dedup(docs).collect()}
    left = {r.doc_id for r in stages["decontamination"](spark, docs, DATA).collect()}
    hit = {r.doc_id for r in overlaps(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert hit and left == set(texts) - hit
    found = corpus_pipeline.run(spark, DATA).collect()
    kept = {r.doc_id for r in found}
    assert kept and kept <= near & left and all(r.round_trip for r in found)
    assert np.mean([r.n_pieces for r in found]) > 5


def test_stages_decide_rows_without_id(spark):
    stages = dict(corpus_pipeline.STAGES)
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").where("item_id IS NOT NULL AND text IS NOT NULL").first().text
    text, other = (" ".join(f"{w}{k}" for k in range(60)) for w in "ab")
    left = lambda name, rows: sorted((r.doc_id or 0, r.text) for r in stages[name](spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA).collect())
    assert left("exact_dedup", [(5, text), (None, text), (None, other), (None, other)]) == [(0, other), (5, text)]
    assert left("near_dedup", [(5, text), (None, text + " tail"), (None, other)]) == [(0, other), (5, text)]
    assert left("decontamination", [(None, item), (None, other), (5, text)]) == [(0, other), (5, text)]


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns with clashing names."""
    long_ = " ".join(f"word{k}" for k in range(60_000))
    rows = [(1, long_), (2, None), (3, ""), (3, ""), (None, None), (None, long_ + " tail"), (4, "short"), (4, "short"), (5, "é😀 \t"), (6, "x" * 100_000)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("key", "id", "kept", "score", "doc", "comp", "_id", "_text", "h", "text_sha256"):
        docs = docs.selectExpr("*", f"CAST(NULL AS STRING) AS {name}")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        left[name] = [(r.doc_id, getattr(r, "text", None)) for r in out.collect()]
        assert name == "tokens" or out.columns == docs.columns
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch
    count = lambda name: len(left[name])
    assert count("toxicity") == count("decontamination") == len(rows)
    # null counts as empty: ids 2 and 3 and the row without id are one text, of which the least id stays
    assert sorted(i for i, _ in left["exact_dedup"] if i) == [1, 2, 4, 5, 6] and [t for i, t in left["exact_dedup"] if i is None] == [long_ + " tail"]
    assert sorted(i for i, _ in left["near_dedup"] if i) == [1, 2, 4, 4, 5, 6] and not [i for i, _ in left["near_dedup"] if i is None]
    samples = Counter(i for i, _ in left["tokens"])
    assert samples[1] == 3 and samples[3] == 2 and samples[2] == 1


def test_work_folder():
    from strongbox.llm.work import work_root

    class Unset:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

        class sparkContext:  # noqa: N801
            master = "local[2]"

    assert work_root(Unset).startswith("file:")
    Unset.sparkContext.master = "spark://host:7077"
    with pytest.raises(ValueError, match="checkpoint"):
        work_root(Unset)


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_without_the_subpackage():
    """The entry module imports without the subpackage and the pipeline."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = (
        "import sys\n"
        "class No:\n"
        "    def find_spec(self, name, *a):\n"
        "        if name in ('corpus_pipeline', 'strongbox.llm'): raise ModuleNotFoundError(name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not [n for n in e.queries() if n.startswith('op') and n[2].isdigit() or n == 'pipeline']\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
