"""Every query with SQL gives the SQL's rows; DuckDB reads the same files."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from strongbox import queries
from strongbox.codecs import archive
from strongbox.dims import preset
from strongbox.operators import archives

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, duck, name):
    mine = queries.QUERIES[name](spark, DATA).toPandas()
    sql = duck.execute(queries.ORACLE[name]).df()
    columns = sorted(sql.columns)
    assert columns == sorted(mine.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (mine, sql))
    assert a.equals(b)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


ODD = [(1, ""), (2, None), (3, "a"), (3, "a"), (3, ""), (4, "é" * 70_000), (5, "b" * 240), (None, "no id"), (None, None)]


def same_on_odd_documents(spark, folder, name):
    """A row for each document, also where texts are empty or missing, or ids repeat or are missing."""
    spark.createDataFrame(ODD, "doc_id long, text string").repartition(2).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    mine, sql = queries.QUERIES[name](spark, str(folder)), con.execute(queries.ORACLE[name])
    columns = [c[0] for c in sql.description]
    rows = [tuple(r) for r in mine.select(columns).collect()]
    assert sorted(rows, key=str) == sorted(sql.fetchall(), key=str) and len(rows) == len(ODD)


def test_chunk_walk_keeps_every_document(spark, tmp_path):
    """F1"""
    same_on_odd_documents(spark, tmp_path, "chunk_walk")


def test_codeword_rows_keeps_every_document(spark, tmp_path):
    """F2"""
    same_on_odd_documents(spark, tmp_path, "codeword_rows")


def test_tree_functions_keeps_files_of_no_bytes(spark, tmp_path):
    """its table function gives no rows for them either."""
    texts = ["", None, "a", "b" * 65536, "c" * 200_000]
    rows = [(k, t, "en", f"src{k}") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.file_id: (r.blocks, r.same) for r in queries.tree_functions(spark, str(tmp_path)).collect()}
    assert found == {f"en/src{k}/0": (-(-len(t or "") // 65536), True) for k, t in enumerate(texts)}


def test_both_copies_are_spoiled_whatever_a_block_holds(spark, tmp_path):
    """last blocks of few bytes, and data that is zero already."""
    texts = ["a" * (blocks * 65536 + more) for blocks in range(3) for more in (*range(8), 65536 - 8192, 65535)] + ["\0" * 9, "b" * 65536 + "\0" * 70_000]
    rows = [(k, t, "en", f"src{k}") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.execute(queries.ORACLE["multi_copy_repair"])
    mine = queries.multi_copy_repair(spark, str(tmp_path)).select([c[0] for c in sql.description]).collect()
    assert sorted(map(tuple, mine)) == sorted(sql.fetchall()) and len(mine) == sum(-(-len(t) // 65536) for t in texts)


def test_native_parity_is_the_codec_s(spark):
    from strongbox.codecs import rs
    import numpy as np

    rows = queries.rs_parity_64_40(spark, DATA).collect()
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    words = [texts[r.key][40 * r.word_idx : 40 * r.word_idx + 40].ljust(40, b"\0") for r in rows]
    data = np.frombuffer(b"".join(words), np.uint8).reshape(-1, 40)
    assert [r.parity for r in rows] == [p.tobytes().hex() for p in rs.encode(data, 64, 40)]


def test_parity_of_whole_texts(spark, tmp_path):
    """Against the joins of the native parity, word by word."""
    from strongbox.operators import parity

    given = [(1, "a" * 39), (2, "b" * 40), (3, "é" * 41), (4, ""), (5, None), (6, "".join(chr(33 + k * 7 % 90) for k in range(9001))), (None, "no id")]
    spark.createDataFrame(given, "doc_id long, text string").repartition(1).write.parquet(str(tmp_path / "documents.parquet"))
    words = []
    for i, text in given:
        raw = (text or "").encode()
        words += [(i or 0, k, bytearray(raw[k * 40 : k * 40 + 40].ljust(40, b"\0"))) for k in range(max(1, -(-len(raw) // 40)))]
    native = parity.parity(spark.createDataFrame(words, "key long, word_idx long, data binary"), ["key", "word_idx"], "data", 64, 40)
    rows = queries.rs_parity_64_40(spark, str(tmp_path)).collect()
    assert len(rows) == len(words) and {(r.key or 0, r.word_idx, r.parity) for r in rows} == {tuple(r) for r in native.collect()}
    assert {r.key for r in rows} == {i for i, _ in given}
    texts = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert queries.rs_parity_64_40(spark, DATA).count() == sum(max(1, -(-len((r.text or "").encode()) // 40)) for r in texts)


def test_frames_and_bytes_agree(spark):
    files = [(1, b""), (2, b"x" * 200_000), (3, b"\0"), (4, None)]
    o = preset(2).with_(ecc=1, block_exp=16, prefilter=1)
    packed = archives.pack(spark.createDataFrame(files, "file_id long, content binary"), o)
    found = {r.file_id: bytes(r.archive) for r in packed.collect()}
    assert found == {k: archive.pack(c or b"", o) for k, c in files}
    assert {r.file_id: (r.status, r.n_blocks, r.bad_blocks) for r in archives.verify(packed).collect()} == {1: ("ok", 0, 0), 2: ("ok", 4, 0), 3: ("ok", 1, 0), 4: ("ok", 0, 0)}


def test_reports_and_strict(spark):
    packed = archive.pack(b"y" * 300_000, preset(1).with_(ecc=0, block_exp=16))
    at = archive.directory(packed).entries[2].at + 70
    frame = spark.createDataFrame([("bad", packed[:at] + bytes(8) + packed[at + 8 :]), ("cut", packed[:-80]), ("none", b"")], "file_id string, archive binary")
    status = {r.file_id: (r.status, r.bad_blocks) for r in archives.verify(frame).collect()}
    assert status["bad"][1] == 1 and status["bad"][0] != "ok" and status["cut"][0] == "truncated" and status["none"][0] == "truncated"
    with pytest.raises(Exception, match="archive bad"):
        archives.unpack(frame.where(F.col("file_id") == "bad"), strict=True).collect()


def test_best_copies_without_any_good(spark):
    packed = archive.pack(b"z" * 70_000, preset(1).with_(ecc=0, block_exp=16))
    spoiled = packed[:100] + bytes(20) + packed[120:]
    frame = spark.createDataFrame([(1, 0, spoiled), (1, 1, spoiled)], "file_id long, copy int, archive binary")
    rows = sorted(archives.best_copies(frame).collect(), key=lambda r: r.block_idx)
    assert rows[0].data is None and bytes(rows[1].data) == b"z" * (70_000 - 65536)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
