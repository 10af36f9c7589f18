"""What must grow no faster than the input: steps over many small rows are taken together, and nothing is listed or packed again."""

import pytest

from strongbox.codecs import archive, blake, rs
from strongbox.dims import preset
from strongbox.sources import archive as source

OPTIONS = preset(1).with_(ecc=3, block_exp=16)
TEXTS = [bytes([k % 251]) * (k * 37 % 3000) for k in range(100)]


@pytest.fixture
def counted(monkeypatch):
    """How often a module's function is called."""

    def count(module, name: str) -> list:
        calls, real = [], getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **k: calls.append(1) or real(*a, **k))
        return calls

    return count


def test_stream_lists_a_backlog_once(tmp_path, counted):
    """F1"""
    for k in range(9):
        (tmp_path / f"{k}.sba").write_bytes(archive.pack(b"x" * k, OPTIONS))
    listed = counted(source, "archive_files")
    stream = source.ArchiveStream({"path": str(tmp_path), "logPath": str(tmp_path / "log"), "maxFilesPerTrigger": "2"})
    assert [stream.latestOffset()["batch"] for _ in range(5)] == [1, 2, 3, 4, 5] and len(listed) == 1
    (tmp_path / "9.sba").write_bytes(archive.pack(b"new", OPTIONS))
    (tmp_path / "1.sba").write_bytes(archive.pack(b"other", OPTIONS))
    assert stream.latestOffset()["batch"] == 6 and stream.latestOffset()["batch"] == 6
    names = [e[0].rpartition("/")[2] for batch in stream.batches for e in batch]
    assert sorted(names) == sorted([f"{k}.sba" for k in range(10)] + ["1.sba"])
    assert len(stream.partitions({"batch": 0}, {"batch": 1})) == 2


def test_stream_takes_files_as_they_are_now(tmp_path):
    """a file that changed or went while it waited is read as it is, or not at all."""
    for k in range(4):
        (tmp_path / f"{k}.sba").write_bytes(archive.pack(b"x" * k, OPTIONS))
    stream = source.ArchiveStream({"path": str(tmp_path), "logPath": str(tmp_path / "log"), "maxFilesPerTrigger": "1"})
    stream.latestOffset()
    (tmp_path / "2.sba").write_bytes(archive.pack(b"longer by far" * 9000, OPTIONS))
    (tmp_path / "1.sba").unlink()
    assert [stream.latestOffset()["batch"] for _ in range(4)] == [2, 3, 3, 3]
    assert [(e[0].rpartition("/")[2], e[1]) for e in stream.batches[1]] == [("2.sba", (tmp_path / "2.sba").stat().st_size)]


def test_sink_and_source_hash_together(tmp_path, counted):
    """F1, F4, F17"""
    steps = counted(blake, "compress")
    writer = source.ArchiveWriter({"path": str(tmp_path), "ecc": "1", "preset": "1", "blockExponent": "16"})
    writer.commit([writer.write([{"name": str(k), "content": t} for k, t in enumerate(TEXTS)])])
    assert len(steps) < 100
    assert (tmp_path / "7.sba").read_bytes() == archive.pack(TEXTS[7], preset(1).with_(ecc=1, block_exp=16))
    steps.clear()
    reader = source.ArchiveReader({"path": str(tmp_path)}, "data")
    rows = [row for runs in reader.partitions() for row in reader.read(runs)]
    assert len(steps) < 100 and all(row[2] == "ok" for row in rows)
    assert {int(row[0].rpartition("/")[2][:-4]): row[4] for row in rows} == {k: t for k, t in enumerate(TEXTS) if t}


def test_coding_of_many_is_done_together(counted):
    """F2, F6, F10, F11"""
    steps, sums = counted(blake, "compress"), counted(rs, "encode")
    packed = archive.pack_many(TEXTS, OPTIONS, True)
    assert packed[5] == archive.pack(TEXTS[5], OPTIONS, True) and archive.pack_many([], OPTIONS) == []
    found = archive.damage_many(packed, list(range(100)))
    assert found[9] == archive.damage(packed[9], 9)
    assert archive.unpack_many([a for a, _ in found]) == [(t, "ok", n) for t, (_, n) in zip(TEXTS, found, strict=True)]
    assert [r[:2] for r in archive.repair_many([a for a, _ in found])] == [(p, n) for p, (_, n) in zip(packed, found, strict=True)]
    assert archive.verify_many([a for a, _ in found]) == [("ok", 1 if t else 0, 0, n) for t, (_, n) in zip(TEXTS, found, strict=True)]
    assert len(steps) < 400 and len(sums) < 200


def test_damage_is_spread_and_is_exact():
    """of every stretch just so many bytes change, and none stays what it was."""
    packed = archive.pack(bytes(range(256)) * 400, OPTIONS, True)
    found, n = archive.damage(packed, 3)
    places = [k for k in range(len(packed)) if packed[k] != found[k]]
    assert len(places) == n == sum(most for *_, most in archive.regions(packed))
    assert all(sum(a <= k < a + size for k in places) == most for _, a, size, most in archive.regions(packed)[:40])
    assert len({k % 255 for k in places}) > 200 and archive.damage(packed, 4)[0] != found


def test_changes_of_many_are_made_together(counted):
    """F9, F12"""
    steps = counted(blake, "compress")
    packed = archive.pack_many(TEXTS, OPTIONS)
    assert archive.unpack_many(archive.append_many(packed, TEXTS)) == [(t + t, "ok", 0) for t in TEXTS]
    other = [b"z" * len(t) for t in TEXTS]
    assert archive.replace_many(packed, [0 if t else None for t in TEXTS], other) == archive.pack_many(other, OPTIONS)
    assert len(steps) < 400


def test_batches_leave_no_memory_behind(counted):
    """A batch is coded a few MiB at a time, and given back before the next."""
    import pyarrow as pa

    from strongbox.operators import archives

    trims, seen = counted(archives, "trim"), []

    def batches():
        for _ in range(3):
            seen.append(len(trims))
            yield pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([b"x" * (1 << 20)] * 9, pa.binary())], names=["id", "archive"])

    assert [part.num_rows for part in archives._few(batches(), 1)] == [4, 4, 1] * 3
    assert seen == [0, 1, 2] and len(trims) == 3


def test_streams_are_hashed_together(counted):
    """what many streams found is judged as one stream's is, also where it is wrong."""
    from strongbox.streaming import decode

    packed = archive.pack_many(TEXTS, OPTIONS)
    wrong = [packed[3][:-64] + packed[4][-64:], packed[9][:300] + bytes([packed[9][300] ^ 1]) * 90 + packed[9][390:]]
    each = [decode.collect(decode.START, [(0, p)])[1] for p in [*packed, *wrong]]
    steps = counted(blake, "compress")
    together = decode.judged([row for found in each for row in found])
    assert len(steps) < 200
    assert together == [row for found in each for row in decode.judged(found)]
    assert [row[4] for row in together if row[1] == "block"][:99] == [t for t in TEXTS if t]
    assert {row[2] for row in together[: -len(each[-1]) - len(each[-2])]} == {"ok"} and each and decode.judged(each[-2])[-1][2] == "root"


def test_few_codewords_are_corrected_as_many_are():
    """numbers for few rows and arrays for many tell the same, also of rows beyond repair."""
    import numpy as np

    random = np.random.default_rng(14)
    for n, k in ((32, 10), (64, 40), (255, 239), (255, 191)):
        words = random.integers(0, 256, (40, k), np.uint8)
        words = np.hstack([words, rs.encode(words, n, k)])
        for row, errors in enumerate(np.arange(40) % ((n - k) // 2 + 3)):
            words[row, random.choice(n, errors, replace=False)] ^= random.integers(1, 256, errors, np.uint8)
        many = rs.decode(words, n, k)
        each = [rs.decode(words[r : r + 1], n, k) for r in range(40)]
        assert (many[1] == [c[0] for _, c in each]).all() and (many[0] == np.vstack([w for w, _ in each])).all() and (many[1] < 0).any()
        s = rs.syndromes(words, n, k).T.copy()
        assert [rs._locator(c) for c in s.T.tolist()] == list(zip(rs._locators(s)[0].T.tolist(), rs._locators(s)[1].tolist(), strict=True))


def test_positions_are_cut_before_the_shuffle(spark, tmp_path):
    """F8; also where an id is repeated or null, against the SQL."""
    import duckdb

    from strongbox import queries

    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (2, None), (3, ""), (None, "y")] + [(4, "x")] * 11, "doc_id long, text string").coalesce(1).write.parquet(path)
    rows = queries.corrupt_topk_positions(spark, str(tmp_path))
    sql = queries.ORACLE["corrupt_topk_positions"].replace("FROM documents", f"FROM '{path}/*.parquet'")
    assert sorted(map(str, map(tuple, rows.collect()))) == sorted(map(str, duckdb.sql(sql).fetchall()))
    assert "slice(" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_repair_makes_headers_once(counted):
    """archives with the same options share their header, and a repaired codeword isn't coded again to be judged."""
    options = preset(2).with_(ecc=2, block_exp=16)
    found = [a for a, _ in archive.damage_many(archive.pack_many(TEXTS, options, True), list(range(100)))]
    sums = counted(rs, "encode")
    assert [a for a, _, _ in archive.repair_many(found)] == archive.pack_many(TEXTS, options, True)
    assert len(sums) < 20


def test_places_are_drawn_without_an_order_of_all():
    """different places, and each as often as another."""
    import numpy as np

    for length, n in ((32, 11), (64, 12), (255, 16), (255, 32), (5, 5)):
        places = archive._drawn(np.random.default_rng(6).integers(0, 1 << 32, (4000, n), np.uint32), length)
        assert all(len(set(row)) == n for row in places.tolist()) and places.min() == 0 and places.max() == length - 1
        often = np.bincount(places.reshape(-1), minlength=length) * length / places.size
        assert 0.5 < often.min() and often.max() < 1.5


def test_remainders_follow_changes():
    """what is left behind a change is told from the change alone, as coding the word again would tell."""
    import numpy as np

    random = np.random.default_rng(6)
    for n, k in ((32, 10), (64, 40), (255, 223), (255, 191)):
        words = random.integers(0, 256, (30, n), np.uint8)
        row, place = np.repeat(np.arange(0, 30, 2), 5), np.concatenate([random.choice(n, 5, replace=False) for _ in range(15)])
        change, other = random.integers(1, 256, 75, np.uint8), words.copy()
        other[row, place] ^= change
        left = rs._still(rs._remainder(words, n, k), row, place, change, n, k).view(np.uint8)[:, : n - k]
        assert (left == rs._remainder(other, n, k)).all()


def test_large_files_are_coded_once(spark):
    """blocks of large files pass one Python step and one shuffle; whole archives as a packer makes them."""
    import os

    from strongbox.operators import archives

    datas = {"a": b"", "b": b"x" * 70000, "c": os.urandom(2_000_001), "d": b"q" * (1 << 20), "e": b"abc" * 700000, "f": os.urandom(65536 * 20), "g": None}
    options = preset(1).with_(ecc=1, block_exp=16)
    packed = archives.pack(spark.createDataFrame(list(datas.items()), "file_id string, content binary"), options)
    assert packed._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    assert {r.file_id: bytes(r.archive) for r in packed.collect()} == {k: archive.pack(d or b"", options) for k, d in datas.items()}


def test_library_filter_codes_nothing_it_need_not(monkeypatch):
    """data without a call passes as it is, and the way back reads stored chunks; the filters' results stay what they were."""
    import lzma
    import random

    from strongbox.codecs import bcj

    real, coded, plain = lzma.compress, [], {"id": lzma.FILTER_LZMA2, "preset": 0}
    monkeypatch.setattr(lzma, "compress", lambda *a, **k: coded.append(1) or real(*a, **k))
    draw = random.Random(18)
    for kind, n in ((k, n) for k in (1, 3, 7) for n in (1, 4, 5, 16, 1000, 65536, 65537, 140000)):
        data = bytes(draw.choices([0xE8, 0xE9, 0, 0xFF, 0xF0, 0xF8, 0x10, 0x16], k=n))
        chain = [{"id": bcj._LIBRARY[kind]}, plain]
        assert bcj.apply(data, kind, True) == lzma.decompress(real(data, lzma.FORMAT_RAW, filters=chain), lzma.FORMAT_RAW, filters=[plain])
        coded.clear()
        assert bcj.apply(data, kind, False) == lzma.decompress(real(data, lzma.FORMAT_RAW, filters=[plain]), lzma.FORMAT_RAW, filters=chain)
        assert not coded
    text = "Text in ASCII und anderen Zeichen: é ß ж".encode() * 3000
    assert bcj.apply(text, 1, True) == text and not coded


def test_changes_are_coded_as_the_archives_were(spark):
    """an archive that grew by its own options is the archive packed at once; without them only the search differs."""
    from strongbox.operators import archives

    options = preset(1).with_(ecc=0, block_exp=16)
    long = [b"".join(bytes([k * n % 251, n % 7]) for n in range(40000 + k)) for k in (3, 5, 11)]
    parts, rest = [*TEXTS[:20], *long], [*TEXTS[20:40], *long]
    grown, whole = archive.append_many(archive.pack_many(parts, options), rest, options), archive.pack_many([a + b for a, b in zip(parts, rest, strict=True)], options)
    assert grown == whole
    changed = archive.replace_many(archive.pack_many(long, options), [1] * 3, [d[65536:][::-1] for d in long], options)
    assert changed == archive.pack_many([d[:65536] + d[65536:][::-1] for d in long], options)
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(archive.pack_many(parts, options), rest, strict=True))], "file_id long, archive binary, extra binary")
    assert {r.file_id: bytes(r.archive) for r in archives.append(rows, options=options).collect()} == dict(enumerate(whole))


def test_files_are_dealt_out_by_a_number(spark):
    """as many tasks as asked for, with one shuffle, which adaptive execution doesn't make few by their bytes."""
    from strongbox import queries

    files = queries.files_by_lang(spark, "/root/testdata/sf0.001")
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    assert files.rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism == 12


def test_functions_leave_no_memory_behind(counted):
    """a batch of a SQL function is coded a few MiB at a time, and given back behind it."""
    import pandas as pd

    from strongbox.functions import udfs

    trims, data = counted(udfs, "trim"), [b"x" * (1 << 20)] * 9
    found = udfs.block_cv(pd.Series(data), pd.Series([0] * 9), pd.Series([True] * 9))
    assert len(trims) == 1 and set(found) == set(blake.block_values([(data[0], 0, True)]))


def test_pages_are_coded_by_all_cores(spark):
    """the sink has as many tasks as asked for, however few files and row groups the table has."""
    from strongbox import queries

    sc = spark.sparkContext
    sc.setJobGroup("F17", "pages")
    try:
        rows = queries.source_roundtrip(spark, "/root/testdata/sf0.001")
    finally:
        sc._jsc.clearJobGroup()
    told = sc.statusTracker()
    stages = [told.getStageInfo(s) for job in told.getJobIdsForGroup("F17") for s in told.getJobInfo(job).stageIds]
    assert max(s.numTasks for s in stages) == 3 * sc.defaultParallelism == 12
    assert rows.count() == 50


def test_small_archives_are_read_at_once(tmp_path, monkeypatch, counted):
    """one read for each, closed again, and so many together that their blocks are hashed side by side."""
    options, datas = preset(1).with_(ecc=1, block_exp=16), {str(k): bytes([k % 251, k // 251]) * (k % 400) for k in range(900)} | {"long": bytes(range(251)) * 900}
    for name, packed in zip(datas, archive.pack_many(list(datas.values()), options, True), strict=True):
        (tmp_path / f"{name}.sba").write_bytes(packed)
    open_, reads = source._reading, []

    def counting(store, run, held):
        before, read = len(held._exit_callbacks), open_(store, run, held)
        reads.append(len(held._exit_callbacks) - before)
        return read

    monkeypatch.setattr(source, "_reading", counting)
    steps, sums = counted(blake, "compress"), counted(rs, "decode")
    reader = source.ArchiveReader({"path": str(tmp_path)}, "data")
    rows = [row for runs in reader.partitions() for row in reader.read(runs)]
    found = {}
    for path, _, status, _, data in rows:
        assert status == "ok"
        name = path.rpartition("/")[2][:-4]
        found[name] = found.get(name, b"") + data
    assert found == {n: d for n, d in datas.items() if d}
    assert len(reads) == 901 and sum(reads) == 1  # the long one alone stays open
    assert len(steps) < 60 and len(sums) < 20


def test_stretches_go_by_what_trailers_tell():
    """blocks of small archives are taken together up to the bytes they hold; a trailer that tells too little is not believed."""
    small = archive.directories(archive.pack_many([bytes([k % 251]) * 3000 for k in range(1000)], OPTIONS, True))
    todo = [(k, e, d.options) for k, d in enumerate(small) for e in d.entries]
    cuts = [len(some) for some in archive.stretches(todo, small)]
    assert sum(cuts) == 1000 and max(cuts) > 200
    for d in small:
        d.trailer = archive.records.Record(True, False, 0, d.trailer.value, 0)
    assert max(len(some) for some in archive.stretches(todo, small)) <= max(cuts) * 2
    whole = archive.directories([archive.pack(bytes(65536 * 200), OPTIONS, True)])
    assert max(len(some) for some in archive.stretches([(0, e, OPTIONS) for e in whole[0].entries], whole)) == 64


def test_commit_makes_folders_once_and_tells_names_only(tmp_path, monkeypatch):
    """a task's message has no paths; a folder is made once, not for every archive; what was refused is refused."""
    import pickle

    made, real = [], source._store

    class Store:
        def __init__(self, store):
            self.store = store

        def create_dir(self, path, recursive):
            made.append(path)
            self.store.create_dir(path, recursive=recursive)

        def __getattr__(self, name):
            return getattr(self.store, name)

    monkeypatch.setattr(source, "_store", lambda path: (Store(real(path)[0]), real(path)[1]))
    options = {"path": str(tmp_path / "to"), "ecc": "1", "preset": "1", "blockExponent": "16"}
    rows = [{"name": f"{'ab'[k % 2]}/{k}", "content": t} for k, t in enumerate(TEXTS)]
    writer = source.ArchiveWriter(options)
    messages = [writer.write(rows[:50]), writer.write(rows[50:]), None]
    assert len(pickle.dumps(messages[0])) < 50 * 20 and str(tmp_path) not in str(messages)
    made.clear()
    writer.commit(messages)
    assert len(made) == 2
    assert (tmp_path / "to/b/7.sba").read_bytes() == archive.pack(TEXTS[7], preset(1).with_(ecc=1, block_exp=16))
    assert sorted(p.name for p in (tmp_path / "to").iterdir()) == ["a", "b"]
    again = source.ArchiveWriter(options)
    with pytest.raises(ValueError, match="1 archives are there already, as .*/to/b/7.sba"):
        again.commit([again.write([rows[7], {"name": "7", "content": b""}])])
    twice = source.ArchiveWriter(options)
    with pytest.raises(ValueError, match="1 names are given more than once"):
        twice.commit([twice.write([{"name": "n", "content": b""}]), twice.write([{"name": "n", "content": b""}])])
    assert len(list(tmp_path.rglob("*.sba"))) == 100
