"""The data source, its sink and streams, and the stateful encoder and decoder."""

import random

import pytest
from pyspark.sql import functions as F

from strongbox.codecs import archive
from strongbox.dims import preset
from strongbox.sources.archive import register
from strongbox.streaming import decode, encode

OPTIONS = preset(1).with_(ecc=1, block_exp=16)


def data_of(n, seed):
    rng = random.Random(seed)
    return (b"some words and more %d " % seed) * (n // 40) + rng.randbytes(n // 2)


def test_write_then_read(spark, tmp_path):
    register(spark)
    rows = [("a", data_of(200_000, 1)), ("b", b""), ("sub/c", data_of(10, 2))]
    target = str(tmp_path / "out")
    frame = spark.createDataFrame(rows, "name string, content binary")
    frame.write.format("strongbox").option("path", target).option("preset", 1).option("blockExponent", 16).mode("append").save()
    meta = {r.path.rpartition("out/")[2]: r for r in spark.read.format("strongbox").option("mode", "meta").load(target).collect()}
    assert {k: (r.status, r.size) for k, r in meta.items()} == {"a.sba": ("ok", len(rows[0][1])), "b.sba": ("ok", 0), "sub/c.sba": ("ok", len(rows[2][1]))}
    blocks = spark.read.format("strongbox").option("runBytes", 1000).load(target)
    found = blocks.where(F.col("path").endswith("/a.sba")).orderBy("block_idx").collect()
    assert b"".join(bytes(r.data) for r in found) == rows[0][1] and {r.status for r in found} == {"ok"}
    only = blocks.where("block_idx >= 1 AND block_idx < 2").collect()
    assert [(r.block_idx, bytes(r.data)) for r in only] == [(1, rows[0][1][1 << 16 : 2 << 16])]


def test_stream_reads_each_archive_once(spark, tmp_path):
    register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.sba").write_bytes(archive.pack(b"first", OPTIONS))
    stream = spark.readStream.format("strongbox").load(str(folder))
    query = stream.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    (folder / "2.sba").write_bytes(archive.pack(b"second", OPTIONS))
    query.processAllAvailable()
    query.stop()
    assert sorted(bytes(r.data) for r in spark.table("arrived").collect()) == [b"first", b"second"]


def write(spark, rows, target, mode="append", **options):
    frame = spark.createDataFrame(rows, "name string, content binary").coalesce(1)
    frame.write.format("strongbox").options(preset=1, blockExponent=16, **options).option("path", target).mode(mode).save()


def read(spark, path, **options):
    return spark.read.format("strongbox").options(**options).load(path)


def test_overwrite_names_and_pieces(spark, tmp_path):
    register(spark)
    target = str(tmp_path / "out")
    write(spark, [("a", b"one"), ("b", b"two")], target)
    with pytest.raises(Exception, match="there already"):
        write(spark, [("b", b"three"), ("c", b"four")], target)
    for rows, said in (([("d", b"1"), ("d", b"2")], "more than once"), ([(None, b"1")], "no name"), ([("../e", b"1")], "no name")):
        with pytest.raises(Exception, match=said):
            write(spark, rows, target)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.sba", "b.sba"]  # nothing half done, no folder left
    write(spark, [("c", b"four")], target, "overwrite")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["c.sba"]
    data = data_of(300_000, 8)
    write(spark, [("p", data[:100_000]), ("p", data[100_000:100_001]), ("p", data[100_001:]), ("q", b""), ("r", None)], target, pieces="true")
    assert (tmp_path / "out" / "p.sba").read_bytes() == archive.pack(data, OPTIONS)
    meta = {r.path.rpartition("/")[2]: (r.status, r.size) for r in read(spark, target, mode="meta").collect()}
    assert meta == {"c.sba": ("ok", 4), "p.sba": ("ok", len(data)), "q.sba": ("ok", 0), "r.sba": ("ok", 0)}


def test_globs(spark, tmp_path):
    register(spark)
    for name in ("x1.sba", "x2.bin", "y1.sba", "sub/x3.sba", "sub/deep/x4.sba"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(archive.pack(name.encode(), OPTIONS))
    found = lambda path: sorted(bytes(r.data).decode() for r in read(spark, path).collect())
    assert found(str(tmp_path)) == ["sub/deep/x4.sba", "sub/x3.sba", "x1.sba", "y1.sba"]
    assert found(f"{tmp_path}/x*") == ["x1.sba", "x2.bin"] and found(f"file://{tmp_path}/**/x[34].sba") == ["sub/deep/x4.sba", "sub/x3.sba"]
    assert found(f"{tmp_path}/*/x?.sba") == ["sub/x3.sba"] and found(f"{tmp_path}/y1.sba") == ["y1.sba"] and found(f"{tmp_path}/none*") == []


def test_broken_archives_are_told(spark, tmp_path):
    from strongbox.codecs import records

    register(spark)
    data = data_of(300_000, 9)
    whole = archive.pack(data, OPTIONS)
    d = archive.directory(whole)
    second, third = d.entries[1].at, d.entries[2].at
    magic = records._with_parity(b"\0\0\0\0" + whole[4:10], 32)
    files = {
        "ok": whole, "magic": magic + whole[32:], "record_uncorrectable": whole[:second] + bytes(range(64)) + whole[second + 64 :], "truncated": whole[:-30],
        "root": whole[:-64] + records.trailer(len(data), bytes(32)), "size": whole[:-64] + records.trailer(len(data) + 1, d.trailer.value),
        "header_uncorrectable": bytes(range(1, 33)) + whole[32:], "missing": whole[:second] + whole[third:], "trailing_bytes": whole + b"more", "empty": b"",
    }
    for name, content in files.items():
        (tmp_path / f"{name}.sba").write_bytes(content)
    for size in (1000, 1 << 25):
        rows = read(spark, str(tmp_path), runBytes=size).collect()
        told = {r.path.rpartition("/")[2][:-4]: r.status for r in rows if r.block_idx is None}
        good = {n: sum(r.status == "ok" and r.block_idx is not None for r in rows if r.path.endswith(f"/{n}.sba")) for n in files}
        n = len(d.entries)
        assert told == {k: "root" if k == "missing" else "truncated" if k == "empty" else k for k in files if k != "ok"}
        assert good == {"ok": n, "magic": 0, "record_uncorrectable": 1, "truncated": n, "root": n, "size": n, "header_uncorrectable": 0, "missing": 1, "trailing_bytes": n, "empty": 0}
    assert b"".join(bytes(r.data) for r in read(spark, f"{tmp_path}/ok.sba", strict="true", runBytes=1000).orderBy("block_idx").collect()) == data
    for name in files.keys() - {"ok"}:
        with pytest.raises(Exception, match="sba"):
            read(spark, f"{tmp_path}/{name}.sba", strict="true").collect()
    assert [r.block_idx for r in read(spark, f"{tmp_path}/trailing_bytes.sba").where("block_idx = 1").collect()] == [1]


@pytest.mark.parametrize("log", [False, True])
def test_stream_goes_on_after_a_restart(spark, tmp_path, log):
    """Late names, changed files, several batches, a stop in between: each archive is read once."""
    register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    put = lambda name, data: (folder / f"{name}.sba").write_bytes(archive.pack(data, OPTIONS))
    options = {"maxFilesPerTrigger": "2"} | ({"logPath": str(tmp_path / "log")} if log else {})

    def run():
        stream = spark.readStream.format("strongbox").options(**options).load(str(folder))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
        return query

    for k in range(5):
        put(f"m{k}", b"first %d" % k)
    query = run()
    put("a0", b"late name")
    query.processAllAvailable()
    query.stop()
    put("b0", b"while stopped")
    put("m1", b"changed since")
    query = run()
    put("z", b"last")
    query.processAllAvailable()
    query.stop()
    found = sorted(bytes(r.data) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == sorted([b"first %d" % k for k in range(5)] + [b"late name", b"while stopped", b"changed since", b"last"])


def test_decoding_stream_of_many(spark, tmp_path):
    wanted = {f"s{k}": data_of(80_000 + 40_000 * k, k) for k in range(3)}
    schema, rows = "stream_id string, seq long, data binary", []
    for s, d in wanted.items():
        packed = archive.damage(archive.pack(d, OPTIONS), 3)[0]
        rows += [(s, i, packed[i * 9000 : (i + 1) * 9000]) for i in range(-(-len(packed) // 9000))]
    rows += [("cut", 0, archive.pack(b"cut short", OPTIONS)[:100]), ("bad", 0, bytes(range(100)))]
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).write.parquet(str(tmp_path / "in" / f"p{k}"))
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = decode.decode_stream(source).writeStream.format("memory").queryName("decoded").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    found = spark.table("decoded").orderBy("stream_id", "block_idx").collect()
    for s, d in wanted.items():
        own = [r for r in found if r.stream_id == s]
        assert b"".join(bytes(r.data) for r in own if r.kind == "block") == d and {r.status for r in own} == {"ok"} and own[-1].kind == "trailer"
    assert [(r.kind, r.status) for r in found if r.stream_id in ("bad", "cut")] == [("header", "header_uncorrectable"), ("header", "ok")]


@pytest.mark.parametrize("size", [0, 1, 65536, 65537, 131072, 200_000])
@pytest.mark.parametrize("step", [700, 65536, 100_000])
def test_encoder_state_is_independent_of_cuts(size, step):
    data = data_of(size * 2, 3)[:size]
    pieces = [data[k : k + step] for k in range(0, size, step)] or [b""]
    rows = [(k, p, k == len(pieces) - 1) for k, p in enumerate(pieces)]
    random.Random(1).shuffle(rows)
    state, out = (b"", 0, 0, b"", 0, [], False), []
    for k in range(0, len(rows), 3):
        state, more = encode.advance(state, sorted(rows[k : k + 3]), OPTIONS)
        out += more
    packed = b"".join(b for _, _, b in sorted(out))
    assert packed == archive.pack(data, OPTIONS) and state[-1]


@pytest.mark.parametrize("step", [33, 5000, 10**6])
def test_decoder_state(step):
    data = data_of(200_000, 4)
    packed = archive.pack(data, OPTIONS)
    damaged, n = archive.damage(packed, 2)
    state, out = decode.START, []
    for k in range(0, len(damaged), step):
        state, more = decode.advance(state, [(k // step, damaged[k : k + step])])
        out += more
    assert b"".join(d for _, kind, _, _, d in out if kind == "block") == data
    assert {s for _, _, s, _, _ in out} == {"ok"} and sum(c for _, _, _, c, _ in out) == n
    assert out[-1][1] == "trailer" and state[-1]


def test_streams_of_many(spark, tmp_path):
    schema = "stream_id string, seq long, data binary, eos boolean"
    wanted = {f"s{k}": data_of(90_000 + 1000 * k, k) for k in range(3)}
    rows = [(s, i, d[i * 20_000 : (i + 1) * 20_000], (i + 1) * 20_000 >= len(d)) for s, d in wanted.items() for i in range(-(-len(d) // 20_000))]
    for k in range(2):
        spark.createDataFrame(rows[k::2], schema).write.parquet(str(tmp_path / "in" / f"p{k}"))
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = encode.encode_stream(source, OPTIONS).writeStream.format("memory").queryName("segments").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    segments = spark.table("segments").orderBy("stream_id", "ord").collect()
    for s, d in wanted.items():
        packed = b"".join(bytes(r.bytes) for r in segments if r.stream_id == s)
        assert archive.unpack(packed) == (d, "ok", 0)
