"""The codecs against published vectors, liblzma, and themselves."""

import lzma
import random

import numpy as np
import pytest

from strongbox import dims
from strongbox.codecs import archive, bcj, blake, gf, lz, records, rs
from strongbox.codecs.lz_slow import decompress_slow
from strongbox.dims import Options, preset

EMPTY = "fedcba980100003e5d10140ed92e0b7e18866b3b1ad3127d3d32d6ce6dd6de3e8000000000000000af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f32625cf0fa99d34e6851905c5dde0df7976421e6ba1fef77f31c"
ONE_ZERO = (
    "fedcba980100011f5d1e4821f8b455f1dd66671d1cd18158eef29407d790272240000000000000052d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1"
    "510225d0f592e21319916b9a59885a7d2ae4244c100b255e2451ff5682d77c10200000000080000000000000012d3adedff11b61f14c886e35afa036736dcd87"
    "a74d27b5c1510225d0f592e2138f3db9e4bb5add135383b284084730db5626e62299458c1e"
)


def test_golden_archives():
    assert archive.pack(b"", Options(block_exp=62, dict_exp=16)).hex() == EMPTY
    assert archive.pack(b"\0", Options(prefilter=1, block_exp=31, dict_exp=30)).hex() == ONE_ZERO
    assert archive.unpack(bytes.fromhex(EMPTY)) == (b"", "ok", 0)
    assert archive.unpack(bytes.fromhex(ONE_ZERO)) == (b"\0", "ok", 0)


@pytest.mark.parametrize("fill,kib,root", [
    (0x42, 32, "848eb396076028fdfe1133c3078e4541817f76461d27163adbfc82a55363aee1"),
    (0x43, 128, "2abdf8fb89c3df201cc4c4d33bdf58a094126177f5820ac9f9b40000468d2d09"),
    (0x44, 192, "0b6310de56f0483e8175e9b4d30e14123e526959b56b55ba3d803d46a0a7f72e"),
    (0x45, 256, "999251bdbb729527f92296cd57309ee8548f5bdeb85952f970e55e7573e49c91"),
    (0x46, 320, "6dc0f6e4fe1c61290891ff698bdb4fecd4b7138f7dba6587daf93a717e35f830"),
    (0x47, 512, "303af5f1fb59ac7b2f654d87544b6b7ffd40b1b269916bcfe310ac25977d5b5c"),
    (0x48, 1024, "544f851259a35e14f6db263bec303018931571071820a691207189ec537288e2"),
    (0x49, 200, "11d18712ed9237e3492805542aa2600d6ad339d14c3095ec136ce0c2c884473d"),
    (0x4A, 260, "e35d464de3144ea508a4944dbb89b3017d41efa76ff840dee6fa117be46e615a"),
    (0x4B, 128, "15741f4c1583214c8dc575bc7e2849c6d3728583f81f67c7524d4fdc5ec18f87"),
])
@pytest.mark.parametrize("exponent", [16, 26])
def test_root_hashes(fill, kib, root, exponent):
    data = bytes([fill]) * (kib << 10)
    unit = 1 << exponent
    parts = [data[k : k + unit] for k in range(0, len(data), unit)]
    values = blake.block_values([(p, k * unit, len(parts) == 1) for k, p in enumerate(parts)])
    assert blake.root_of(values).hex() == root


@pytest.mark.parametrize("leaves", [1, 2, 3, 5, 10, 64])
def test_tree_is_the_hash_of_all(leaves):
    data = random.Random(leaves).randbytes(1024 * leaves - (512 if leaves == 3 else 0))
    parts = [data[k : k + 1024] for k in range(0, len(data), 1024)]
    values = blake.block_values([(p, k * 1024, leaves == 1) for k, p in enumerate(parts)])
    assert blake.root_of(values) == blake.block_values([(data, 0, True)])[0]


def test_field():
    assert len(set(gf.EXP[:255].tolist())) == 255 and int(gf.EXP[:255].astype(int).sum()) == 32640
    assert all(gf.MUL[a, gf.inverse(a)] == 1 for a in range(1, 256))


@pytest.mark.parametrize("code,n,k", dims.RS_CODES)
def test_reed_solomon(code, n, k):
    assert not rs.encode(np.zeros((1, k), np.uint8), n, k).any()
    if n == 255:  # the code of all ones holds 255 of them
        assert (rs.encode(np.full((1, k), 255, np.uint8), n, k) == 255).all()
    rng, t = random.Random(k), (n - k) // 2
    for errors in [0, 1, t, t + 1] + [rng.randrange(1, t) for _ in range(5)]:
        data = np.frombuffer(rng.randbytes(k), np.uint8)[None]
        word = np.hstack([data, rs.encode(data, n, k)])
        assert not rs.syndromes(word, n, k).any()
        bad = word.copy()
        for p in rng.sample(range(n), errors):
            bad[0, p] ^= rng.randrange(1, 256)
        fixed, changed = rs.decode(bad, n, k)
        if errors <= t:
            assert (fixed == word).all() and changed[0] == errors
        else:
            assert changed[0] == -1 and (fixed == bad).all()


# fixed values: the first parity bytes of the data 0, 1, 2 ... and of all ones
@pytest.mark.parametrize("n,k,counting,ones", [
    (255, 239, "07ffcc5e9bfb1c0838aee03603b502aa", "ff" * 16),
    (255, 223, "93cca4cfe7c914d65c083eb57a634cd5a86f77edf97b87cf4c05be2478e175d4", "ff" * 32),
    (255, 191, "792316db851127a71e19d44e5fe58400bffdc5be5a73b3b90f1b660ea25f08bfced98819758eabc2586966bee7b5abec7387eea89e0377f623340cf0", "ff" * 64),
    (64, 40, "bb68ae9f872c2d5eb1c486a104d5d0d0e77140d3", "579a5af18d3b67e5bfec98bb598dc2b4a5a7714d"),
    (32, 10, "2e15b80a2d182f2a0e46a888cf8803394a8b5cdba41d", "6b947c9013410983bf927cd5eafba958214e0fee90ef"),
])
def test_published_parity(n, k, counting, ones):
    for data, want in ((np.arange(k), counting), (np.full(k, 255), ones)):
        assert rs.encode(data.astype(np.uint8)[None], n, k).tobytes().hex().startswith(want)


def test_payload_padding():
    assert len(rs.protect(b"x" * 29, (239, 16))) == 255 and len(rs.protect(b"x" * 300, (239, 16))) == 510
    assert rs.unprotect(rs.protect(b"x" * 300, (239, 16)), (239, 16))[0][:300] == b"x" * 300


DATA = {
    "empty": b"", "zero": b"\0", "text": b"hello world " * 30_000, "random": random.Random(5).randbytes(200_000),
    "mixed": random.Random(6).randbytes(70_000) + b"a" * 100_000 + random.Random(7).randbytes(70_000),
}


@pytest.mark.parametrize("name", DATA)
@pytest.mark.parametrize("level", [0, 3, 4, 9, 12])
def test_chunks(name, level):
    data, o = DATA[name], preset(level)
    payload = lz.compress(data, o)
    assert lz.decompress(payload + b"\0" * 77, o) == data == lz.decompress(lz.store(data), o)
    assert sum(c[1] for c in lz.chunks(payload)) == len(data)


@pytest.mark.parametrize("lc,lp,pb", [(3, 0, 2), (0, 2, 0), (4, 0, 4), (1, 3, 1)])
def test_decoder_in_python(lc, lp, pb):
    data = (DATA["mixed"][60_000:90_000] + DATA["text"][:5000]) * 2
    for level in (0, 6):
        o = preset(level).with_(lc=lc, lp=lp, pb=pb)
        payload = lz.compress(data, o)
        assert decompress_slow(payload, o) == data
        with pytest.raises(lz.FormatError):
            decompress_slow(payload[:-20] + bytes(19) + b"\0", o)
    o = preset(1).with_(lc=8, lp=4)
    assert lz.decompress(lz.compress(data, o), o) == data and archive.unpack(archive.pack(data, o))[1] == "ok"


def test_chunk_headers():
    assert lz.compress(b"\0", preset(6)).hex() == "2000000000"
    assert lz.raw_header(65536).hex() == "8000" and lz.raw_header(65535).hex() == "c001" and lz.raw_header(65536 + 8191).hex() == "9fff"
    assert lz.coded_header(100, 65281).hex() == "600063ff" and lz.coded_header(100, 65280).hex() == "400063feff"
    # the near-size form of a coded chunk: same bytes, another header
    payload = lz.compress(DATA["text"], preset(1))
    (kind, size, stored, at), *_ = lz.chunks(payload)
    assert kind == "coded" and list(lz.chunks(b"\x60\0\0\xff" + b"\0" * 65281 + b"\0")) == [("coded", 1, 65281, 4)]
    for bad in (b"", b"\x01\0", b"\x20\0\x05ab", b"\x40\0\0\0\x09" + b"\1" * 10 + b"\0"):
        with pytest.raises(lz.FormatError):
            list(lz.chunks(bad))


def branches(kind: int, n: int = 40_003) -> bytes:
    rng = random.Random(kind)
    d = bytearray(rng.randbytes(n))
    for q in range(0, n - 24, 24):
        if kind == 1:
            d[q], d[q + 4] = 0xE8, 0
        elif kind == 2:
            d[q + 3] = 0xEB
        elif kind == 3:
            d[q + 1], d[q + 3] = 0xF0 | d[q + 1] & 7, 0xF8 | d[q + 3] & 7
        elif kind == 4 and q % 48:
            d[q + 3] = 0x94 | d[q + 3] & 3
        elif kind == 4:
            d[q + 3], d[q + 2] = 0x90 | d[q + 3] & 0x60, d[q + 2] & 0x0F
        elif kind == 5:
            d[q], d[q + 1] = (0x40, d[q + 1] & 0x3F) if q % 48 else (0x7F, d[q + 1] | 0xC0)
        elif kind == 6:
            d[q], d[q + 3] = 0x48 | d[q] & 3, d[q + 3] & 0xFC | 1
        elif kind == 8 and q % 48:
            d[q], d[q + 1] = 0xEF, d[q + 1] & 0xF2
        elif kind == 8:
            rd = rng.choice([0, 1, 2, 5, 6, 7, 10, 31])
            d[q : q + 4] = (0x17 | rd << 7 | rng.randrange(1 << 20) << 12).to_bytes(4, "little")
            d[q + 4 : q + 8] = (rng.randrange(1 << 12) << 20 | rd << 15 | rng.randrange(32) << 7 | 0x67).to_bytes(4, "little")
    return bytes(d)


@pytest.mark.parametrize("kind", range(1, 9))
def test_prefilters(kind):
    data = branches(kind)
    coded = bcj.apply(data, kind, True)
    assert coded != data and bcj.apply(coded, kind, False) == data
    library = {2: lzma.FILTER_ARM, 5: lzma.FILTER_SPARC, 6: lzma.FILTER_POWERPC}.get(kind)
    if library:
        assert coded == bcj._by_library(data, library, True)
    for short in (b"", b"a", data[:7]):
        assert bcj.apply(bcj.apply(short, kind, True), kind, False) == short


@pytest.mark.parametrize("ecc", range(4))
@pytest.mark.parametrize("prefilter", [0, 1, 4, 8])
@pytest.mark.parametrize("size", [0, 1, 65536, 65537, 150_000])
def test_archives(ecc, prefilter, size):
    rng = random.Random(size)
    data = (b"some text " * (size // 10 + 1))[: size // 2] + rng.randbytes(size - size // 2)
    o = preset(3).with_(ecc=ecc, prefilter=prefilter, block_exp=16)
    packed = archive.pack(data, o)
    assert archive.unpack(packed) == (data, "ok", 0)
    damaged, n = archive.damage(packed, 5)
    if ecc:
        assert archive.unpack(damaged) == (data, "ok", n)
        assert archive.repair(damaged) == (packed, n, 0)
    longer = archive.append(packed, data[:1000] + b"more")
    assert archive.unpack(longer) == (data + data[:1000] + b"more", "ok", 0)
    assert archive.directory(longer).trailer.value == archive.directory(archive.pack(data + data[:1000] + b"more", o)).trailer.value


def test_damage_is_told():
    data = random.Random(1).randbytes(200_000)
    packed = archive.pack(data, preset(1).with_(ecc=1, block_exp=16))
    assert archive.unpack(packed[:-64])[1] == "truncated"
    assert archive.unpack(packed + b"x")[1] == "trailing_bytes"
    assert archive.unpack(b"nothing at all, but long enough for a header")[1] == "header_uncorrectable"
    assert archive.unpack(archive.damage(packed, 1, more=1)[0])[1] == "header_uncorrectable"
    d = archive.directory(packed)
    at = d.entries[1].at + 64
    spoiled = packed[:at] + bytes(40) + packed[at + 40 :]
    content, status, _ = archive.unpack(spoiled)
    assert status in ("payload_uncorrectable", "hash") and content[:65536] == data[:65536]
    swapped = records.block_header(d.entries[0].record.size, False, bytes(32))
    assert archive.unpack(packed[:32] + swapped + packed[96:])[1] == "hash"


def test_trailer_repair():
    t = bytearray(records.trailer(1234, bytes(range(32))))
    t[10] ^= 1
    assert records.parse_record(bytes(t)).size == 1234 and records.parse_record(bytes(t)).corrected == 1
    t[:20] = b"\xff" * 20
    assert records.parse_record(bytes(t)) is None


def test_options():
    assert preset(3).dict_exp == 22 and preset(99) == preset(9)
    o = Options().with_(lc=99, lp=-1, block_exp=1, dict_exp=99)
    assert (o.lc, o.lp, o.block_exp, o.dict_exp) == (8, 0, 16, 31)
    assert dims.auto_depth(preset(4)) == 24 and dims.auto_depth(Options(fast=True, nice=64)) == 20


def test_precedence():
    from strongbox.plans.options import block_exponent, resolve

    assert resolve(3).block_exp == 22 and resolve(3, size=300 << 20).block_exp == 23 and resolve(9, size=1 << 40).block_exp == 29
    assert resolve(6, block_exp=0).block_exp == 62 and resolve(6, block_exp=20, block_count=3, size=10**9).block_exp == 20
    assert resolve(6, size=10**9, block_count=4).block_exp == 28 and resolve(6, size=10**9, block_count=0).block_exp == 62
    assert resolve(6, dict_exp=99, lc=9).dict_exp == 31 and resolve().ecc == 1 and resolve(2, prefilter=4).prefilter == 4
    assert [block_exponent(s, c) for s, c in ((1, 1), (65537, 1), (1 << 20, 16), ((1 << 20) + 1, 16), (5, 0))] == [16, 17, 16, 17, None]


def test_replace_block():
    data = random.Random(9).randbytes(150_000)
    o = preset(1).with_(ecc=1, block_exp=16)
    packed = archive.pack(data, o)
    other = bytes(65536)
    changed = archive.replace_block(packed, 1, other)
    assert archive.unpack(changed) == (data[:65536] + other + data[131072:], "ok", 0)
    assert archive.unpack(archive.replace_block(changed, 2, b"end")) == (data[:65536] + other + b"end", "ok", 0)
    for index, part in ((0, b"short"), (3, b"x"), (2, bytes(65537)), (2, b"")):
        with pytest.raises(ValueError):
            archive.replace_block(packed, index, part)


@pytest.mark.parametrize("n,k", [(255, 239), (255, 223), (255, 191), (32, 10), (64, 40)])
def test_many_codewords_at_once(n, k):
    """As many errors as can be corrected, or fewer, or one more, in a table of codewords."""
    rng = np.random.default_rng(n + k)
    data = rng.integers(0, 256, (300, k)).astype(np.uint8)
    words, most = np.hstack([data, rs.encode(data, n, k)]), (n - k) // 2
    errors = rng.integers(0, most + 2, len(words))
    bad = words.copy()
    for row, e in enumerate(errors.tolist()):
        bad[row, rng.choice(n, e, replace=False)] ^= rng.integers(1, 256, e).astype(np.uint8)
    fixed, changed = rs.decode(bad, n, k)
    sound = errors <= most
    assert (fixed[sound] == words[sound]).all() and (changed[sound] == errors[sound]).all()
    assert not rs.dirty(fixed[changed >= 0], n, k).any() and (fixed[changed < 0] == bad[changed < 0]).all()
    assert (changed[~sound] < 0).mean() > 0.9 and len(rs.decode(bad[:0], n, k)[0]) == 0


def test_archive_in_pieces():
    rng = np.random.default_rng(2)
    o = preset(1).with_(ecc=1, block_exp=16)
    for size in (0, 1, 65_535, 65_536, 65_537, 131_072, 200_000):
        data = rng.integers(0, 60, size).astype(np.uint8).tobytes()
        for step in (1000, 70_000, 10**6):
            p = archive.Packer(o)
            parts = [x for at in range(0, size, step) for x in p.feed(data[at : at + step])]
            assert b"".join([*parts, *p.end()]) == archive.pack(data, o)


def test_block_writer():
    o = Options(block_exp=16, dict_exp=16)
    b = archive.BlockWriter(o, 2)
    assert b.empty and not b.full and b.write(b"x" * 70_000) == 65_536 and b.full and b.write(b"") == 0
    with pytest.raises(ValueError, match="block is full"):
        b.write(b"y")
    stored, cv = b.finish()
    assert records.parse_record(stored[:64]).value == cv == blake.block_values([(b"x" * 65_536, 2 << 16, False)])[0]


def test_records_as_they_are():
    packed = archive.pack(b"z" * 100_000, preset(1).with_(ecc=1, block_exp=16))
    assert [e.record for e in archive.directories([packed], False)[0].entries] == [e.record for e in archive.directory(packed).entries]
    at = archive.directory(packed).entries[1].at + 20
    wrong = packed[:at] + bytes([packed[at] ^ 1]) + packed[at + 1 :]
    plain, fixed = archive.directories([wrong], False)[0], archive.directory(wrong)
    assert fixed.corrected == 1 and plain.corrected == 0 and plain.entries[1].record.value != fixed.entries[1].record.value


def test_arguments():
    from strongbox.plans.options import one_prefilter, output_of

    assert one_prefilter([]) == 0 and one_prefilter(["arm64"]) == 4 and output_of(["a"], "b") == "b" and output_of(["a", "b"], None) is None
    with pytest.raises(ValueError, match="one prefilter"):
        one_prefilter(["x86", "arm"])
    with pytest.raises(ValueError, match="2 inputs"):
        output_of(["a", "b"], "c")
