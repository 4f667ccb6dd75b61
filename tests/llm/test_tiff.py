import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from quillspark.llm import tiff


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("layout", [{}, {"tile": 16}, {"tile": 48, "predictor": 2}, {"predictor": 2, "strip_rows": 7}, {"order": ">", "page_rows": 20}])
def test_round_trip(compression, layout):
    rng = random.Random(compression)
    for size in (64, 64 * 50, 64 * 333):
        payload = bytes(rng.choice([b"aaaa", b"ab", b"\0" * 9, bytes([rng.randrange(256)])][rng.randrange(4)]) for _ in range(size))
        pages = list(tiff.read_pages(tiff.write_tiff(payload, compression, **layout)))
        assert b"".join(p.samples for p in pages) == payload
        assert len(pages) == -(-size // 64 // layout.get("page_rows", tiff.PAGE_ROWS))


def test_lzw_over_all_widths_and_clears():
    data = np.random.default_rng(0).integers(0, 256, 30_000).astype(np.uint8).tobytes()
    for part in (b"", b"a", data, b"ab" * 9000, data[:300] * 40):
        assert tiff.lzw_decode(tiff.lzw_encode(part), len(part)) == part


def test_known_forms():
    # the example of the format's own description of PackBits
    packed = bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])
    plain = bytes([0xAA] * 3 + [0x80, 0x00, 0x2A] + [0xAA] * 4 + [0x80, 0x00, 0x2A, 0x22] + [0xAA] * 10)
    assert tiff.unpack_bits(packed, 24) == plain and tiff.unpack_bits(tiff.pack_bits(plain), 24) == plain
    # and of LZW: 7 7 7 8 8 7 7 6 6 as the codes 256 7 258 8 8 258 6 6 257
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(raw, 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == raw


def test_sixteen_bits_and_channels():
    """A big-endian page of three channels of 16 bits with a predictor."""
    image = np.random.default_rng(1).integers(0, 65536, (5, 4, 3)).astype(np.uint16)
    steps = np.concatenate([image[:, :1], image[:, 1:] - image[:, :-1]], axis=1).astype(">u2").tobytes()
    data = zlib.compress(steps)
    out = bytearray(b"MM\0*\0\0\0\0") + data
    out += b"\0" * (len(out) % 2)
    bits = len(out)
    out += struct.pack(">HHH", 16, 16, 16)
    struct.pack_into(">I", out, 4, len(out))
    fields = [(256, 3, 1, 4 << 16), (257, 3, 1, 5 << 16), (258, 3, 3, bits), (259, 3, 1, 8 << 16), (273, 4, 1, 8), (277, 3, 1, 3 << 16), (278, 3, 1, 5 << 16), (279, 4, 1, len(data)), (317, 3, 1, 2 << 16)]
    out += struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHII", *f) for f in fields) + b"\0\0\0\0"
    (page,) = tiff.read_pages(bytes(out))
    assert (page.channels, page.bits, page.predictor) == (3, 16, 2)
    assert np.array_equal(np.frombuffer(page.samples, np.uint16).reshape(5, 4, 3), image)


def test_pages_of_a_column(spark):
    good = tiff.write_tiff(b"x" * 64 * 5, tiff.LZW, page_rows=2)
    looped = bytearray(good)
    first = struct.unpack_from("<I", looped, 4)[0]
    n = struct.unpack_from("<H", looped, first)[0]
    struct.pack_into("<I", looped, first + 2 + 12 * n, first)
    rows = [(1, good), (2, None), (3, b"junk"), (4, good[:60]), (5, bytes(looped)), (6, b"")]
    df = spark.createDataFrame([(i, bytearray(m) if m is not None else None, "clash") for i, m in rows], "doc long, media binary, page string")
    got = tiff.tiff_pages(df, "doc", "media").collect()
    of = lambda i: [r for r in got if r.id == i]
    assert [(r.page, r.height) for r in of(1)] == [(0, 2), (1, 2), (2, 1)] and not of(2)
    assert len(of(5)) == 1 and of(5)[0].error is None
    for i in (3, 4, 6):
        assert of(i)[-1].page is None and of(i)[-1].error


def test_digests(spark):
    texts = ["", None, "a" * 64, "é" * 100, "word " * 400_000, "a" * 64]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media_bytes int").repartition(3)
    got = {r.doc_id: r for r in tiff.media_digests(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (got[i].n_bytes, got[i].payload_bytes) == (len(raw), len(payload))
        assert got[i].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[i].tail_crc32 == zlib.crc32(payload[-64:])
    assert got[2][1:] == got[5][1:] and got[0][1:] == got[1][1:]
    assert got[4].feature.startswith("pages=2;rows=31250;")
    media = {r.id: bytes(r.media) for r in tiff.tiff_column(df, "doc_id", "text").collect()}
    assert all(hashlib.sha256(media[i]).hexdigest() == got[i].media_sha256 and len(media[i]) == got[i].media_bytes for i in media)
    assert tiff.media_digests(df.limit(0)).count() == 0


def directory(*fields, tail=b""):
    out = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(fields))
    return out + b"".join(struct.pack("<HHII", *f) for f in fields) + b"\0\0\0\0" + tail


def test_hostile_directories(spark):
    """Claims that no file can hold give an error row, before anything is allocated."""
    sound = [(256, 4, 1, 64), (257, 4, 1, 4), (258, 3, 1, 8), (259, 3, 1, 8), (273, 4, 1, 8), (278, 4, 1, 4), (279, 4, 1, 20)]
    put = lambda **other: [(t, k, *other.get(f"t{t}", (n, v))) for t, k, n, v in sound]
    media = [
        directory(*put(t257=(0, 0))), directory(*put(t256=(1, 1 << 20), t257=(1, 1 << 20), t278=(1, 1 << 20))), directory(*put(t273=(1 << 30, 8))), directory(*put(t279=(1, 1 << 31))),
        directory(*put(t256=(1, 0))), directory(*put(t278=(1, 0))), directory(*put(t259=(1, 7))), directory(*put(t257=(1, 1 << 30))), directory((322, 4, 1, 1 << 16), (323, 4, 1, 1 << 16), (324, 4, 1, 8), (325, 4, 1, 90), *put()),
        directory((277, 3, 1, 0), *put()), b"II*\0\x08\0\0\0\xff\xff", b"", b"MM\0*\0\0\0\x08",
    ]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(media)], "id long, media binary")
    got = tiff.tiff_pages(df, "id", "media").collect()
    assert sorted(r.id for r in got) == list(range(len(media))) and all(r.page is None and r.error for r in got)


def test_query_takes_every_codec_and_layout(spark):
    rows = [(i, f"text {i} " * (i % 900)) for i in range(300)] + [(None, None), (7, ""), (7, ""), (8, "é" * 200_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "`doc.id` long, text string, media string, id int")
    got = tiff.media_digests(df, "doc.id", how=tiff.by_text).collect()
    assert len(got) == len(rows)
    expected = sorted((-1 if i is None else i, len((t or "").encode()), hashlib.sha256(tiff.payload_of((t or "").encode())).hexdigest()) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.payload_sha256) for r in got) == expected
    ways = {tuple(tiff.by_text((t or "").encode()).values()) for _, t in rows}
    assert {w[0] for w in ways} == {tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS} and {w[1] for w in ways} == {1, 2} and {w[2] for w in ways} == {0, 16, 32}
    assert max(int(r.feature.split(";")[0][6:]) for r in got) > 3
    for r in got:
        text = next((t or "").encode() for i, t in rows if i == r.doc_id and len((t or "").encode()) == r.n_bytes)
        media = tiff.write_tiff(tiff.payload_of(text), **tiff.by_text(text))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.tail_crc32 == zlib.crc32(tiff.payload_of(text)[-64:])
