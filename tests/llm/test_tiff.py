import hashlib
import struct
import zlib

import numpy as np
import pytest

from siteloom.llm import tiff

from .test_dedup import DATA, table


def lzw(data):
    """A plain encoder: most significant bit first, width changes one code early, clear at the start and when full."""
    codes, word, table_, out, width = [], b"", {bytes([i]): i for i in range(256)}, [], 9
    out.append((256, 9))
    n = 258
    for b in data:
        if word + bytes([b]) in table_:
            word += bytes([b])
            continue
        out.append((table_[word], width))
        table_[word + bytes([b])] = n
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        if n >= 4094:
            out.append((256, width))
            table_, n, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = bytes([b])
    if word:
        out.append((table_[word], width))
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    out.append((257, width))
    bits = "".join(f"{c:0{w}b}" for c, w in out)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def packbits(data):
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while i + run < len(data) and run < 128 and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes([257 - run, data[i]])
            i += run
        else:
            j = i
            while j < len(data) and j - i < 128 and not (j + 2 < len(data) and data[j] == data[j + 1] == data[j + 2]):
                j += 1
            out += bytes([j - i - 1]) + data[i:j]
            i = j
    return bytes(out) + b"\x80"


PACK = {tiff.NONE: bytes, tiff.PACKBITS: packbits, tiff.LZW: lzw, tiff.DEFLATE: zlib.compress}


def build(images, order="<", compression=tiff.DEFLATE, predictor=1, tile=None, rows=5, planar=1):
    """A file of pages; an image is an array (height, width, samples)."""
    out, link = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)), 4
    for im in images:
        h, w, s = im.shape
        size = im.dtype.itemsize
        parts = []
        for plane in [im] if planar == 1 else [im[:, :, k : k + 1] for k in range(s)]:
            if tile:
                blocks = []
                for y in range(0, h, tile):
                    for x in range(0, w, tile):
                        b = np.zeros((tile, tile, plane.shape[2]), im.dtype)
                        cut = plane[y : y + tile, x : x + tile]
                        b[: cut.shape[0], : cut.shape[1]] = cut
                        blocks.append(b)
            else:
                blocks = [plane[y : y + rows] for y in range(0, h, rows)]
            for b in blocks:
                if predictor == 2:
                    v = b.view(f"u{size}").copy()
                    v[:, 1:] -= b.view(f"u{size}")[:, :-1]
                    b = v
                if predictor == 3:
                    rows_, across, each = b.shape
                    v = b.view(f"u{size}").astype(f">u{size}").view(np.uint8).reshape(rows_, across * each, size).transpose(0, 2, 1).reshape(rows_, -1, each).copy()
                    v[:, 1:] -= v[:, :-1].copy()
                    raw = v.tobytes()
                else:
                    raw = b.astype(b.dtype.newbyteorder(order)).tobytes()
                parts.append(PACK[compression](raw))
        places = []
        for p in parts:
            places.append(len(out))
            out += p
        out += b"\0" * (len(out) % 2)
        tags = [(tiff.WIDTH, 3, [w]), (tiff.HEIGHT, 4, [h]), (tiff.BITS, 3, [8 * size] * s), (tiff.COMPRESSION, 3, [compression]), (tiff.SAMPLES, 3, [s]), (tiff.PLANAR, 3, [planar]), (tiff.PREDICTOR, 3, [predictor])]
        if tile:
            tags += [(tiff.TILE_WIDTH, 3, [tile]), (tiff.TILE_HEIGHT, 3, [tile]), (tiff.TILE_OFFSETS, 4, places), (tiff.TILE_BYTES, 4, list(map(len, parts)))]
        else:
            tags += [(tiff.STRIP_OFFSETS, 4, places), (tiff.ROWS_PER_STRIP, 4, [rows]), (tiff.STRIP_BYTES, 4, list(map(len, parts)))]
        entries = b""
        for tag, kind, values in sorted(tags):
            blob = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(blob) > 4:
                at = len(out)
                out += blob + b"\0" * (len(blob) % 2)
                blob = struct.pack(order + "I", at)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + blob.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@pytest.mark.parametrize("compression", list(PACK))
@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("shape,tile,planar", [((23, 17, 3), None, 1), ((23, 17, 1), 16, 1), ((40, 33, 3), 16, 2), ((9, 5, 4), None, 2)])
@pytest.mark.parametrize("kind,predictor", [("u1", 1), ("u1", 2), ("u2", 2), ("u4", 1), ("f4", 3)])
def test_every_form_round_trips(compression, order, shape, tile, planar, kind, predictor):
    rng = np.random.default_rng(1)
    images = [(rng.random(shape) * 100 // 9 if kind == "f4" else rng.integers(0, 12, shape)).astype(kind), np.arange(np.prod(shape)).reshape(shape).astype(kind)]
    got = list(tiff.pages(build(images, order, compression, predictor, tile, planar=planar)))
    assert [p.page for p in got] == [0, 1]
    for p, im in zip(got, images):
        assert (p.height, p.width, p.samples, p.bits) == (*im.shape, 8 * im.dtype.itemsize)
        assert p.pixels == im.astype(im.dtype.newbyteorder("<")).tobytes()


def test_long_lzw_crosses_all_widths():
    data = np.random.default_rng(3).integers(0, 256, 30000).astype(np.uint8).tobytes() + b"ab" * 9000
    assert tiff.unlzw(lzw(data), len(data)) == data


def test_bits_and_broken_files(spark):
    one = bytearray(build([np.array([[[0b10110000], [0b11000000]]], np.uint8)], compression=tiff.NONE))
    page = next(tiff.pages(bytes(one)))
    assert page.pixels == b"\xb0\xc0"
    good = build([np.ones((2, 2, 1), np.uint8)])
    loop = bytearray(good)
    loop[-4:] = loop[4:8]
    files = [(0, good), (1, b""), (2, b"II*\0"), (3, bytes(loop)), (4, good[:-20]), (5, None), (6, b"MM\0*\xff\xff\xff\xff"), (7, good.replace(b"x\x9c", b"zz"))]
    got = tiff.decoded(spark.createDataFrame([(i, m, "x") for i, m in files], "doc_id long, media binary, page string")).collect()
    assert {r.doc_id for r in got if r.error} == {1, 2, 3, 4, 6, 7} and [r.doc_id for r in got if not r.error] == [0]


def test_query_round_trip(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = tiff.query(spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        raw = docs[r.doc_id]
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_text_edge_cases(spark):
    texts = [None, "", "x" * 192, "ü" * 600_000, "x" * 192, "a\0b"]
    media = tiff.stored_texts(table(spark, texts))
    got = {r.doc_id: r for r in tiff.features(media).collect()}
    assert [got[i].payload_bytes for i in range(6)] == [192, 192, 192, 1_200_000, 192, 192]
    assert got[2].media_sha256 == got[4].media_sha256 and got[2].feature == got[4].feature
    assert tiff.decoded(media).where("doc_id = 3").count() == 2 == int(got[3].feature.split("p")[0])
    assert tiff.features(tiff.stored_texts(table(spark, []))).count() == 0


def test_a_broken_page_leaves_the_others(spark):
    data = bytearray(tiff.encoded(bytes(range(192)) * (2 * tiff.PAGE_ROWS + 5), 3))
    want = list(tiff.pages(bytes(data)))
    assert len(want) == 3
    at = struct.unpack_from("<I", data, 4)[0]
    at = struct.unpack_from("<I", data, at + 2 + 12 * struct.unpack_from("<H", data, at)[0])[0]
    entry = next(at + 2 + 12 * k for k in range(struct.unpack_from("<H", data, at)[0]) if struct.unpack_from("<H", data, at + 2 + 12 * k)[0] == tiff.COMPRESSION)
    struct.pack_into("<H", data, entry + 8, 7)  # JPEG
    got = tiff.decoded(spark.createDataFrame([(5, data)], "doc_id long, media binary")).collect()
    assert [(r.page, bytes(r.pixels) if r.pixels is not None else None, r.error) for r in got] == [(0, want[0].pixels, None), (1, None, "compression 7"), (2, want[2].pixels, None)]


@pytest.mark.parametrize("form", range(len(tiff.FORMS)))
def test_every_form_of_stored_texts(form):
    rng = np.random.default_rng(form)
    for raw in (b" " * 192, rng.integers(0, 256, 192 * 700).astype(np.uint8).tobytes(), b"ab  c" * 192 * 40, b"x" * 192 * (tiff.PAGE_ROWS + 33)):
        data = tiff.encoded(raw, form)
        compression, predictor, tiled = tiff.FORMS[form]
        for _, tags in tiff.directories(data):
            assert (tags[tiff.COMPRESSION], tags[tiff.PREDICTOR], tiff.TILE_WIDTH in tags) == ((compression,), (predictor,), tiled)
        assert b"".join(p.pixels for p in tiff.pages(data)) == raw


@pytest.mark.parametrize("n", [0, 1, 2, 253, 254, 255, 3835, 3836, 3837, 3838, 9000])
def test_lzw_at_the_edges_of_its_widths(n):
    data = np.random.default_rng(n).permutation(np.arange(n) % 251).astype(np.uint8).tobytes()
    assert tiff.unlzw(tiff.lzw(data), n) == data == tiff.unlzw(lzw(data), n)


def test_all_forms_occur_in_the_query(spark):
    media = tiff.stored_texts(spark.read.parquet(f"{DATA}/documents.parquet"))
    kinds = {(t[tiff.COMPRESSION][0], t[tiff.PREDICTOR][0], tiff.TILE_WIDTH in t) for r in media.collect() for _, t in tiff.directories(r.media)}
    assert kinds == set(tiff.FORMS)


def test_any_damage_gives_rows_and_no_failure(spark):
    good = [tiff.encoded(bytes(range(192)) * 40, f) for f in range(len(tiff.FORMS))]
    rng = np.random.default_rng(9)
    files = []
    for data in good:
        at = struct.unpack_from("<I", data, 4)[0]
        for k in range(struct.unpack_from("<H", data, at)[0]):
            for value in (0, 1, 0xFFFF, 0xFFFFFFFF):  # any tag's value; RowsPerStrip 0 and TileWidth 0 among them
                bad = bytearray(data)
                struct.pack_into("<I", bad, at + 2 + 12 * k + 8, value)
                files.append(bytes(bad))
        for _ in range(20):
            bad = bytearray(data)
            for i in rng.integers(0, len(bad), 5).tolist():
                bad[i] = int(rng.integers(0, 256))
            files.append(bytes(bad))
    got = tiff.decoded(spark.createDataFrame(list(enumerate(files)), "doc_id long, media binary")).collect()
    assert {r.doc_id for r in got} == set(range(len(files))) and any(r.error for r in got)
