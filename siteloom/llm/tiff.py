"""TIFF media columns: every image directory of a file becomes a page; uncompressed, PackBits, LZW and deflate strips and
tiles are decoded, and horizontal and floating-point predictors undone.

Also a writer of 8-bit pages with which texts are stored losslessly, in all of these compressions, in strips and tiles, with and without
predictor (a text's checksum says which of FORMS it gets, so equal texts have equal files), and features of the bytes read back.

Nulls: a null file has no pages. Whatever is wrong with a page gives a row with the reason in error and leaves the file's other
pages; broken directories give one row with page null. A file's tags can't claim more pixels than its compressed bytes can hold. A null text
counts as empty and is stored as one row of spaces. Very long texts become several pages. Repeated rows and rows that share a doc_id each get
their rows. Extra columns, whatever their names, are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Tags of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT, FILL_ORDER = 284, 317, 322, 323, 324, 325, 339, 266
#: Compressions.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Bytes and struct letters of the field types.
FIELDS = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 13: (4, "I")}
#: A stored payload's rows are 64 RGB pixels.
ROW, UNIT = 64, 192
PAGE_ROWS, STRIP_ROWS = 4096, 512


class Broken(ValueError):
    """A file that is not a readable TIFF."""


# ---------------------------------------------------------------- decompression


def unpackbits(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:
        k = data[i]
        i += 1
        if k < 128:
            out += data[i : i + k + 1]
            i += k + 1
        elif k > 128:
            out += data[i : i + 1] * (257 - k)
            i += 1
    return bytes(out)


#: Codes that LZW reads at once.
_CODES = 4096


def _widths(k: np.ndarray) -> np.ndarray:
    """Bits of the k-th code after a clear code: one more as soon as the table, of 258 entries at first, grows to 511, 1023, 2047."""
    return 9 + np.searchsorted([512, 1024, 2048], k + 258, "right")


def unlzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; widths change one code early."""
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    out, at, k, bits, made = [], 0, 0, 8 * len(data), 0
    table, last = list(first), None
    while made < size:
        width = _widths(np.arange(k, k + _CODES))
        begin = at + np.cumsum(width) - width
        n = int(np.searchsorted(begin + width, bits, "right"))
        if not n:
            break
        byte = begin[:n] >> 3
        codes = (raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]) >> (24 - (begin[:n] & 7) - width[:n]) & ((1 << width[:n]) - 1)
        done = n
        for i, code in enumerate(codes.tolist()):
            if code == 256:
                table, last, k, done = list(first), None, 0, i + 1
                break
            if code == 257 or made >= size:
                return b"".join(out)[:size]
            if code > len(table) or (last is None and code >= len(table)):
                raise Broken("LZW code out of range")
            word = table[code] if code < len(table) else last + last[:1]
            if last is not None and len(table) < 4096:
                table.append(last + word[:1])
            out.append(word)
            made += len(word)
            last = word
        else:
            k += n
        at = int(begin[done - 1] + width[done - 1])
    return b"".join(out)[:size]


def inflate(data: bytes, size: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, size)
    except zlib.error as e:
        raise Broken(str(e)) from None


#: The most bytes that a compressed byte can become.
MOST = {NONE: 1, PACKBITS: 64, LZW: 2731, DEFLATE: 1032, OLD_DEFLATE: 1032}
DECODERS = {NONE: lambda data, size: data[:size], PACKBITS: unpackbits, LZW: unlzw, DEFLATE: inflate, OLD_DEFLATE: inflate}


# ---------------------------------------------------------------- directories and pages


@dataclass
class Page:
    page: int
    width: int
    height: int
    samples: int
    bits: int
    pixels: bytes  # rows from the top, samples interleaved, whole bytes per row; 16 bits and more are little-endian


def directories(data: bytes):
    """(byte order, {tag: values}) of every image directory in the chain."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise Broken("not a TIFF")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    try:
        while at:
            if at in seen:
                raise Broken("directories form a loop")
            seen.add(at)
            tags = {}
            (n,) = struct.unpack_from(order + "H", data, at)
            for k in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
                if kind not in FIELDS:
                    continue
                size, letter = FIELDS[kind]
                place = at + 10 + 12 * k
                if size * count > 4:
                    (place,) = struct.unpack_from(order + "I", data, place)
                tags[tag] = struct.unpack_from(f"{order}{count}{letter}", data, place)
            yield order, tags
            (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    except struct.error as e:
        raise Broken(f"directory ends early: {e}") from None


def _unpredicted(raw: bytes, order: str, predictor: int, width: int, rows: int, samples: int, bits: int) -> np.ndarray:
    """Rows of bytes, samples in little-endian order."""
    row = (width * samples * bits + 7) // 8
    if len(raw) < row * rows:
        raise Broken("a strip or tile ends early")
    flat = np.frombuffer(raw, np.uint8, row * rows).reshape(rows, row)
    size = bits // 8
    if predictor == 3:
        if bits not in (16, 32, 64):
            raise Broken("floating-point predictor on other samples")
        sums = np.cumsum(flat.reshape(rows, -1, samples), 1, dtype=np.uint8).reshape(rows, size, width * samples)
        return np.ascontiguousarray(sums[:, ::-1].transpose(0, 2, 1)).reshape(rows, row)
    if bits in (16, 32, 64):
        values = np.ascontiguousarray(flat).view(f"{order}u{size}").astype(f"<u{size}")
        if predictor == 2:
            values = np.cumsum(values.reshape(rows, width, samples), 1, dtype=values.dtype).reshape(rows, -1)
        return np.ascontiguousarray(values).view(np.uint8).reshape(rows, row)
    if predictor == 2:
        if bits != 8:
            raise Broken("horizontal predictor on samples of no whole byte")
        return np.cumsum(flat.reshape(rows, width, samples), 1, dtype=np.uint8).reshape(rows, row)
    if predictor != 1:
        raise Broken(f"predictor {predictor}")
    return flat


def _page(data: bytes, order: str, tags: dict, k: int) -> Page:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, samples, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
    if not width or not height:
        raise Broken("no size")
    if len(set(tags.get(BITS, (bits,)))) > 1:
        raise Broken("samples of different sizes")
    if one(FILL_ORDER, 1) != 1:
        raise Broken("reversed bits")
    decode = DECODERS.get(one(COMPRESSION, 1))
    if decode is None:
        raise Broken(f"compression {one(COMPRESSION)}")
    planes = samples if one(PLANAR, 1) == 2 and samples else 1
    each = (samples or 0) // planes
    tiled = TILE_OFFSETS in tags
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, sizes = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, ()), tags.get(TILE_BYTES if tiled else STRIP_BYTES, ())
    if not w or not h or w < 0 or h < 0:
        raise Broken("strips or tiles of no size")
    if not samples or samples < 0 or not 0 < bits <= 64:
        raise Broken("samples of no size")
    across, down = -(-width // w), -(-height // h)
    if len(offsets) < across * down * planes or len(sizes) < len(offsets):
        raise Broken("strips or tiles are missing")
    if tiled and across > 1 and w * each * bits % 8:
        raise Broken("tiles of no whole bytes")
    row = (width * each * bits + 7) // 8
    if row * height * planes > MOST[one(COMPRESSION, 1)] * (sum(min(n, len(data)) for n in sizes) + 64):
        raise Broken("fewer bytes than pixels need")
    out = []
    for p in range(planes):
        plane = np.zeros((height, row), np.uint8)
        for i in range(across * down):
            y, x = divmod(i, across)
            rows = h if tiled else min(h, height - y * h)
            at, n = offsets[p * across * down + i], sizes[p * across * down + i]
            raw = decode(data[at : at + n], (w * each * bits + 7) // 8 * rows)
            part = _unpredicted(raw, order, one(PREDICTOR, 1), w, rows, each, bits)
            left = x * w * each * bits // 8
            part = part[: height - y * h, : row - left]
            plane[y * h : y * h + part.shape[0], left : left + part.shape[1]] = part
        out.append(plane)
    if planes > 1:
        if bits % 8:
            raise Broken("separate planes of no whole bytes")
        out = [np.stack([p.reshape(height, width, bits // 8) for p in out], 2)]
    return Page(k, width, height, samples, bits, out[0].tobytes())


def pages(data: bytes):
    """All pages of a file, one after the other."""
    for k, (order, tags) in enumerate(directories(data)):
        yield _page(data, order, tags, k)


def decoded(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per page: (doc_id, page, width, height, samples, bits, pixels, error); a file with broken directories gives a single error row."""

    def run(batches):
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
        names = ["doc_id", "page", "width", "height", "samples", "bits", "pixels", "error"]
        for batch in batches:
            for doc, media in zip(batch.column("doc_id").to_pylist(), batch.column("media")):
                data, rows = media.as_py(), []
                if data is None:
                    continue
                try:
                    for k, (order, tags) in enumerate(directories(data)):
                        try:
                            p = _page(data, order, tags, k)
                            rows.append((doc, p.page, p.width, p.height, p.samples, p.bits, p.pixels, None))
                        except Exception as e:  # whatever a page's tags can cause
                            rows.append((doc, k, *[None] * 5, str(e) or type(e).__name__))
                except Exception as e:  # of the directories
                    rows = [(doc, *[None] * 6, str(e) or type(e).__name__)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    own = files.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{media_col}` as media")
    return own.mapInArrow(common.tidied(run), "doc_id long, page int, width int, height int, samples int, bits int, pixels binary, error string")


# ---------------------------------------------------------------- texts as media


def packbits(data: bytes) -> bytes:
    """Runs of three bytes and more, and what lies between, 128 at a time."""
    out, at = bytearray(), 0

    def plain(a: int, b: int):
        for i in range(a, b, 128):
            part = data[i : min(i + 128, b)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in _RUN.finditer(data):
        plain(at, m.start())
        out.append(257 - len(m[0]))
        out.extend(m[1])
        at = m.end()
    plain(at, len(data))
    return bytes(out)


def lzw(data: bytes) -> bytes:
    codes, table, n = [256], {}, 258
    last = data[0] if data else None
    for c in data[1:]:
        key = last << 8 | c
        code = table.get(key)
        if code is not None:
            last = code
            continue
        codes.append(last)
        table[key] = n
        n += 1
        if n == 4095:
            codes.append(256)
            table, n = {}, 258
        last = c
    codes = np.array([*codes, *([last] if data else []), 257])
    clear = np.flatnonzero(codes == 256)
    since = np.arange(len(codes)) - np.repeat(clear, np.diff(np.r_[clear, len(codes)])) - 1
    width = _widths(np.r_[0, since[:-1] + 1])  # a clear code is as wide as what it follows asks for
    out = np.zeros((len(codes), 12), np.uint8)
    for k in range(12):
        out[:, 11 - k] = codes >> k & 1
    return np.packbits(out[np.arange(12) >= (12 - width)[:, None]]).tobytes()


_RUN = re.compile(rb"(.)\1{2,127}", re.S)
_PACK = {NONE: bytes, PACKBITS: packbits, LZW: lzw, DEFLATE: lambda data: zlib.compress(data, 1)}
#: Forms of stored texts: compression, predictor, whether in tiles of TILE x TILE pixels.
FORMS = ((NONE, 1, False), (PACKBITS, 1, False), (LZW, 1, False), (DEFLATE, 1, False), (DEFLATE, 2, False), (PACKBITS, 1, True), (LZW, 2, True), (DEFLATE, 2, True))
TILE = 32


def encoded(payload: bytes, form: int | None = None) -> bytes:
    """8-bit RGB pages of 64 pixels a row; the payload is a multiple of 192 bytes, and its checksum chooses among FORMS."""
    compression, predictor, tiled = FORMS[zlib.crc32(payload) % len(FORMS) if form is None else form]
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for a in range(0, len(payload), UNIT * PAGE_ROWS):
        page = np.frombuffer(payload, np.uint8, min(UNIT * PAGE_ROWS, len(payload) - a), a).reshape(-1, ROW, 3)
        if tiled:
            full = np.zeros((-(-len(page) // TILE) * TILE, ROW, 3), np.uint8)
            full[: len(page)] = page
            blocks = [full[y : y + TILE, x : x + TILE] for y in range(0, len(full), TILE) for x in range(0, ROW, TILE)]
        else:
            blocks = [page[y : y + STRIP_ROWS] for y in range(0, len(page), STRIP_ROWS)]
        if predictor == 2:
            blocks = [np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], 1) for b in blocks]
        packed, places = [_PACK[compression](b.tobytes()) for b in blocks], []
        for x in packed:
            places.append(len(out))
            out += x
        out += b"\0" * (len(out) % 2)
        n = len(packed)
        extra = len(out)
        out += struct.pack("<3H", 8, 8, 8) + b"\0\0" + struct.pack(f"<{n}I", *places) + struct.pack(f"<{n}I", *map(len, packed))
        offsets, sizes = (extra + 8, extra + 8 + 4 * n) if n > 1 else (places[0], len(packed[0]))
        struct.pack_into("<I", out, link, len(out))
        entries = [(WIDTH, 3, 1, ROW), (HEIGHT, 4, 1, len(page)), (BITS, 3, 3, extra), (COMPRESSION, 3, 1, compression), (PHOTOMETRIC, 3, 1, 2), (SAMPLES, 3, 1, 3), (PREDICTOR, 3, 1, predictor)]
        if tiled:
            entries += [(TILE_WIDTH, 3, 1, TILE), (TILE_HEIGHT, 3, 1, TILE), (TILE_OFFSETS, 4, n, offsets), (TILE_BYTES, 4, n, sizes)]
        else:
            entries += [(STRIP_OFFSETS, 4, n, offsets), (ROWS_PER_STRIP, 4, 1, STRIP_ROWS), (STRIP_BYTES, 4, n, sizes)]
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in sorted(entries))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def stored_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a TIFF file."""

    def run(batches):
        for batch in common.slices(batches):
            raw = common.texts(batch)
            media = [encoded(t + b" " * (-len(t) % UNIT or (0 if t else UNIT))) for t in raw]
            yield pa.RecordBatch.from_arrays([common.ids(batch), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return common.id_text(docs).mapInArrow(common.tidied(run), "doc_id long, n_bytes long, media binary")


def feature(payload: bytes, n_pages: int) -> str:
    """Pages, mean, deviation, a histogram of 16 parts in thousandths, and which of 64 equal bands are lighter than the mean."""
    values = np.frombuffer(payload, np.uint8)
    parts = np.bincount(values >> 4, minlength=16) * 1000 // len(values)
    bands = values.reshape(64, -1).sum(1, dtype=np.int64)  # 192 is a multiple of 64
    lighter = np.packbits(bands * 64 > bands.sum()).tobytes().hex()
    return f"{n_pages}p {values.mean():.3f} {values.std():.3f} {'.'.join(map(str, parts.tolist()))} {lighter}"


def features(media: DataFrame) -> DataFrame:
    """Reads the stored bytes back, page by page, and digests them."""

    def run(batches):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in common.slices(batches, text="media"):
            rows = []
            for doc, n, data in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist()):
                parts = [p.pixels for p in pages(data)]
                payload = b"".join(parts)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload, len(parts))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return media.mapInArrow(common.tidied(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark, sf_dir: str) -> DataFrame:
    return features(stored_texts(common.documents(spark, sf_dir)))
