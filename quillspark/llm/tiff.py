"""Media columns: TIFF images in a binary column, one row per page.

The reader walks the chain of image directories of either byte order, decodes
uncompressed, PackBits, LZW and deflate strips or tiles, undoes the horizontal
predictor and yields the samples of each page. The writer stores bytes losslessly as
8-bit samples of pages ``WIDTH`` wide, in strips or tiles under any of these codecs.

What a directory claims is checked before anything is allocated: fields must lie inside
the file, the segments of a page must be as many as its size asks for, and a page
must not unpack to more than ``MOST_PAGE`` bytes (a parameter) nor to more than the most that
its codec can make of the segments' bytes.

Defined results: a null medium has no page; a medium that cannot be read gives one row
whose ``page`` is null and whose ``error`` says why (pages before the fault come
first); a directory that is listed twice ends the walk; extra columns, whatever their
names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, tidy

WIDTH = 64
MOST_PAGE = 1 << 30
PAGE_ROWS = 16_384
STRIP_ROWS = 1_024
# Fixed values of the TIFF 6.0 format: compression codes, field type sizes.
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
# The most bytes that a byte of each codec can stand for.
MOST_RATIO = {NONE: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040}


class TiffError(ValueError):
    pass


# ------------------------------------------------------------------ codecs


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more equal bytes as runs, the rest as literals."""
    out, b = bytearray(), np.frombuffer(data, np.uint8)
    if not len(b):
        return b""
    starts = np.concatenate(([0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)])).tolist()
    literal = 0

    def flush(end: int) -> None:
        for at in range(literal, end, 128):
            part = data[at : min(at + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for start, end in zip(starts, starts[1:]):
        if end - start < 3:
            continue
        flush(start)
        while end - start >= 2:
            n = min(128, end - start)
            out += bytes((257 - n, data[start]))
            start += n
        literal = start
    flush(len(data))
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at, end = bytearray(), 0, len(data)
    while len(out) < size and at < end:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128 and at < end:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widened one code early. A string
    is the code of its beginning and one byte more; all codes are packed at once."""
    codes, widths = [256], [9]
    longer: dict[int, int] = {}
    following, width, code = 258, 9, -1
    for byte in data:
        if code < 0:
            code = byte
            continue
        key = code << 8 | byte
        if (known := longer.get(key)) is not None:
            code = known
            continue
        codes.append(code)
        widths.append(width)
        longer[key] = following
        following += 1
        code = byte
        if following == 4095:
            codes.append(256)
            widths.append(width)
            longer, following, width = {}, 258, 9
        elif following in (512, 1024, 2048):
            width += 1
    if code >= 0:
        codes.append(code)
        widths.append(width)
        following += 1
        if following in (512, 1024, 2048):
            width += 1
    codes.append(257)
    widths.append(width)
    c, w = np.array(codes, np.uint16)[:, None], np.array(widths, np.int8)[:, None]
    place = np.arange(12, dtype=np.int8)
    return np.packbits((c >> np.maximum(w - 1 - place, 0).astype(np.uint16) & 1).astype(np.uint8)[place < w]).tobytes()


# Widths of the codes that follow a clear code, and where each begins.
_WIDTHS = 9 + sum((np.arange(4096) >= first).astype(np.int64) for first in (254, 766, 1790))
_BEGINS = np.concatenate(([0], np.cumsum(_WIDTHS)))


def _lzw_codes(data: bytes):
    """Runs of codes, each up to and with a clear or end code; all of a run are cut out of the
    bits at once."""
    bits, at, number = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64), 0, 0
    while at + 9 <= 8 * len(data):
        width = _WIDTHS[number:] if number < 4096 else np.full(4096, 12)
        begin = at + (_BEGINS[number:-1] - _BEGINS[number] if number < 4096 else 12 * np.arange(4096))
        whole = begin + width <= 8 * len(data)
        begin, width = begin[whole], width[whole]
        if not len(begin):
            return
        byte = begin >> 3
        codes = (bits[byte] << 16 | bits[byte + 1] << 8 | bits[byte + 2]) >> (24 - (begin & 7) - width) & ((1 << width) - 1)
        marks = np.flatnonzero((codes == 256) | (codes == 257))
        end = int(marks[0]) + 1 if len(marks) else len(codes)
        yield codes[:end].tolist()
        at = int(begin[end - 1] + width[end - 1])
        number = 0 if len(marks) else number + end


def lzw_decode(data: bytes, size: int) -> bytes:
    single = [bytes((i,)) for i in range(256)] + [b"", b""]
    words, out, made, before = list(single), [], 0, None
    for codes in _lzw_codes(data):
        for code in codes:
            if code == 257:
                return b"".join(out)
            if code == 256:
                words, before = list(single), None
                continue
            if before is None:
                if code > 255:
                    raise TiffError("LZW code before its entry")
                word = words[code]
            else:
                if code < len(words):
                    word = words[code]
                elif code == len(words):
                    word = before + before[:1]
                else:
                    raise TiffError("LZW code before its entry")
                words.append(before + word[:1])
            out.append(word)
            made += len(word)
            before = word
            if made >= size:
                return b"".join(out)
    return b"".join(out)


def decode_segment(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        out = data
    elif compression == PACKBITS:
        out = unpack_bits(data, size)
    elif compression == LZW:
        out = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from e
    else:
        raise TiffError(f"compression {compression}")
    if len(out) < size:
        raise TiffError(f"a segment has {len(out)} of {size} bytes")
    return out[:size]


def encode_segment(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, PACKBITS: pack_bits, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 6)}[compression](data)


# ------------------------------------------------------------------ writing


def write_tiff(payload: bytes, compression: int = DEFLATE, predictor: int = 1, tile: int = 0, order: str = "<", page_rows: int = PAGE_ROWS, strip_rows: int = STRIP_ROWS) -> bytes:
    """payload: a positive multiple of WIDTH bytes. tile: side of square tiles, a
    multiple of 16, or 0 for strips. Each page_rows rows make a page."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("the payload must be a positive multiple of the width")
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4  # where the offset of the next directory goes
    for top in range(0, len(samples), page_rows):
        page = samples[top : top + page_rows]
        offsets, counts = [], []
        for rows, cols in boxes(len(page), WIDTH, tile or strip_rows, tile or WIDTH):
            part = page[rows : rows + (tile or strip_rows), cols : cols + (tile or WIDTH)]
            if tile:
                part = np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1])))
            if predictor == 2:
                part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
            data = encode_segment(np.ascontiguousarray(part).tobytes(), compression)
            offsets.append(len(out))
            counts.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        fields = [(256, 4, [WIDTH]), (257, 4, [len(page)]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1]), (277, 3, [1]), (317, 3, [predictor])]
        fields += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, offsets), (325, 4, counts)] if tile else [(273, 4, offsets), (278, 4, [min(strip_rows, len(page))]), (279, 4, counts)]
        entries = bytearray()
        for tag, kind, values in sorted(fields):
            raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                at = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack(order + "I", at)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def boxes(height: int, width: int, rows: int, cols: int) -> Iterator[tuple[int, int]]:
    return ((y, x) for y in range(0, height, rows) for x in range(0, width, cols))


# ------------------------------------------------------------------ reading


@dataclass
class Page:
    page: int
    width: int
    height: int
    channels: int
    bits: int
    compression: int
    predictor: int
    segments: int
    samples: bytes


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """(byte order, fields by tag) of each image directory in the chain."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise TiffError("no TIFF header")
    order, seen = "<" if data[:2] == b"II" else ">", set()
    try:
        (at,) = struct.unpack_from(order + "I", data, 4)
        while at and at not in seen:
            seen.add(at)
            (n,) = struct.unpack_from(order + "H", data, at)
            fields = {}
            for i in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
                size = TYPE_BYTES.get(kind, 0) * count
                where = at + 10 + 12 * i
                if size > 4:
                    (where,) = struct.unpack_from(order + "I", data, where)
                if count == 0 or where + size > len(data):
                    raise TiffError(f"directory: tag {tag} has {count} values at {where} of {len(data)} bytes")
                if kind in (1, 3, 4):
                    fields[tag] = struct.unpack_from(f"{order}{count}{'_BxHI'[kind]}", data, where)
            yield order, fields
            (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    except struct.error as e:
        raise TiffError(f"directory: {e}") from e


def read_pages(data: bytes, most_page: int = MOST_PAGE) -> Iterator[Page]:
    for number, (order, fields) in enumerate(directories(data)):
        one = lambda tag, default=None: fields.get(tag, (default,))[0]
        width, height, channels, bits = one(256), one(257), one(277, 1), one(258, 1)
        compression, predictor = one(259, 1), one(317, 1)
        if not width or not height or not channels or bits not in (8, 16, 32) or len(set(fields.get(258, (8,)))) > 1:
            raise TiffError(f"page {number}: {width} x {height} x {channels} of {bits} bits")
        if predictor not in (1, 2) or (one(284, 1) != 1 and channels > 1):
            raise TiffError(f"page {number}: predictor {predictor}, planes {one(284, 1)}")
        if compression not in MOST_RATIO:
            raise TiffError(f"page {number}: compression {compression}")
        tiled = 324 in fields
        rows, cols = (one(323), one(322)) if tiled else (min(one(278, height), height), width)
        offsets, counts = (fields.get(324), fields.get(325)) if tiled else (fields.get(273), fields.get(279))
        n = -(-height // rows) * -(-width // cols) if rows and cols else 0
        if not n or not offsets or not counts or len(offsets) < n or len(counts) < n:
            raise TiffError(f"page {number}: too few segments")
        kind = np.dtype(f"{order}u{bits // 8}")
        pixel = channels * kind.itemsize
        page_bytes, padded = height * width * pixel, n * rows * cols * pixel if tiled else height * width * pixel
        if max(page_bytes, padded) > most_page or page_bytes > MOST_RATIO[compression] * sum(counts[:n]):
            raise TiffError(f"page {number}: {page_bytes} bytes from {sum(counts[:n])} under compression {compression}")
        image = np.empty((height, width, channels), kind.newbyteorder("="))
        for (y, x), offset, count in zip(boxes(height, width, rows, cols), offsets, counts):
            if offset + count > len(data):
                raise TiffError(f"page {number}: a segment at {offset} of {count} bytes in {len(data)}")
            high = rows if tiled else min(rows, height - y)
            raw = decode_segment(data[offset : offset + count], compression, high * cols * pixel)
            part = np.frombuffer(raw, kind).reshape(high, cols, channels).astype(image.dtype)
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=image.dtype)
            image[y : y + high, x : x + cols] = part[: height - y, : width - x]
        yield Page(number, width, height, channels, bits, compression, predictor, n, image.tobytes())


PAGES = "page int, width int, height int, channels int, bits int, compression int, predictor int, segments int, samples binary, error string"


def tiff_pages(df: DataFrame, id_col: str, media_col: str, most_page: int = MOST_PAGE) -> DataFrame:
    """One row per page of every medium: the id (as ``id``) and PAGES. A medium's pages
    follow each other, in the order of the media."""
    rows = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(media_col)).alias("media"))
    kind = rows.schema["id"].dataType
    names = ["id", *(x.split()[0] for x in PAGES.split(", "))]
    types = [None, *[pa.int32()] * 8, pa.binary(), pa.string()]

    def run(batches):
        for batch in batches:
            for key, media in zip(batch.column(0), batch.column(1).to_pylist()):
                if media is None:
                    continue
                found = read_pages(media, most_page)
                while True:
                    try:
                        p = next(found, None)
                        row = None if p is None else (p.page, p.width, p.height, p.channels, p.bits, p.compression, p.predictor, p.segments, p.samples, None)
                    except TiffError as e:
                        row = (*[None] * 9, str(e))
                    if row is None:
                        break
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], batch.column(0).type), *(pa.array([v], t) for v, t in zip(row, types[1:]))], names=names)
                    if row[-1]:
                        break

    return rows.mapInArrow(tidy(run), f"id {kind.simpleString()}, {PAGES}")


def payload_of(text: bytes) -> bytes:
    """The text and bytes 0 up to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % WIDTH if text else WIDTH)


def by_text(text: bytes) -> dict:
    """How to write a text's medium: codec, predictor, byte order, strips or tiles and the
    size of pages, by a checksum of the text, so every way is taken and equal texts agree."""
    draw = zlib.crc32(text)
    draw ^= draw >> 15
    return {
        "compression": (DEFLATE, LZW, PACKBITS, NONE)[draw & 3],
        "predictor": 1 + (draw >> 2 & 1),
        "tile": (0, 0, 16, 32)[draw >> 3 & 3],
        "order": "<>"[draw >> 5 & 1],
        "page_rows": (PAGE_ROWS, 256, 48)[(draw >> 6) % 3],
        "strip_rows": (STRIP_ROWS, 100)[draw >> 9 & 1],
    }


def tiff_column(df: DataFrame, id_col: str, text_col: str, how=None, **same) -> DataFrame:
    """Whole texts as media: the id (as ``id``), n_bytes, media. ``how`` tells from a text how
    its medium is written (see :func:`by_text`); else all are written in the same way."""
    rows = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for at in range(0, len(texts), 100):
                part = texts[at : at + 100]
                media = [write_tiff(payload_of(t), **(how(t) if how else same)) for t in part]
                yield pa.RecordBatch.from_arrays([ids[at : at + 100], pa.array(map(len, part), pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    return rows.mapInArrow(tidy(run), f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary")


def features(pages: list[Page], payload: bytes) -> str:
    """Pages, rows, segments, distinct bytes, mean byte and mean step along a row (in
    thousandths, rounded down), the counts of the eight 32-wide bands of bytes, and the codec
    and predictor of the first page."""
    image = np.frombuffer(payload, np.uint8)
    counts = np.bincount(image, minlength=256)
    step = np.abs(np.diff(image.reshape(-1, WIDTH).astype(np.int16), axis=1)).sum(dtype=np.int64)
    n = len(image)
    bands = "/".join(map(str, counts.reshape(8, 32).sum(axis=1)))
    mean = int((counts * np.arange(256)).sum())
    return f"pages={len(pages)};rows={n // WIDTH};segments={sum(p.segments for p in pages)};distinct={int((counts > 0).sum())};mean={mean * 1000 // n};step={int(step) * 1000 // (n // WIDTH * (WIDTH - 1))};bands={bands};codec={pages[0].compression};predictor={pages[0].predictor}"


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how=None, **same) -> DataFrame:
    """Store each text as a TIFF, read its pages back, one row per page, and digest what was
    read. Writer, reader and digest follow each other in one task, so a medium's pages come
    together and nothing is shuffled; a medium that cannot be read ends the task."""
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    media = tiff_column(docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text")), "doc_id", "text", how, **same)
    # every row is its own medium, whatever its id
    known = F.struct(F.monotonically_increasing_id().alias("row"), F.col("id").alias("doc_id"), "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    pages = tiff_pages(media.select(known.alias("known"), "media"), "known", "media")

    def run(batches):
        import itertools

        def rows():
            for batch in batches:
                columns = [batch.column(i) for i in range(batch.num_columns)]
                for i in range(batch.num_rows):
                    yield tuple(c[i].as_py() for c in columns)

        def digests():
            for _, group in itertools.groupby(rows(), lambda r: r[0]["row"]):
                group = list(group)
                known, error = group[0][0], group[-1][-1]
                if error:
                    raise TiffError(error)
                found = [Page(*r[1:-1]) for r in group]
                payload = b"".join(p.samples for p in found)
                yield (known["doc_id"], known["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), known["media_bytes"], known["media_sha256"], features(found, payload))

        kinds = [pa.string() if "sha" in n or n == "feature" else pa.int64() for n in names]
        each = digests()
        while part := list(itertools.islice(each, 500)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds)], names=names)

    return pages.mapInArrow(tidy(run), DIGESTS)
