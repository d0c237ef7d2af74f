"""Media columns: TIFF files in a binary column, one row per page.

Reading walks the chain of image directories, decodes strips or tiles (stored, PackBits, LZW or deflate), undoes the
horizontal predictor and returns each page's samples in row order. Both byte orders, 1-, 2-, 4-, 8- and 16-bit unsigned
samples and any number of samples a pixel, chunky or planar, are read; samples of under 8 bits become a byte each, with
the value that is stored. What is outside this (other widths, floating point, other compressions, the horizontal predictor
under 8 bits, reversed bit order, a header that claims more pixels than its strips could fill) raises ValueError, or gives a
row with an error. 16-bit samples come out little-endian, whatever the file's byte order.
Writing makes greyscale pages with the same compressions.

Defined cases: a null file has no pages; a page that can't be read gives a row with its number and the reason, and the next
one follows; where the chain of directories breaks, a row with page -1 and the reason is the file's last; equal rows each give their pages; an empty table gives none; files and texts of any length are
handled one at a time; key columns are kept, whatever their names, save those named like the results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import sliced, table

STORED, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 16: "Q"}
PAD, PAGE_ROWS = 576, 256
_BAD = (ValueError, KeyError, IndexError, struct.error, zlib.error, TypeError, ZeroDivisionError, OverflowError, MemoryError)
#: Bytes of pixels that a stored byte can stand for at most: LZW's longest entry, which is longer than deflate's and PackBits' runs.
MOST_FOR_A_BYTE = 4096


class Page(NamedTuple):
    width: int
    height: int
    bits: int
    samples: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes


class Form(NamedTuple):
    """How pages are stored: rows of a strip or tile, and a tile's width if there are tiles."""

    compression: int
    predictor: int = 1
    rows: int = 32
    tile: int | None = None


#: How documents are stored, whatever their size.
FORM = Form(DEFLATE, 2)


# Compressions


def packbits_encode(raw: bytes) -> bytes:
    x = np.frombuffer(raw, np.uint8)
    begins = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, len(x)))
    out, at = [], 0

    def literal(stop: int) -> None:
        for k in range(at, stop, 128):
            part = raw[k : min(k + 128, stop)]
            out.append(bytes([len(part) - 1]) + part)

    long = sizes >= 3
    for begin, n in zip(begins[long].tolist(), sizes[long].tolist()):
        literal(begin)
        for k in range(0, n, 128):
            m = min(128, n - k)
            out.append(bytes([257 - m if m > 1 else 0, raw[begin]]))
        at = begin + n
    literal(len(raw))
    return b"".join(out)


def packbits_decode(raw: bytes, size: int) -> bytes:
    out, at, made = [], 0, 0
    while made < size:
        n = raw[at]
        if n < 128:
            part = raw[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            part = raw[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            part, at = b"", at + 1
        out.append(part)
        made += len(part)
    return b"".join(out)[:size]


def lzw_encode(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first, the width growing one code early."""
    acc, held, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal acc, held
        acc, held = (acc << width) | code, held + width
        while held >= 8:
            held -= 8
            out.append((acc >> held) & 255)
        acc &= (1 << held) - 1

    codes = {bytes([k]): k for k in range(256)}
    put(256, 9)
    new, width, w = 258, 9, b""
    for k in range(len(raw)):
        c = raw[k : k + 1]
        if w + c in codes:
            w += c
            continue
        put(codes[w], width)
        codes[w + c] = new
        new += 1
        if new == 4095:
            put(256, 12)
            codes, new, width = {bytes([k]): k for k in range(256)}, 258, 9
        elif new in (512, 1024, 2048):
            width += 1
        w = c
    if w:
        put(codes[w], width)
        new += 1
        if new in (512, 1024, 2048):
            width += 1
    put(257, width)
    if held:
        out.append((acc << (8 - held)) & 255)
    return bytes(out)


def lzw_decode(raw: bytes, size: int) -> bytes:
    base = [bytes([k]) for k in range(256)] + [b"", b""]
    known, width, acc, held, old, out, made = list(base), 9, 0, 0, b"", [], 0
    for byte in raw:
        acc, held = (acc << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code = acc >> held
        acc &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            known, width, old = list(base), 9, b""
            continue
        if code < len(known):
            now = known[code]
        elif code == len(known) and old:
            now = old + old[:1]
        else:
            raise ValueError("LZW code out of order")
        if old:
            known.append(old + now[:1])
        width = {511: 10, 1023: 11, 2047: 12}.get(len(known), width)
        old = now
        out.append(now)
        made += len(now)
        if made >= size:
            break
    return b"".join(out)[:size]


def _unpack(raw: bytes, compression: int, size: int) -> bytes:
    if compression == STORED:
        got = raw[:size]
    elif compression in (DEFLATE, OLD_DEFLATE):
        got = zlib.decompressobj().decompress(raw, size)
    elif compression == PACKBITS:
        got = packbits_decode(raw, size)
    elif compression == LZW:
        got = lzw_decode(raw, size)
    else:
        raise ValueError(f"compression {compression} isn't known")
    if len(got) != size:
        raise ValueError(f"a strip or tile has {len(got)} of {size} bytes")
    return got


def _pack(raw: bytes, compression: int) -> bytes:
    return {STORED: lambda x: x, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: packbits_encode, LZW: lzw_encode}[compression](raw)


# Files


def _directories(raw: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("no TIFF file")
    (at,), seen = struct.unpack(order + "I", raw[4:8]), set()
    while at:
        if at in seen:
            raise ValueError("the image directories run in a circle")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", raw, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
            if code := _TYPES.get(kind):
                form = f"{order}{count}{code}"
                place = at + 10 + 12 * k
                if struct.calcsize(form) > 4:
                    (place,) = struct.unpack_from(order + "I", raw, place)
                tags[tag] = struct.unpack_from(form, raw, place)
        yield order, tags
        (at,) = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)


def read_tiff(raw: bytes) -> Iterator[Page]:
    for order, tags in _directories(raw):
        yield _page(raw, order, tags)


def _samples(part: bytes, rows: int, across: int, bits: int, kind: np.dtype) -> np.ndarray:
    """rows of so many samples each; rows of samples under 8 bits are filled up to a byte."""
    if bits >= 8:
        return np.frombuffer(part, kind).reshape(rows, across)
    single = np.unpackbits(np.frombuffer(part, np.uint8).reshape(rows, -1), axis=1)[:, : across * bits].reshape(rows, across, bits)
    return single @ (1 << np.arange(bits)[::-1]).astype(np.uint8)


def _page(raw: bytes, order: str, tags: dict[int, tuple]) -> Page:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, samples, compression, predictor = one(256), one(257), one(277, 1), one(259, 1), one(317, 1)
    widths, planes = set(tags.get(258, (1,))), samples if one(284, 1) == 2 else 1
    bits = widths.pop()
    if widths or bits not in (1, 2, 4, 8, 16) or one(339, 1) != 1 or predictor not in ((1, 2) if bits >= 8 else (1,)) or one(266, 1) != 1:
        raise ValueError("only unsigned samples of 1, 2, 4, 8 or 16 bits with no or, from 8 bits, the horizontal predictor are read")
    kind, inside = np.dtype(order + "u2" if bits == 16 else "u1"), samples // planes
    tiled = 322 in tags
    across, down = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
    places, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    if min(width, height, samples, across, down) < 1 or samples % planes:
        raise ValueError("an image without samples")
    parts = planes * -(-height // down) * -(-width // across)
    if len(places) != parts or len(sizes) != parts:
        raise ValueError("strips or tiles are missing")
    # before room is made for an image, what the file holds must be able to fill it
    if (within := sum(min(n, max(0, len(raw) - at)) for at, n in zip(places, sizes))) * MOST_FOR_A_BYTE < height * width * samples * bits // 8:
        raise ValueError(f"{within} bytes can't hold {width} x {height} pixels")
    image = np.empty((height, width, samples), kind)
    corners = [(plane, y, x) for plane in range(planes) for y in range(0, height, down) for x in range(0, width, across)]
    for (plane, y, x), place, n in zip(corners, places, sizes):
        rows = down if tiled else min(down, height - y)
        part = _unpack(raw[place : place + n], compression, rows * -(-across * inside * bits // 8))
        part = _samples(part, rows, across * inside, bits, kind).reshape(rows, across, inside)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
        image[y : y + rows, x : x + across, plane : plane + inside] = part[: height - y, : width - x]
    return Page(width, height, bits, samples, compression, predictor, tiled, image.astype(kind.newbyteorder("<"), copy=False).tobytes())


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows: int = 32, tile: int | None = None) -> bytes:
    """A little-endian file of 8-bit greyscale pages, in strips of so many rows, or in tiles of that height and tile's width."""
    out, link = bytearray(b"II" + struct.pack("<HI", 42, 0)), 4
    for image in pages:
        height, width = image.shape
        across, parts = tile or width, []
        for y in range(0, height, rows):
            for x in range(0, width, across):
                part = image[y : y + rows, x : x + across]
                if tile:
                    part = np.pad(part, ((0, rows - part.shape[0]), (0, across - part.shape[1])), mode="edge")
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros((part.shape[0], 1), np.uint8))
                parts.append(_pack(part.tobytes(), compression))
        places = []
        for part in parts:
            places.append(len(out))
            out += part
        sizes = [len(p) for p in parts]
        out += b"\0" * (len(out) % 2)
        lists = len(out)
        if len(parts) > 1:
            out += struct.pack(f"<{2 * len(parts)}I", *places, *sizes)
        refer = (lambda k: lists + 4 * k * len(parts)) if len(parts) > 1 else (lambda k: (places, sizes)[k][0])
        tags = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, 8), (259, 3, 1, compression), (262, 3, 1, 1), (277, 3, 1, 1), (317, 3, 1, predictor)]
        if tile:
            tags += [(322, 4, 1, across), (323, 4, 1, rows), (324, 4, len(parts), refer(0)), (325, 4, len(parts), refer(1))]
        else:
            tags += [(273, 4, len(parts), refer(0)), (278, 4, 1, rows), (279, 4, len(parts), refer(1))]
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags))
        for tag in sorted(tags):
            out += struct.pack("<HHII", *tag)
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


_PAGE = [("page", T.IntegerType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("bits", T.IntegerType()), ("samples", T.IntegerType()), ("compression", T.IntegerType()), ("predictor", T.IntegerType()), ("tiled", T.BooleanType()), ("pixels", T.BinaryType()), ("error", T.StringType())]


def page_rows(raw: bytes) -> Iterator[tuple]:
    """_PAGE's fields of each page of a file; a page or a file that can't be read has its reason in the last, and else only a number."""
    failed = lambda k, e: (k, *[None] * 8, f"{type(e).__name__}: {e}")
    try:
        for k, (order, tags) in enumerate(_directories(raw)):
            try:
                yield k, *_page(raw, order, tags), None
            except _BAD as e:
                yield failed(k, e)
    except _BAD as e:
        yield failed(-1, e)


def tiff_pages(files: DataFrame, content: str, keys: list[str]) -> DataFrame:
    """A row for each page of each file in a binary column: the keys, page (from 0), its form, pixels in row order, error."""
    keys = [k for k in keys if k not in dict(_PAGE)]
    schema = T.StructType([*(files.schema[k] for k in keys), *(T.StructField(n, t) for n, t in _PAGE)])
    kinds = [pa.int32()] * 7 + [pa.bool_(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, raw in enumerate(b.column(len(keys))):
                if raw.is_valid and (found := list(page_rows(raw.as_py()))):
                    key = [pa.array([b.column(i)[k].as_py()] * len(found), b.schema.types[i]) for i in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*key, *(pa.array(x, t) for x, t in zip(zip(*found), kinds))], names=schema.names)

    return files.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{content}`").cast("binary")).mapInArrow(run, schema)


# Documents as pages


def payload_pages(payload: bytes) -> list[np.ndarray]:
    """Rows of PAD samples, in pages of at most PAGE_ROWS rows."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, PAD)
    return [image[k : k + PAGE_ROWS] for k in range(0, len(image), PAGE_ROWS)]


def store(payload: bytes, form: Form = FORM) -> bytes:
    """A TIFF of a payload whose size is a multiple of PAD."""
    return write_tiff(payload_pages(payload), *form)


def features(pages: list[Page]) -> str:
    """Pages, mean, deviation, shares of 16 grey levels, and an 8 x 8 average hash of all samples in order."""
    x = np.frombuffer(b"".join(p.pixels for p in pages), np.uint8)
    levels = np.bincount(x, minlength=256)
    mean = float(levels @ np.arange(256)) / len(x)
    deviation = (float(levels @ (np.arange(256) - mean) ** 2) / len(x)) ** 0.5
    shares = " ".join(f"{n / len(x):.4f}" for n in levels.reshape(16, 16).sum(1))
    blocks = x.reshape(64, -1).sum(1, dtype=np.int64) * 64 > int(levels @ np.arange(256))
    return f"pages {len(pages)}; mean {mean:.3f}; deviation {deviation:.3f}; levels {shares}; hash {np.packbits(blocks).tobytes().hex()}"


def document_media(docs: DataFrame, form: Form = FORM) -> DataFrame:
    """Each document's text stored as TIFF pages and read back: see op8's columns."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def row(doc: int | None, text: str | None) -> tuple:
        raw = (text or "").encode("utf-8", "surrogatepass")
        media = store(raw + b"\xff" * (-len(raw) % PAD or PAD * (not raw)), form)
        pages = [Page(*p[1:-1]) for p in page_rows(media)]
        back = b"".join(p.pixels for p in pages)
        return doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            rows = [row(d, t.as_py()) for d, t in zip(b.column(0).to_pylist(), b.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names=names)

    kind = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)


def op8_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(table(spark, sf_dir, "documents"))
