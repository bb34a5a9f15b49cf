"""What an image file says of itself before it is decoded: format, width, height and the bytes that decoding it takes.

Only the header is read, by seeking in the file; so an image that claims to be too large is refused without its pixels."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADS = "path string, format string, width long, height long, decoded_bytes long"
MOST_SEGMENTS = 4096


class _Bytes:
    """Reads of a file at offsets; what isn't there raises ValueError."""

    def __init__(self, f):
        self.f = f

    def at(self, offset: int, n: int) -> bytes:
        self.f.seek(offset)
        got = self.f.read(n)
        if len(got) < n:
            raise ValueError("short")
        return got

    def unpack(self, form: str, offset: int) -> tuple:
        return struct.unpack(form, self.at(offset, struct.calcsize(form)))


def _png(b: _Bytes):
    if b.at(12, 4) != b"IHDR":
        raise ValueError("no header")
    w, h, depth, colour = b.unpack(">IIBB", 16)
    channels = {0: 1, 2: 3, 3: 4, 4: 2, 6: 4}[colour]
    return w, h, w * h * channels * (2 if depth == 16 else 1)


def _jpeg(b: _Bytes):
    at = 2
    for _ in range(MOST_SEGMENTS):
        mark, kind, size = b.unpack(">BBH", at)
        if mark != 0xFF:
            raise ValueError("no marker")
        if kind == 0xFF:  # padding
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            _, h, w, channels = b.unpack(">BHHB", at + 4)
            return w, h, w * h * channels
        else:
            at += 2 + size
    raise ValueError("no frame")


def _gif(b: _Bytes):
    w, h = b.unpack("<HH", 6)
    return w, h, w * h * 4


def _bmp(b: _Bytes):
    (size,) = b.unpack("<I", 14)
    if size == 12:
        w, h, _, depth = b.unpack("<HHHH", 18)
    elif size >= 16:
        w, h, _, depth = b.unpack("<iiHH", 18)
    else:
        raise ValueError("no header")
    return abs(w), abs(h), abs(w) * abs(h) * (4 if depth == 32 else 3)


def _webp(b: _Bytes):
    kind = b.at(12, 4)
    if kind == b"VP8X":
        parts = b.at(24, 6)
        w, h = int.from_bytes(parts[:3], "little") + 1, int.from_bytes(parts[3:], "little") + 1
    elif kind == b"VP8L":
        (bits,) = b.unpack("<I", 21)
        w, h = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    elif kind == b"VP8 ":
        w, h = (x & 0x3FFF for x in b.unpack("<HH", 26))
    else:
        raise ValueError("no chunk")
    return w, h, w * h * 4


def _tiff(b: _Bytes):
    order = "<" if b.at(0, 2) == b"II" else ">"
    (at,) = b.unpack(f"{order}I", 4)
    (n,) = b.unpack(f"{order}H", at)
    told = {}
    for k in range(n):
        tag, kind, count, value = b.unpack(f"{order}HHI4s", at + 2 + 12 * k)
        if kind in (3, 4) and count >= 1:
            told[tag] = struct.unpack(f"{order}H" if kind == 3 else f"{order}I", value[: 2 if kind == 3 else 4])[0]
    w, h = told[256], told[257]
    return w, h, w * h * told.get(277, 1) * 2


def _ico(b: _Bytes):
    (n,) = b.unpack("<H", 4)
    sizes = [tuple(x or 256 for x in b.unpack("<BB", 6 + 16 * k)) for k in range(n)]
    w, h = max(sizes)
    return w, h, w * h * 4


KINDS = ((b"\x89PNG\r\n\x1a\n", "png", _png), (b"\xff\xd8\xff", "jpeg", _jpeg), (b"GIF87a", "gif", _gif), (b"GIF89a", "gif", _gif), (b"BM", "bmp", _bmp), (b"II*\0", "tiff", _tiff), (b"MM\0*", "tiff", _tiff), (b"\0\0\1\0", "ico", _ico))


def image_head(f) -> tuple[str | None, int | None, int | None, int | None]:
    """format, width, height, decoded bytes of an open file; nulls where it isn't an image or its header is broken."""
    b = _Bytes(f)
    try:
        first = b.at(0, 12)
        kind, read = ("webp", _webp) if first[:4] == b"RIFF" and first[8:] == b"WEBP" else next(((k, r) for sign, k, r in KINDS if first.startswith(sign)), (None, None))
        return (kind, *read(b)) if read else (None, None, None, None)
    except (ValueError, KeyError, struct.error):
        return None, None, None, None


def _open(path: str):
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return store.open_input_file(where)


def _told(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["path", "format", "width", "height", "decoded_bytes"])


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path in batch.column(0).to_pylist():
            try:
                with _open(path) as f:
                    rows.append((path, *image_head(f)))
            except OSError:
                rows.append((path, None, None, None, None))
        yield _told(rows)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _told([(path, *image_head(io.BytesIO(content.as_py() or b""))) for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)])


def image_heads(files: DataFrame, max_pixels: int = 40_000_000, max_axis: int = 16_384, max_bytes: int = 256 << 20, max_file_bytes: int = 64 << 20) -> DataFrame:
    """files (path, size, perhaps content): path, format, width, height, decoded_bytes and error: IMAGE_TOO_LARGE by the file's size (it isn't
    opened then), or by what its header claims; UNSUPPORTED_IMAGE where it has no header that is known. No image is decoded, and without a
    column of contents no more of a file is read than its header."""
    long = F.coalesce(F.col("size") > max_file_bytes, F.lit(False))
    rows = files.where(~long)
    heads = rows.select("path", "content").mapInArrow(_contents, HEADS) if "content" in files.columns else rows.select("path").mapInArrow(_files, HEADS)
    none = (F.col("width") == 0) | (F.col("height") == 0)
    big = none | (F.greatest("width", "height") > max_axis) | (F.col("width").cast("decimal(20,0)") * F.col("height") > max_pixels) | (F.col("decoded_bytes") > max_bytes)
    told = heads.withColumn("error", F.when(F.col("format").isNull(), "UNSUPPORTED_IMAGE").when(big, "IMAGE_TOO_LARGE"))
    refused = files.where(long).select("path", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in HEADS.split(", ")[1:]], F.lit("IMAGE_TOO_LARGE").alias("error"))
    return told.unionByName(refused)
