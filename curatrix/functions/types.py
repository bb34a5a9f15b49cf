"""What a file is, by its first bytes: signatures, and the containers that say more than their signature."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

HEAD = 8192

# Signatures at the start (bytes in hex) and their types.
SIGNATURES = {
    "89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg", "474946383761": "image/gif", "474946383961": "image/gif", "49492A00": "image/tiff", "4D4D002A": "image/tiff", "38425053": "image/vnd.adobe.photoshop",
    "00000100": "image/vnd.microsoft.icon", "4949BC01": "image/vnd.ms-photo", "494433": "audio/mpeg", "FFFB": "audio/mpeg", "FFF3": "audio/mpeg", "FFF2": "audio/mpeg", "FFF1": "audio/aac", "FFF9": "audio/aac",
    "664C6143": "audio/x-flac", "4F676753": "audio/ogg", "4D546864": "audio/midi", "2321414D520A": "audio/amr", "464F524D": "audio/x-aiff", "3026B2758E66CF11": "video/x-ms-wmv", "464C5601": "video/x-flv",
    "000001BA": "video/mpeg", "000001B3": "video/mpeg", "25504446": "application/pdf", "526172211A07": "application/vnd.rar", "377ABCAF271C": "application/x-7z-compressed", "1F8B08": "application/gzip",
    "425A68": "application/x-bzip2", "FD377A585A00": "application/x-xz", "28B52FFD": "application/zstd", "4D534346": "application/vnd.ms-cab-compressed", "213C617263683E0A": "application/vnd.debian.binary-package",
    "7F454C46": "application/x-executable", "0061736D": "application/wasm", "CAFEBABE": "application/java", "53514C69746520666F726D6174203300": "application/vnd.sqlite3", "7B5C72746631": "application/rtf",
    "D0CF11E0A1B11AE1": "application/x-ole-storage", "774F4646": "application/font-woff", "774F4632": "application/font-woff", "3C3F786D6C": "text/xml", "2321": "text/x-shellscript",
}
# Brands of ISO media files, of which one decides (in this order), and the types of RIFF forms.
BRANDS = {"avif": "image/avif", "avis": "image/avif", "heic": "image/heif", "heix": "image/heif", "hevc": "image/heif", "M4A ": "audio/m4a", "M4B ": "audio/m4a", "M4V ": "video/x-m4v", "qt  ": "video/quicktime", "3gp4": "video/3gpp", "3gp5": "video/3gpp", "3gp6": "video/3gpp"}
FORMS = {"WAVE": "audio/x-wav", "AVI ": "video/x-msvideo", "WEBP": "image/webp"}
# Entries of ZIP packages and their types.
OFFICE = "application/vnd.openxmlformats-officedocument"
ENTRIES = {"word/": f"{OFFICE}.wordprocessingml.document", "xl/": f"{OFFICE}.spreadsheetml.sheet", "ppt/": f"{OFFICE}.presentationml.presentation", "META-INF/MANIFEST.MF": "application/java-archive"}
DIB_SIZES = (12, 40, 52, 56, 64, 108, 124)
HTML_TAGS = "!doctype html|html|head|script|iframe|h1|div|font|table|a|style|title|b|body|br|p"
# Guesses from extensions that differ from the standard library's table.
GUESSED = {"md": "text/markdown", "js": "text/javascript", "xml": "text/xml", "ts": "video/mp2t", "webp": "image/webp", "heic": "image/heic", "avif": "image/avif", "mkv": "video/x-matroska", "flac": "audio/flac", "7z": "application/x-7z-compressed", "rar": "application/vnd.rar", "gz": "application/gzip"}


def guesses() -> dict[str, str]:
    """Types by extension: the standard library's own table, whatever the machine has installed, and the differences above."""
    known = mimetypes.MimeTypes(filenames=()).types_map[True]
    return {k.lstrip("."): v for k, v in known.items()} | GUESSED


def _table(of: dict[str, str]) -> Column:
    return F.create_map(*[x for k, v in of.items() for x in (F.lit(k), F.lit(v))])


def _number(head: Column, at: int, size: int, little: bool = False) -> Column:
    """An unsigned number of up to 4 bytes at an offset."""
    byte = lambda k: F.conv(F.hex(F.substring(head, at + k + 1, 1)), 16, 10).cast("long")
    return sum((byte(k) * (1 << 8 * (k if little else size - 1 - k)) for k in range(size)), F.lit(0).cast("long"))


def by_signature(head: Column) -> Column:
    """The type of the longest known signature that the head starts with: a lookup for each length that there is."""
    digits = F.hex(F.substring(head, 1, 16))
    found = [F.try_element_at(_table({k: v for k, v in SIGNATURES.items() if len(k) == n}), F.substring(digits, 1, n)) for n in sorted({len(k) for k in SIGNATURES}, reverse=True)]
    return F.coalesce(*found)


def by_container(head: Column) -> Column:
    """The type that the inside of a container tells: brands of ISO media, the form of RIFF, the document type of EBML, entries of ZIP; and
    formats of which two bytes say too little: bitmaps by the size of their header, programs by what their header points to, tar by its magic."""
    text = F.decode(F.substring(head, 1, HEAD), "ISO-8859-1")
    at = lambda i, n: F.substring(text, i + 1, n)
    # ISO media: a box `ftyp` with the major brand, a version and further brands up to the box's end.
    end = F.least(_number(head, 0, 4), F.lit(256), F.length(text).cast("long"))
    more = F.when(end >= 20, F.transform(F.sequence(F.lit(17).cast("long"), end - 3, F.lit(4).cast("long")), lambda i: F.substr(text, i.cast("int"), F.lit(4)))).otherwise(F.array().cast("array<string>"))
    brands = F.concat(F.array(at(8, 4)), more)
    named = F.filter(F.array(*[F.struct(F.lit(b).alias("brand"), F.lit(m).alias("mime")) for b, m in BRANDS.items()]), lambda x: F.array_contains(brands, x["brand"]))
    major = F.try_element_at(_table(BRANDS), at(8, 4))
    picture = at(8, 4).isin("mif1", "msf1")
    iso = F.when(at(4, 4) == "ftyp", F.coalesce(major, F.when(picture, F.coalesce(F.get(named, F.lit(0))["mime"], F.lit("image/heif"))), F.lit("video/mp4")))
    riff = F.when(at(0, 4) == "RIFF", F.try_element_at(_table(FORMS), at(8, 4)))
    kind = F.regexp_extract(text, r"(?s)^\x1A\x45\xDF\xA3.{0,60}?\x42\x82[\x81-\x8F](webm|matroska)", 1)
    ebml = F.when(F.substring(F.hex(head), 1, 8) == "1A45DFA3", F.when(kind == "webm", "video/webm").otherwise("video/x-matroska"))
    # ZIP: a first entry `mimetype`, stored, holds the type; else the names of entries tell it.
    stored = F.regexp_extract(text, r"(?s)^PK\x03\x04.{26}mimetype(application/[a-z0-9.+-]+)", 1)
    entry = F.regexp_extract(text, r"(?s)PK\x03\x04.{26}(word/|xl/|ppt/|META-INF/MANIFEST\.MF)", 1)
    zipped = F.when(at(0, 4) == "PK\x03\x04", F.when(stored != "", stored).otherwise(F.coalesce(F.try_element_at(_table(ENTRIES), entry), F.lit("application/zip"))))
    bitmap = F.when((at(0, 2) == "BM") & _number(head, 14, 4, True).isin(*DIB_SIZES), "image/bmp")
    points = _number(head, 60, 4, True)
    program = F.when((at(0, 2) == "MZ") & (F.octet_length(head) >= 64) & ((points + 4 > F.octet_length(head)) | (F.substr(text, points.cast("int") + 1, F.lit(4)) == "PE\0\0")), "application/vnd.microsoft.portable-executable")
    tar = F.when(at(257, 5) == "ustar", "application/x-tar")
    html = F.when(text.rlike(rf"(?i)^[\t\n\x0C\r ]*(<({HTML_TAGS})[ >]|<!--)"), "text/html")
    return F.coalesce(iso, riff, ebml, zipped, bitmap, program, tar, html)


def detect_type(head: Column, ext: Column, known: dict[str, str] | None = None) -> tuple[Column, Column]:
    """(mime, source): the content first, then the extension (known: types by extension); .ts and .tsx are text if the head is."""
    head = F.substring(head, 1, HEAD)
    signed = F.coalesce(by_container(head), by_signature(head))
    text = ext.isin("ts", "tsx") & (F.instr(F.decode(head, "ISO-8859-1"), "\0") == 0) & F.is_valid_utf8(head.cast("string"))
    guessed = F.when(text, "text/plain").otherwise(F.try_element_at(_table(guesses() if known is None else known), ext))
    return F.coalesce(signed, guessed), F.when(signed.isNotNull(), "content").when(guessed.isNotNull(), "extension").otherwise("unknown")
