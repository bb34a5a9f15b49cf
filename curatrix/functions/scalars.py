"""Column functions over catalogue rows: paths, types, dates, sizes, digests, vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RECOVERY = ".recovery"

# Categories by extension.
CATEGORY_EXTENSIONS = {
    "document": "doc docx odt txt md rtf pdf",
    "spreadsheet": "xls xlsx csv ods",
    "presentation": "ppt pptx odp",
    "archive": "zip rar 7z tar gz bz2 xz",
    "code": "js ts jsx tsx py rs java cs cpp c h html css json yaml yml toml xml sql sh ps1",
    "executable": "exe msi app dmg deb rpm",
    "image": "jpg jpeg png webp gif svg bmp tiff tif heic raw avif",
    "video": "mp4 mov mkv avi webm m4v",
    "audio": "mp3 wav flac m4a ogg aac",
}
ARCHIVE_TYPES = "application/zip application/x-rar-compressed application/vnd.rar application/x-7z-compressed application/gzip application/x-tar".split()
PROGRAM_TYPES = "application/vnd.microsoft.portable-executable application/x-dosexec application/x-executable".split()
OFFICE_EXTENSIONS = "docx xlsx pptx odt ods odp".split()
IMAGE_EXTENSIONS = "jpg jpeg png gif webp bmp tif tiff ico".split()
VIDEO_EXTENSIONS = "mp4 mov mkv avi webm m4v mpg mpeg mts m2ts 3gp wmv".split()
TEMPORARY = "part partial crdownload download tmp".split()


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once a row however often it is used."""
    return F.transform(F.array(value), use)[0]


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def path_key(path: Column) -> Column:
    return F.lower(slashed(path))


def file_name(path: Column) -> Column:
    return F.substring_index(slashed(path), "/", -1)


def stem(path: Column) -> Column:
    """The name up to its last dot; a name whose only dot leads is all stem."""
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]*$", "$1")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def parent(path: Column) -> Column:
    p = slashed(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_extract(p, r"^(.*)/[^/]*$", 1))


def depth(path: Column) -> Column:
    return F.size(F.array_remove(F.split(slashed(path), "/"), ""))


def relative_path(path: Column, root: Column) -> Column:
    return F.when(path_key(path).startswith(F.concat(path_key(root), F.lit("/"))), F.substring(slashed(path), F.length(root) + 2, F.length(path)))


def ancestors(path: Column, itself: bool = True) -> Column:
    """The path's prefixes by component, outermost first: for equi-joins in place of prefix joins."""
    none = F.array().cast("array<string>")

    def prefixes(parts: Column) -> Column:
        n = F.size(parts) - (0 if itself else 1)
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(none)

    return once(F.array_remove(F.split(slashed(path), "/"), ""), prefixes)


def breadcrumbs(path: Column, root: Column) -> Column:
    """(name, path) from the root down to the path."""
    steps = F.filter(ancestors(path), lambda p: F.length(p) >= F.length(root))
    return F.transform(steps, lambda p: F.struct(file_name(p).alias("name"), p.alias("path")))


def local_day(ms: Column) -> Column:
    return F.to_date(F.timestamp_millis(ms))


def selected_date(source: Column, created: Column, modified: Column, accessed: Column) -> Column:
    return F.when(source == "created", created).when(source == "modified", modified).when(source == "accessed", accessed)


def classify_category(mime: Column, ext: Column) -> Column:
    """The type decides first, then the extension."""
    out = F.when(mime.startswith("image/"), "image").when(mime.startswith("video/"), "video").when(mime.startswith("audio/"), "audio").when(mime == "application/pdf", "document")
    out = out.when(mime.isin(ARCHIVE_TYPES) & ~ext.isin(OFFICE_EXTENSIONS), "archive").when(mime.isin(PROGRAM_TYPES), "executable")
    for category, known in CATEGORY_EXTENSIONS.items():
        out = out.when(ext.isin(known.split()), category)
    return out.otherwise("other")


def media_kind(ext: Column, include_videos: bool = True) -> Column:
    out = F.when(ext.isin(IMAGE_EXTENSIONS), "image")
    return out.when(ext.isin(VIDEO_EXTENSIONS), "video") if include_videos else out


def is_temporary(name: Column) -> Column:
    return F.lower(name).rlike(rf"\.({'|'.join(TEMPORARY)})$")


def is_hidden(name: Column) -> Column:
    return name.startswith(".")


def is_recovery(path: Column, recovery_dir: str = RECOVERY) -> Column:
    return F.array_contains(F.split(path_key(path), "/"), recovery_dir.lower())


def format_size(size: Column) -> Column:
    """1024 steps, at most one decimal, Spanish separators; null is a dash."""
    index = F.least(F.floor(F.log(1024.0, size.cast("double"))), F.lit(5)).cast("int")
    value = F.round(size / F.pow(F.lit(1024.0), index), F.lit(1))
    text = F.regexp_replace(F.translate(F.format_number(value, 1), ",.", ".,"), ",0$", "")
    return F.when(size.isNull(), "—").when(size == 0, "0 B").otherwise(F.concat_ws(" ", text, F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB", "TB", "PB"))), index + 1)))


def format_quantity(n: Column, one: str, many: str) -> Column:
    return F.concat_ws(" ", F.translate(F.format_number(n, 0), ",", "."), F.when(n == 1, one).otherwise(many))


def ticks(text: Column) -> Column:
    return F.when(text.rlike(r"^[0-9]{1,20}$"), text.try_cast("decimal(20,0)"))


def date_change(created: Column, modified: Column) -> Column:
    """(from, to, error) of a change of the modification date to the creation date, as exact ticks; INVALID_DATE where either isn't a number."""
    made, changed = ticks(created), ticks(modified)
    return F.struct(changed.alias("from"), made.alias("to"), F.when(made.isNull() | changed.isNull(), "INVALID_DATE").alias("error"))


def content_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def sample_digest(content: Column, block: int = 65_536) -> Column:
    """Digest of the size, the first block and, of longer contents, the last block."""
    n = F.octet_length(content)
    size = F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))
    tail = F.when(n > block, F.substring(content, n - block + 1, F.lit(block))).otherwise(F.lit(b"").cast("binary"))
    return F.sha2(F.concat(size, F.substring(content, 1, block), tail), 256)


def image_views(width: Column, height: Column, mode: str = "thorough") -> Column:
    """The whole image, and of long ones the centre square and the two end squares, as (x, y, edge); the whole has no edge."""
    short, long = F.least(width, height), F.greatest(width, height)
    kind = "struct<x:int,y:int,edge:int>"
    view = lambda x, y, e: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), e.cast("int").alias("edge")).cast(kind)
    none, zero = F.lit(None), F.lit(0)
    all_views = F.array(view(none, none, none), view(F.floor((width - short) / 2), F.floor((height - short) / 2), short), view(zero, zero, short), view(width - short, height - short, short))
    fast = F.lit(mode == "fast") | (long * 100 < short * 112)
    return F.when((width > 0) & (height > 0), F.slice(all_views, F.lit(1), F.when(fast, 1).when(long * 100 >= short * 180, 4).otherwise(2)))


def frame_times(duration: Column) -> Column:
    known = duration.isNotNull() & ~F.isnan(duration) & (duration > 0)
    return F.when(known, F.transform(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)), lambda s: s * duration)).otherwise(F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)))


def squared_norm(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def valid_embedding(vector: Column, dim: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite & squared_norm(vector).between(0.98, 1.02), F.lit(False))


def normalize(vector: Column) -> Column:
    n = F.sqrt(squared_norm(vector))
    return F.when(n >= 1e-8, F.transform(vector, lambda x: x.cast("double") / n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


_ACCENTED, _PLAIN = "áàäâãåéèëêíìïîóòöôõúùüûñçý", "aaaaaaeeeeiiiiooooouuuuncy"


def fold_text(text: Column) -> Column:
    """Lower case without the accents of Western European letters, composed or combining."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}+", ""), _ACCENTED, _PLAIN)


def natural_key(name: Column, width: int = 12) -> Column:
    """A string that sorts names by their numbers: runs of digits padded, accents and case folded."""
    runs = F.regexp_extract_all(fold_text(name), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]") & (F.length(r) < width), F.lpad(r, width, "0")).otherwise(r)), "")


def settings_key(model: Column, settings: Column, digest: Column) -> Column:
    """The cache key of a result: it changes with the model and any setting."""
    return F.concat_ws(":", model, F.sha2(F.to_json(settings), 256), digest)


def utf16_length(text: Column) -> Column:
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def validate_name(name: Column) -> Column:
    """INVALID_NAME, or null where the name can be a file's on all systems."""
    base = F.upper(F.substring_index(name, ".", 1))
    bad = (name == "") | name.isin(".", "..") | (utf16_length(name) > 240) | name.rlike(r"[ .]$|[\x00-\x1f\x7f<>:\"/\\|?*]") | (F.length(base) <= 5) & base.rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$")
    return F.when(bad | name.isNull(), "INVALID_NAME")
