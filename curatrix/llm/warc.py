"""Web archives (WARC 1.1) as a Python data source.

Reading plans one partition per archive file, takes filters on record type and header fields into the scan, parses the
headers first and skips the payloads of records that aren't wanted: archives written here give each compressed record's
length in its gzip header, so that the reader seeks past it; others are decompressed and dropped. Writing gives each
task a file of its own name, and each commit adds a manifest of the files that count, so that tasks run twice do no harm
and appended archives stay together; overwriting drops the manifests before. Paths are whatever pyarrow's file systems
open (local, hdfs, s3, ...); one without a scheme is on the session's default file system.
"""

from __future__ import annotations

import gzip
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from curatrix.llm.common import cut, shared_folder

PAGE = "urn:page:"  # before a page's id, in its URL encoding
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
LEAST_REVISIT = 100
MANIFEST = "_manifest"
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
_EXTRA = b"WL"  # the gzip header's subfield that holds the record's compressed length


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that it has in this session."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file:///") else full


def _manifests(store, root: str) -> list[str]:
    from pyarrow import fs

    if store.get_file_info(root).type != fs.FileType.Directory:
        return []
    return [i.path for i in store.get_file_info(fs.FileSelector(root)) if i.base_name.startswith(MANIFEST)]


def member(record: bytes, level: int = 1) -> bytes:
    """A record as a gzip member whose header tells the member's length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H2sHI", 8, _EXTRA, 4, 20 + len(body) + 8)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(record_id: str, record_type: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if record_type == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _header(f, more: bytes = b"") -> tuple[dict, bytes] | None:
    """The header fields that come next in f, and what was read beyond them; None at the end."""
    held = more.lstrip(b"\r\n")
    while b"\r\n\r\n" not in held:
        part = f.read(2048)
        if not part:
            return None
        held = (held + part).lstrip(b"\r\n") if not held else held + part
    head, _, rest = held.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, colon, v = line.partition(":")
        if colon:
            fields[k.strip().lower()] = v.strip()
    return fields, rest


def records(f, wanted, payloads: bool) -> Iterator[tuple]:
    """Rows of an open archive, plain or compressed by record."""
    if f.read(2) == b"\x1f\x8b":
        f.seek(0)
        at = 0
        while True:
            f.seek(at)
            head = f.read(20)
            if len(head) < 18:
                return
            if head[3] != 4 or head[12:14] != _EXTRA:  # foreign archive: one stream of members, decompressed throughout
                yield from _plain(gzip.GzipFile(fileobj=_From(f, at)), wanted, payloads, seek=False)
                return
            yield from _plain(_Member(f, at, struct.unpack("<I", head[16:20])[0]), wanted, payloads, seek=False, once=True)
            at += struct.unpack("<I", head[16:20])[0]
    else:
        f.seek(0)
        yield from _plain(f, wanted, payloads, seek=True)


class _From:
    def __init__(self, f, at: int):
        self.f = f
        f.seek(at)

    def read(self, n: int = -1) -> bytes:
        return self.f.read(n if n >= 0 else None)


class _Member(_From):
    """A member decompressed as far as it is read: the first step is enough for the headers."""

    def __init__(self, f, at: int, size: int):
        super().__init__(f, at + 20)
        self.left, self.step, self.inflate, self.held = size - 28, 2048, zlib.decompressobj(-15), b""

    def read(self, n: int = -1) -> bytes:
        out = [self.held]
        have = len(self.held)
        while (n < 0 or have < n) and self.left > 0:
            part = self.f.read(min(self.left, self.step))
            if not part:
                break
            self.left, self.step = self.left - len(part), 1 << 20
            out.append(self.inflate.decompress(part))
            have += len(out[-1])
        whole = b"".join(out)
        n = have if n < 0 else n
        self.held = whole[n:]
        return whole[:n]


def _plain(f, wanted, payloads: bool, seek: bool, once: bool = False) -> Iterator[tuple]:
    more = b""
    while (found := _header(f, more)) is not None:
        fields, rest = found
        size = int(fields.get("content-length") or 0)
        row = {k: fields.get(h) for k, h in HEADERS.items()}
        row = {k: v.strip("<>") if v and k in ("record_id", "refers_to") else v for k, v in row.items()}
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].removeprefix("sha256:")
        take = wanted(row)
        if take and payloads:
            block = rest[:size] + (f.read(size - len(rest)) if size > len(rest) else b"")
            more = rest[size:]
            payload = block.partition(b"\r\n\r\n")[2] if (fields.get("content-type") or "").startswith("application/http") else block
        else:
            payload, skip, more = None, size - len(rest), rest[size:]
            if skip > 0 and not once:
                if seek:
                    f.seek(skip, 1)
                else:
                    while skip > 0 and (part := f.read(min(skip, 1 << 20))):
                        skip -= len(part)
        if take:
            length = fields.get("warc-payload-length")
            if row["record_type"] == "revisit":
                payload = None
            yield (*(row[k] for k in HEADERS), int(length) if length else len(payload) if payload is not None else None, payload)
        if once:
            return


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payloads, self.filters = options["path"], options.get("payloads", "true") == "true", []

    def pushFilters(self, filters):
        for f in filters:
            ok = isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS
            if ok:
                self.filters.append((f.attribute[0], set(f.value) if isinstance(f, In) else {f.value}))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, root = _store(self.path)
        told = _manifests(store, root)
        if not told:  # archives that something else has written
            infos = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
            return [_File(i.path) for i in infos if i.type == fs.FileType.File and i.path.endswith((".warc", ".warc.gz"))] or [_File("")]
        names = []
        for listed in told:
            with store.open_input_stream(listed) as f:
                names += f.read().decode().split()
        return [_File(f"{root}/{n}") for n in names] or [_File("")]

    def read(self, partition):
        if not partition.path:
            return
        store, _ = _store(self.path)
        wanted = lambda row: all(row[k] in v for k, v in self.filters)
        with store.open_input_file(partition.path) as f:
            rows, held = [], 0
            for row in records(f, wanted, self.payloads):
                rows.append(row)
                held += len(row[-1] or b"") + 1
                if held > BATCH_BYTES or len(rows) == BATCH_ROWS:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 7
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[*HEADERS, "payload_bytes", "payload"])


class _Written(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class _Writer(DataSourceWriter):
    """Rows: record_id, record_type, target_uri, refers_to, payload_digest, payload (null: empty)."""

    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator):
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        name, f = f"{uuid.uuid4().hex}.warc.gz", None
        for r in iterator:
            f = f or store.open_output_stream(f"{root}/{name}", compression=None)
            f.write(member(record(r.record_id, r.record_type, r.target_uri, bytes(r.payload or b""), r.payload_digest, r.refers_to)))
        if f:
            f.close()
        return _Written(name if f else None)

    def commit(self, messages):
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        before = _manifests(store, root) if self.overwrite else []
        with store.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}") as f:
            f.write("\n".join(m.name for m in messages if m and m.name).encode())
        for listed in before:
            store.delete_file(listed)

    def abort(self, messages):
        store, root = _store(self.path)
        for m in messages:
            if m and m.name:
                store.delete_file(f"{root}/{m.name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", qualified(spark, path)).option("payloads", str(payloads).lower()).load()


def write_pages(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """A record per page. Of equal payloads of at least `least` bytes, that with the smallest page_id is the response and
    the others revisit it. A null html is an empty payload; pages with the same page_id and html repeat the record."""
    register(pages.sparkSession)
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select("page_id", url.alias("target_uri"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= least
    firsts = rows.where(long).groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("payload_digest").alias("_digest"), "_first")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    urn = lambda c: F.coalesce(F.concat(F.lit(PAGE), F.url_encode(c.cast("string"))), F.lit("urn:none"))
    out = rows.join(firsts.hint("shuffle_hash"), F.col("payload_digest") == F.col("_digest"), "left")
    out.select(urn(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", F.when(revisit, urn(F.col("_first"))).alias("refers_to"), "payload_digest", "payload").write.format("warc").mode("append").option("path", qualified(pages.sparkSession, path)).save()


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from archives written and read back.

    The digest of a response is taken from the payload as read; that of a revisit is in its header. An empty table gives
    no rows; ids of any type come back as they were, a null page_id as null (its record's name is of another kind); a very long payload is one record, held by one task at a time. Other columns are left out."""
    spark = pages.sparkSession
    path = path or shared_folder(spark)
    write_pages(pages, path)
    back = read(spark, path)
    page = lambda c: F.when(c.startswith(PAGE), F.url_decode(F.substring(c, len(PAGE) + 1, 1 << 30))).cast(pages.schema["page_id"].dataType)
    response = F.col("record_type") == "response"
    return cut(back.select(page(F.col("record_id")).alias("page_id"), F.when(response, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"), F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", page(F.col("refers_to")).alias("refers_to")))
