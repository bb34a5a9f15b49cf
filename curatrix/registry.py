"""All queries of the catalogue library and their SQL, by inventory name. Each runs over whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.functions import names, scalars, signals, types
from curatrix.operators import browse, dedup, journal, media, rules, stores
from curatrix.plans import resolve
from curatrix.sources import catalog, heads
from curatrix.streaming import revisions, stable
from curatrix.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RULES = [
    rules.DateRule("p1", "Periodo 1", "1995-01-01", "1996-06-30", "/p/1", "modified"),
    rules.DateRule("p2", "Periodo 2", "1997-01-01", "1998-12-31", "/p/2", "modified"),
    rules.DateRule("c1", "Creados", "1999-01-01", "2000-06-30", "/p/3", "created"),
    rules.DateRule("a1", "Vistos", "1998-06-01", "1999-06-30", "/p/4", "accessed"),
    rules.DateRule("x1", "Apagado", "1990-01-01", "2030-01-01", "/p/9", "modified", False),
]
RULES_SQL = "rules(id, name, first, last, destination, source) AS (VALUES ('p1', 'Periodo 1', DATE '1995-01-01', DATE '1996-06-30', '/p/1', 'modified'), ('p2', 'Periodo 2', DATE '1997-01-01', DATE '1998-12-31', '/p/2', 'modified'), ('c1', 'Creados', DATE '1999-01-01', DATE '2000-06-30', '/p/3', 'created'), ('a1', 'Vistos', DATE '1998-06-01', DATE '1999-06-30', '/p/4', 'accessed'))"
MATCHED_SQL = "hits AS (SELECT i.id AS file_id, r.*, CASE source WHEN 'created' THEN created WHEN 'modified' THEN modified ELSE accessed END AS used FROM inbox i JOIN rules r ON CASE source WHEN 'created' THEN created WHEN 'modified' THEN modified ELSE accessed END BETWEEN first AND last), one AS (SELECT file_id, count(*) AS n, min(id) AS rule_id, min(name) AS rule_name, min(destination) AS destination, min(source) AS date_source, min(used) AS date_used FROM hits GROUP BY file_id), matched AS (SELECT i.*, CASE WHEN n = 1 THEN 'matched' ELSE 'needs-review' END AS status, CASE WHEN n > 1 THEN 'MULTIPLE_RULE_MATCHES' END AS error, CASE WHEN n = 1 THEN rule_id END AS rule_id, CASE WHEN n = 1 THEN rule_name END AS rule_name, CASE WHEN n = 1 THEN destination END AS destination, CASE WHEN n = 1 THEN date_source END AS date_source, CASE WHEN n = 1 THEN date_used END AS date_used FROM inbox i LEFT JOIN one ON id = file_id)"
PRESETS = {"main": names.Preset("main", "Main", "{period}_{date:yyyy-MM-dd}_{name} {counter:0000}", "lower", "dash"), "plain": names.Preset("plain", "Plain", "{year}{month}{day} {name}", "upper", "underscore")}
RULE_PRESETS = {"p1": "main", "c1": "plain"}
NAME = r"regexp_extract(path, '([^/]*)$', 1)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def simple(name: str, of: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """A query over one view; its SQL reads that view."""
    query(name, f"{with_views(of)} {sql}" if sql else None)(lambda s, d: f(view(s, d, of)))


def _path():
    """Made when a query is called: a column needs a session, and this module is imported without one."""
    return F.col("path")


# ---- scalars
simple("p1_path_parts", "inbox", lambda v: v.select("id", scalars.file_name(_path()).alias("name"), scalars.stem(_path()).alias("stem"), scalars.extension(_path()).alias("extension"), scalars.parent(_path()).alias("parent"), scalars.depth(_path()).cast("int").alias("depth"), scalars.relative_path(_path(), F.lit("/inbox")).alias("relative")),
       rf"SELECT id, {NAME} AS name, regexp_extract({NAME}, '^(.+)\.[^.]*$', 1) AS stem, lower(regexp_extract({NAME}, '^.+\.([^.]*)$', 1)) AS extension, '/inbox' AS parent, 2 AS depth, substr(path, 8) AS relative FROM inbox")
simple("p2_path_key", "catalog", lambda v: v.select(scalars.path_key(F.upper(F.translate("path", "/", "\\"))).alias("key")), "SELECT lower(path) AS key FROM catalog")
simple("p3_breadcrumbs", "catalog", lambda v: v.select("doc_id", F.explode(scalars.breadcrumbs(_path(), F.lit("/lib"))).alias("b")).select("doc_id", "b.name", "b.path"),
       "SELECT doc_id, 'lib' AS name, '/lib' AS path FROM catalog UNION ALL SELECT doc_id, source, '/lib/' || source FROM catalog UNION ALL SELECT doc_id, lang, '/lib/' || source || '/' || lang FROM catalog UNION ALL SELECT doc_id, 'doc-' || doc_id || '.txt', path FROM catalog")
simple("p4_selected_date", "inbox", lambda v: v.select("id", scalars.selected_date(F.when(F.col("id") % 3 == 0, "created").when(F.col("id") % 3 == 1, "modified").otherwise("accessed"), F.col("created"), F.col("modified"), F.col("accessed")).alias("day"), scalars.local_day((F.col("id") - 700) * 86_400_000 + 5).alias("local_day")),
       "SELECT id, CASE id % 3 WHEN 0 THEN created WHEN 1 THEN modified ELSE accessed END AS day, CAST(DATE '1970-01-01' + CAST(id - 700 AS INT) AS DATE) AS local_day FROM inbox")


# A head for each kind of content, then what its bytes don't tell: (bytes before the page's own, extension, type, where it is from).
_ZIP = b"PK\x03\x04" + bytes(26)
_OFFICE = "application/vnd.openxmlformats-officedocument"
HEADS = [
    (b"%PDF-1.7\n", "jpg", "application/pdf", "content"), (b"\x89PNG\r\n\x1a\n", "", "image/png", "content"), (b"\xff\xd8\xff\xe0", "", "image/jpeg", "content"), (b"GIF89a", "", "image/gif", "content"),
    (b"II*\0", "", "image/tiff", "content"), (b"MM\0*", "", "image/tiff", "content"), (b"BM" + bytes(12) + b"\x28\0\0\0", "", "image/bmp", "content"), (b"BM is a place ", "txt", "text/plain", "extension"),
    (b"RIFF\0\0\0\0WEBP", "", "image/webp", "content"), (b"RIFF\0\0\0\0WAVE", "", "audio/x-wav", "content"), (b"RIFF\0\0\0\0AVI ", "", "video/x-msvideo", "content"), (b"RIFF\0\0\0\0ACON", "", None, "unknown"),
    (b"\0\0\0\x18ftypisom\0\0\0\0isommp41", "", "video/mp4", "content"), (b"\0\0\0\x18ftypheic\0\0\0\0mif1heic", "", "image/heif", "content"), (b"\0\0\0\x1cftypmif1\0\0\0\0mif1avifmiaf", "", "image/avif", "content"),
    (b"\0\0\0\x18ftypmif1\0\0\0\0mif1heic", "", "image/heif", "content"), (b"\0\0\0\x18ftypM4A \0\0\0\0M4A isom", "mp4", "audio/m4a", "content"), (b"\0\0\0\x14ftypqt  \0\0\0\0qt  ", "", "video/quicktime", "content"),
    (b"\0\0\0\x14ftypM4V \0\0\0\0M4V ", "", "video/x-m4v", "content"), (b"\x1a\x45\xdf\xa3\x9f\x42\x86\x81\x01\x42\x82\x84webm", "", "video/webm", "content"), (b"\x1a\x45\xdf\xa3\xa3\x42\x86\x81\x01\x42\x82\x88matroska", "", "video/x-matroska", "content"),
    (_ZIP + b"any.txt", "", "application/zip", "content"), (_ZIP + b"[Content_Types].xml" + _ZIP + b"word/document.xml", "", f"{_OFFICE}.wordprocessingml.document", "content"), (_ZIP + b"_rels/.rels" + _ZIP + b"xl/workbook.xml", "", f"{_OFFICE}.spreadsheetml.sheet", "content"),
    (_ZIP + b"ppt/presentation.xml", "", f"{_OFFICE}.presentationml.presentation", "content"), (_ZIP + b"mimetypeapplication/epub+zipPK", "", "application/epub+zip", "content"), (b"Rar!\x1a\x07\0", "", "application/vnd.rar", "content"),
    (b"7z\xbc\xaf\x27\x1c", "", "application/x-7z-compressed", "content"), (b"\x1f\x8b\x08", "", "application/gzip", "content"), (b"BZh9", "", "application/x-bzip2", "content"), (b"\xfd7zXZ\0", "", "application/x-xz", "content"),
    (b"\x7fELF", "", "application/x-executable", "content"), (b"MZ" + bytes(58) + b"\x40\0\0\0PE\0\0", "", "application/vnd.microsoft.portable-executable", "content"), (b"MZ is no program" + b" " * 44 + b"\x40\0\0\0  ", "", None, "unknown"),
    (b"ID3\x04", "", "audio/mpeg", "content"), (b"fLaC", "", "audio/x-flac", "content"), (b"OggS", "", "audio/ogg", "content"), (bytes(257) + b"ustar", "", "application/x-tar", "content"), (b"SQLite format 3\0", "", "application/vnd.sqlite3", "content"),
    (b"", "jpg", "text/html", "content"), (b" \n", "ts", "text/html", "content"), (b"<?xml version", "", "text/xml", "content"), (b"#!/bin/sh", "", "text/x-shellscript", "content"), (b"const a = 1 ", "ts", "text/plain", "extension"),
    (b"a\0", "ts", "video/mp2t", "extension"), (b"words ", "html", "text/html", "extension"), (b"words ", "nothing", None, "unknown"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "doc", "application/x-ole-storage", "content"),
]
_HEADS_SQL = ", ".join(f"({k}, {'NULL' if m is None else repr(m)}, '{o}')" for k, (_, _, m, o) in enumerate(HEADS))


@query("p5_detect_type", f"SELECT page_id, mime, type_source FROM pages JOIN (VALUES {_HEADS_SQL}) h(k, mime, type_source) ON page_id % {len(HEADS)} = k")
def p5(s, d):
    known = F.array(*[F.struct(F.unhex(F.lit(b.hex())).alias("first"), F.lit(e).alias("ext")) for b, e, _, _ in HEADS])
    v = s.read.parquet(f"{d}/pages.parquet").withColumn("h", F.get(known, (F.col("page_id") % len(HEADS)).cast("int")))
    mime, source = types.detect_type(F.concat("h.first", F.col("html").cast("binary")), F.col("h.ext"))
    return v.select("page_id", mime.alias("mime"), source.alias("type_source"))


simple("p6_classify_category", "inbox", lambda v: v.select("id", scalars.classify_category(F.when(F.col("id") % 3 == 0, "application/zip").when(F.col("id") % 3 == 1, "image/png"), scalars.extension(_path())).alias("category")),
       "SELECT id, CASE WHEN id % 3 = 0 THEN 'archive' WHEN id % 3 = 1 THEN 'image' WHEN id % 5 = 0 THEN 'document' WHEN id % 5 = 1 THEN 'image' WHEN id % 5 = 2 THEN 'video' WHEN id % 5 = 3 THEN 'archive' ELSE 'other' END AS category FROM inbox")
simple("p7_media_kind", "inbox", lambda v: v.select("id", scalars.media_kind(scalars.extension(_path())).alias("kind"), scalars.media_kind(scalars.extension(_path()), False).alias("image_only")),
       "SELECT id, CASE id % 5 WHEN 1 THEN 'image' WHEN 2 THEN 'video' END AS kind, CASE id % 5 WHEN 1 THEN 'image' END AS image_only FROM inbox")
simple("p8_flags", "inbox", lambda v: v.select("id", scalars.is_temporary(scalars.file_name(_path())).alias("temporary"), scalars.is_hidden(F.concat(F.when(F.col("id") % 4 == 0, ".").otherwise(""), scalars.file_name(_path()))).alias("hidden"), scalars.is_recovery(F.concat(F.when(F.col("id") % 6 == 0, "/x/.Recovery").otherwise("/x"), _path())).alias("recovery")),
       "SELECT id, id % 5 = 4 AS temporary, id % 4 = 0 AS hidden, id % 6 = 0 AS recovery FROM inbox")
simple("p10_validate_name", "inbox", lambda v: v.select("id", scalars.validate_name(F.when(F.col("id") % 6 == 0, "con.txt").when(F.col("id") % 6 == 1, "a:b").when(F.col("id") % 6 == 2, "end.").when(F.col("id") % 6 == 3, F.repeat(F.lit("ñ"), 241)).otherwise(scalars.file_name(_path()))).alias("error")),
       "SELECT id, CASE WHEN id % 6 < 4 THEN 'INVALID_NAME' END AS error FROM inbox")
simple("p11_fold_text", "catalog", lambda v: v.select("doc_id", F.contains(scalars.fold_text("text"), F.lit("eau")).alias("has_eau"), F.contains(scalars.fold_text("text"), F.lit("ene")).alias("has_ene")),
       "SELECT doc_id, contains(strip_accents(lower(text)), 'eau') AS has_eau, contains(strip_accents(lower(text)), 'ene') AS has_ene FROM catalog")
simple("p12_format_size", "inbox", lambda v: v.select("id", scalars.format_size(F.when(F.col("id") % 10 == 0, None).otherwise((F.col("id") % 10) * 1024)).alias("size"), scalars.format_quantity(F.col("id"), "archivo", "archivos").alias("files")),
       "SELECT id, CASE WHEN id % 10 = 0 THEN '—' ELSE (id % 10) || ' KB' END AS size, replace(format('{:,}', id), ',', '.') || CASE WHEN id = 1 THEN ' archivo' ELSE ' archivos' END AS files FROM inbox")
simple("p13_ticks", "inbox", lambda v: v.select("id", scalars.ticks(F.when(F.col("id") % 5 == 0, "12x").otherwise(F.concat(F.lit("1341483892800"), F.lpad(F.col("id").cast("string"), 7, "0")))).cast("string").alias("ticks")),
       "SELECT id, CASE WHEN id % 5 <> 0 THEN '1341483892800' || lpad(CAST(id AS VARCHAR), 7, '0') END AS ticks FROM inbox")
simple("p13_date_change", "inbox", lambda v: v.select("id", scalars.date_change(F.when(F.col("id") % 5 == 0, "12x").otherwise(F.col("id").cast("string")), F.when(F.col("id") % 3 == 0, None).otherwise("77")).alias("c")).select("id", F.col("c.from").cast("string").alias("from_ticks"), F.col("c.to").cast("string").alias("to_ticks"), "c.error"),
       "SELECT id, CASE WHEN id % 3 <> 0 THEN '77' END AS from_ticks, CASE WHEN id % 5 <> 0 THEN CAST(id AS VARCHAR) END AS to_ticks, CASE WHEN id % 3 = 0 OR id % 5 = 0 THEN 'INVALID_DATE' END AS error FROM inbox")
simple("p14_digests", "catalog", lambda v: v.select("doc_id", scalars.content_digest(F.col("text").cast("binary")).alias("digest"), (F.count(F.lit(1)).over(Window.partitionBy(scalars.sample_digest(F.col("text").cast("binary"))))).alias("same_sample")),
       "SELECT doc_id, digest, count(*) OVER (PARTITION BY digest) AS same_sample FROM catalog")
VOCABULARY = ["the", "de", "der", "and", "la"]
VOCABULARY_SQL = "len(list_intersect(list_distinct(list_transform(list_slice(string_split_regex(text, '[^\\p{L}\\p{N}]'), 1, 2000), lambda x: lower(x))), ['the', 'de', 'der', 'and', 'la']))"
simple("p15_text_signals", "catalog", lambda v: v.select("doc_id", signals.term_count(F.col("text"), VOCABULARY).cast("long").alias("terms")), f"SELECT doc_id, CAST({VOCABULARY_SQL} AS BIGINT) AS terms FROM catalog")
# The real vocabularies, with a few of their words put into the texts.
_SAID = {"whatsapp": 2, "settings": 3, "meme": 4, "literal": 5, "factura": 6, "tax": 7}
_SAID_SQL = "text || " + " || ".join(f"CASE WHEN doc_id % {k} = 0 THEN ' {w}' ELSE '' END" for w, k in _SAID.items())


def _terms_sql(terms: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"CAST(len(list_intersect(list_distinct(list_transform(list_slice(string_split_regex({_SAID_SQL}, '[^\\p{{L}}\\p{{N}}]'), 1, 2000), lambda x: lower(x))), [{listed}])) AS BIGINT)"


def _signalled(v: DataFrame) -> DataFrame:
    text = F.concat(F.col("text"), *[F.when(F.col("doc_id") % k == 0, f" {w}").otherwise("") for w, k in _SAID.items()])
    cover = F.when(F.col("doc_id") % 3 == 0, float("nan")).when(F.col("doc_id") % 3 == 1, 1.5).otherwise(0.25)
    out = v.select("doc_id", signals.text_signals(text, F.col("doc_id"), F.col("doc_id") * 3, cover).alias("s")).select("doc_id", "s.*")
    return out.select("doc_id", "coverage", *[F.col(c).cast("long").alias(c) for c in ("line_count", "word_count", "screen", "meme", "document")])


simple("p15_text_signals_vocabularies", "catalog", _signalled,
       f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE 0.25 END::DOUBLE AS coverage, least(doc_id, 500) AS line_count, least(doc_id * 3, 2000) AS word_count, {_terms_sql(signals.SCREEN_TERMS)} AS screen, {_terms_sql(signals.MEME_TERMS)} AS meme, {_terms_sql(signals.DOCUMENT_TERMS)} AS document FROM catalog")


def _boosted(v: DataFrame) -> DataFrame:
    s = F.struct(F.lit(6).alias("line_count"), F.lit(30).alias("word_count"), F.lit(0.1).alias("coverage"), (F.col("id") % 3).alias("screen"), F.lit(2).alias("meme"), (F.col("id") % 2 * 2).alias("document"))
    scores = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(x).alias("score")) for c, x in (("screenshots", 0.2), ("documents", 0.3), ("memes", 0.25), ("other", 0.9))])
    out = v.select("id", F.explode(signals.boost_text_scores(scores, s, F.lit(600), F.lit(1200))).alias("c"))
    return out.select("id", "c.category", F.round("c.score", 6).alias("score"))


simple("p16_boost_scores", "media", _boosted, "SELECT id, t.category, round(t.score + CASE WHEN t.category = 'screenshots' AND id % 3 >= 1 THEN 0.04 WHEN t.category = 'documents' AND id % 2 = 1 THEN 0.035 WHEN t.category = 'memes' AND id % 3 = 0 AND id % 2 = 0 THEN 0.03 ELSE 0 END, 6) AS score FROM media, (VALUES ('screenshots', 0.2::DOUBLE), ('documents', 0.3::DOUBLE), ('memes', 0.25::DOUBLE), ('other', 0.9::DOUBLE)) t(category, score)")
simple("p17_image_views", "inbox", lambda v: v.select("id", F.posexplode(scalars.image_views((F.col("id") % 1000 + 1), F.lit(500))).alias("view", "v")).select("id", "view", "v.*"),
       "SELECT id, view, CASE view WHEN 0 THEN NULL WHEN 1 THEN (w - edge) // 2 WHEN 2 THEN 0 ELSE w - edge END::INT AS x, CASE view WHEN 0 THEN NULL WHEN 1 THEN (500 - edge) // 2 WHEN 2 THEN 0 ELSE 500 - edge END::INT AS y, CASE WHEN view > 0 THEN edge END::INT AS edge FROM (SELECT id, w, least(w, 500) AS edge, unnest(range(CASE WHEN greatest(w, 500) * 100 < least(w, 500) * 112 THEN 1 WHEN greatest(w, 500) * 100 >= least(w, 500) * 180 THEN 4 ELSE 2 END))::INT AS view FROM (SELECT id, id % 1000 + 1 AS w FROM inbox))")
simple("p18_frame_times", "inbox", lambda v: v.select("id", F.posexplode(scalars.frame_times(F.when(F.col("id") % 4 == 0, -1.0).when(F.col("id") % 4 == 1, None).otherwise(F.col("size") / 100.0))).alias("frame", "s")).select("id", "frame", F.round("s", 4).alias("second")),
       "SELECT id, frame::INT AS frame, round(CASE WHEN id % 4 < 2 THEN frame::DOUBLE ELSE [0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE][frame + 1] * (size / 100.0::DOUBLE) END, 4) AS second FROM (SELECT id, size, unnest(range(3)) AS frame FROM inbox)")
simple("p19_settings_key", "media", lambda v: v.select("id", F.min("id").over(Window.partitionBy(scalars.settings_key(F.lit("m1"), F.struct((F.col("id") % 3).alias("sensitivity")), F.col("digest")))).alias("first_alike")),
       "SELECT id, min(id) OVER (PARTITION BY id % 3, digest) AS first_alike FROM media")
simple("p20_valid_embedding", "media", lambda v: v.select("id", scalars.valid_embedding(F.col("embedding"), 64).alias("ok"), F.round(scalars.normalize(F.transform("embedding", lambda x: x * 3))[0], 5).alias("first")),
       "SELECT id, len(embedding) = 64 AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) BETWEEN 0.98 AND 1.02 AS ok, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first FROM media")

simple("p20_normalize", "media", lambda v: v.select("id", F.posexplode(scalars.normalize(F.transform("embedding", lambda x: x * 3))).alias("pos", "x")).select("id", "pos", F.round("x", 5).alias("x")),
       "SELECT id, (unnest(range(64)))::INT AS pos, round(unnest(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 5) AS x FROM media")

# ---- listing and filters
simple("s2_list_folder", "catalog", lambda v: browse.list_folder(v, "/lib/src0/en", "/lib").select("path", "size", "root", "parent"), "SELECT path, size, '/lib' AS root, '/lib/src0' AS parent FROM catalog WHERE source = 'src0' AND lang = 'en'")
simple("s3_scan_report_entries", "inbox", lambda v: browse.scan_report(v.select("path", scalars.media_kind(scalars.extension(_path())).alias("kind"), (F.col("id") % 9 != 0).alias("readable")), 100, 1000),
       "SELECT least(count(*) FILTER (id % 5 IN (1, 2) AND id % 9 <> 0), 100) AS kept, count(*) FILTER (id % 5 NOT IN (1, 2)) AS skipped, count(*) FILTER (id % 5 IN (1, 2) AND id % 9 = 0) AS unreadable, count(*) FILTER (id % 5 IN (1, 2) AND id % 9 <> 0) > 100 OR (SELECT count(*) FROM inbox) > 1000 AS truncated FROM (SELECT * FROM inbox ORDER BY path LIMIT 1000)")
simple("s3_scan_report", "inbox", lambda v: browse.scan_report(v.select("path", scalars.media_kind(scalars.extension(_path())).alias("kind"), (F.col("id") % 9 != 0).alias("readable")), 100),
       "SELECT least(count(*) FILTER (id % 5 IN (1, 2) AND id % 9 <> 0), 100) AS kept, count(*) FILTER (id % 5 NOT IN (1, 2)) AS skipped, count(*) FILTER (id % 5 IN (1, 2) AND id % 9 = 0) AS unreadable, count(*) FILTER (id % 5 IN (1, 2) AND id % 9 <> 0) > 100 AS truncated FROM inbox")
simple("f1_filter_files", "catalog", lambda v: browse.filter_files(v.withColumns({"hidden": F.col("doc_id") % 5 == 0, "category": F.lit("document")}), "document", "DÓC-1", ".TXT", False, 2000).select("path", "size"),
       "SELECT path, size FROM catalog WHERE doc_id % 5 <> 0 AND path LIKE '%/doc-1%' AND size >= 2000")
_ODD = lambda v: v.withColumns({"is_dir": F.col("doc_id") % 10 == 0, "size": F.when(F.col("doc_id") % 7 != 0, F.col("size"))})
simple("f2_sort_files", "catalog", lambda v: browse.placed_files(_ODD(v), "size", "desc").select("path", F.col("place").cast("long").alias("place")),
       "SELECT path, row_number() OVER (ORDER BY doc_id % 10 = 0 DESC, CASE WHEN doc_id % 7 <> 0 THEN size END DESC NULLS LAST, doc_id, path) AS place FROM catalog")
simple("f2_sort_files_by_name", "catalog", lambda v: browse.placed_files(_ODD(v)).select("path", F.col("place").cast("long").alias("place")), "SELECT path, row_number() OVER (ORDER BY doc_id % 10 = 0 DESC, doc_id, path) AS place FROM catalog")
simple("f3_filter_media", "media", lambda v: browse.filter_media(v.withColumns({"labels": F.array(F.struct("category")), "kind": F.lit("image")}), category="c3", status="uncertain", query="/M/").select("id"),
       "SELECT id FROM media WHERE label = 3 AND uncertain")
simple("f4_visible_media", "media", lambda v: browse.visible_media(v.withColumns({"labels": F.array(F.struct("category")), "kind": F.lit("image")}), v.where("id % 5 = 0").select("id")).select("id"),
       "SELECT id FROM media WHERE id % 5 <> 0 AND NOT protected")
simple("f5_select_media", "media", lambda v: browse.select_media(v, v.where("label = 2").select("id"), True).select("id"), "SELECT id FROM media WHERE label = 2 AND NOT protected")
query("f6_review_queue", f"{with_views('inbox')}, {RULES_SQL}, {MATCHED_SQL} SELECT path, status FROM matched WHERE status = 'needs-review' AND path LIKE '%order-1%'")(lambda s, d: browse.review_queue(rules.match_rules(view(s, d, "inbox"), RULES).withColumn("name", scalars.file_name(_path())), "Order-1").select("path", "status"))


def _roots(s: SparkSession, *r: str) -> DataFrame:
    return s.createDataFrame([(x,) for x in r], "root string")


query("f7_in_scope", f"{with_views('tree')} SELECT path, CASE WHEN NOT (r_name = 'ASIA' OR n_name = 'NATION_1') THEN 'FOLDER_NOT_AUTHORIZED' END AS error FROM tree")(lambda s, d: browse.in_scope(view(s, d, "tree").select("path"), view(s, d, "tree").where("r_name = 'ASIA' or n_name = 'NATION_1'").select(scalars.parent(_path()).alias("root")).distinct()))
simple("f8_page", "media", lambda v: browse.page(v, [F.col("id")], 2).select("id"), "SELECT id FROM media ORDER BY id LIMIT 36 OFFSET 72")
simple("f9_plan_issues", "journal", lambda v: browse.plan_issues(v.withColumns({"backup": F.col("kind") == "copy", "conflict": F.col("status") == "failed", "has_duplicates": F.col("bytes") > 40000})).select("operation_id", "sequence", "kind"),
       "SELECT operation_id, sequence, CASE WHEN bytes > 40000 THEN 'identical-content' ELSE 'name-conflict' END AS kind FROM journal WHERE kind <> 'copy' AND (status = 'failed' OR bytes > 40000)")
query("j17_attribute_root", f"{with_views('tree')} SELECT path, CASE WHEN n_name IN ('NATION_1', 'NATION_2') THEN '/' || r_name || '/' || n_name WHEN r_name = 'ASIA' THEN '/ASIA' END AS root FROM tree")(lambda s, d: browse.attribute_root(view(s, d, "tree").select("path"), view(s, d, "tree").where("n_name in ('NATION_1', 'NATION_2')").select(scalars.parent(_path()).alias("root")).distinct().union(_roots(s, "/ASIA"))))
query("j14_remap_paths", f"{with_views('tree')} SELECT DISTINCT CASE WHEN r_name = 'ASIA' THEN '/moved' || substr(path, 6) ELSE path END AS path FROM tree")(lambda s, d: browse.remap_paths(view(s, d, "tree"), s.createDataFrame([("/ASIA", "/moved"), ("/ASIA/NATION_1", "/other")], "source string, target string")))
query("u1_managed_roots", f"{with_views('catalog')} SELECT DISTINCT root FROM (SELECT '/lib/' || source AS root FROM catalog UNION ALL SELECT '/lib/' || source || '/' || lang FROM catalog)")(lambda s, d: browse.managed_roots(view(s, d, "catalog").select(scalars.parent(scalars.parent(_path()))), view(s, d, "catalog").select(scalars.parent(_path()))))
query("u2_collapse_roots", f"{with_views('tree')} SELECT '/' || r_name || '/' || n_name AS root FROM tree WHERE r_name <> 'ASIA' GROUP BY 1 UNION ALL SELECT '/ASIA'")(lambda s, d: browse.collapse_roots(view(s, d, "tree").select(scalars.parent(_path()).alias("root")).union(_roots(s, "/ASIA", "/asia"))))
query("u2_check_roots", f"{with_views('catalog')} SELECT CASE WHEN count(DISTINCT source || lang) NOT BETWEEN 1 AND 32 THEN 'INVALID_FOLDERS' END AS error FROM catalog")(lambda s, d: browse.check_roots(view(s, d, "catalog").select(scalars.parent(_path()).alias("root"))))
simple("u3_distinct_files", "catalog", lambda v: browse.distinct_files(v.select("path", F.col("digest").alias("identity"))).select("path", "action"),
       "SELECT path, CASE WHEN row_number() OVER (PARTITION BY digest ORDER BY path) = 1 THEN 'keep' ELSE 'skip' END AS action FROM catalog")
simple("u4_exclude", "media", lambda v: browse.exclude(v.where("label < 4").select("id"), v.where("id % 6 = 0").select("id")), "SELECT id FROM media WHERE label < 4 OR id % 6 = 0")
simple("u4_restore", "media", lambda v: browse.restore(v.where("label < 4").select("id"), v.where("id % 6 = 0").select("id")), "SELECT id FROM media WHERE label < 4 AND id % 6 <> 0")
_STAMPED = lambda v: v.withColumns({"size": F.col("id"), "modified_at": F.col("id"), "identity": F.col("path")})


def _guarded(v: DataFrame, drift: bool) -> DataFrame:
    v = _STAMPED(v)
    before, ids = v.where("protected").select("digest").distinct(), v.where("label = 1").select("id")
    now = v.withColumn("size", F.when(F.lit(drift) & (F.col("label") == 1), -1).otherwise(F.col("size")))
    return media.unchanged_or_none(media.set_protection(before, v, ids, True), before, v.join(ids, "id", "left_semi"), now)


simple("u5_set_protection_unchanged", "media", lambda v: _guarded(v, False), "SELECT DISTINCT digest FROM media WHERE protected OR label = 1")
simple("u5_set_protection_drifted", "media", lambda v: _guarded(v, True), "SELECT DISTINCT digest FROM media WHERE protected")
simple("u5_set_protection", "media", lambda v: media.set_protection(v.where("protected").select("digest").distinct(), v, v.where("label = 1").select("id"), True), "SELECT DISTINCT digest FROM media WHERE protected OR label = 1")
simple("u6_set_corrections", "media", lambda v: media.set_corrections(v.where("label = 0").select("digest", F.array(F.lit("people")).alias("categories")).distinct(), v, v.where("id % 3 = 0").select("id"), ["memes", "other"]).select("digest", F.array_join("categories", ",").alias("categories")),
       "SELECT DISTINCT digest, 'people' AS categories FROM media WHERE label = 0 AND digest NOT IN (SELECT digest FROM media WHERE id % 3 = 0) UNION ALL SELECT DISTINCT digest, 'memes,other' FROM media WHERE id % 3 = 0")
simple("u6_set_corrections_taught", "media", lambda v: media.set_corrections(v.where("label = 0").groupBy("digest").agg(F.min_by("embedding", "id").alias("embedding")).withColumns({"categories": F.array(F.lit("people")), "model": F.lit("old"), "mode": F.lit("fast")}), v, v.where("id % 3 = 0").select("id"), ["memes", "other"], "new", "thorough").select("digest", F.array_join("categories", ",").alias("categories"), F.round(F.col("embedding")[0], 5).alias("first"), "model", "mode"),
       "SELECT digest, 'people' AS categories, round(arg_min(embedding, id)[1], 5) AS first, 'old' AS model, 'fast' AS mode FROM media WHERE label = 0 AND digest NOT IN (SELECT digest FROM media WHERE id % 3 = 0) GROUP BY digest UNION ALL SELECT digest, 'memes,other', round(arg_min(embedding, id)[1], 5), 'new', 'thorough' FROM media WHERE id % 3 = 0 GROUP BY digest")
simple("u7_clear_corrections", "media", lambda v: media.clear_corrections(v.withColumns({"baseline": F.struct(F.array("category").alias("categories"), F.col("uncertain").alias("uncertain")), "categories": F.array(F.lit("people"))})).select("id", F.col("categories")[0].alias("category"), "uncertain", "corrected", "protected"),
       "SELECT id, category, uncertain, false AS corrected, protected FROM media")


# ---- sources


@query("s1_scan_catalog", "SELECT source, lang, true AS held, 'parquet' AS extension, false AS hidden FROM documents GROUP BY source, lang")
def s1(s, d):
    """The documents as files in a folder tree, found again by scanning it."""
    from curatrix.operators.tables import new_folder

    where = new_folder(s)
    s.read.parquet(f"{d}/documents.parquet").select("source", "lang", "text").repartition("source", "lang").write.partitionBy("source", "lang").parquet(where)
    found = catalog.scan_catalog(s, [where], glob="*.parquet").withColumns({c: F.regexp_extract("path", f"/{c}=([^/]+)/", 1) for c in ("source", "lang")})
    return found.groupBy("source", "lang", "extension", "hidden").agg((F.sum("size") > 0).alias("held"))


# Of three: a PNG, a GIF and something else; none has more than its header.
@query("s7_image_heads", "SELECT path, CASE k WHEN 0 THEN 'png' WHEN 1 THEN 'gif' END AS format, CASE WHEN k < 2 THEN w END AS width, CASE WHEN k < 2 THEN h END AS height, CASE WHEN k = 2 THEN 'UNSUPPORTED_IMAGE' WHEN w > 16384 OR w * h > 40000000 THEN 'IMAGE_TOO_LARGE' END AS error FROM (SELECT '/m/' || vec_id AS path, vec_id % 3 AS k, vec_id * 97 % 20000 + 1 AS w, vec_id * 131 % 9000 + 1 AS h FROM embeddings)")
def s7(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", (F.col("vec_id") * 97 % 20000 + 1).alias("w"), (F.col("vec_id") * 131 % 9000 + 1).alias("h"))
    wide = lambda c: F.lpad(F.hex(c), 8, "0")
    little = lambda c: F.concat(F.lpad(F.hex(c % 256), 2, "0"), F.lpad(F.hex(F.floor(c / 256)), 2, "0"))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), wide(F.col("w")), wide(F.col("h")), F.lit("0802000000"))
    gif = F.concat(F.lit("474946383961"), little(F.col("w")), little(F.col("h")), F.lit("0000"))
    content = F.unhex(F.when(F.col("vec_id") % 3 == 0, png).when(F.col("vec_id") % 3 == 1, gif).otherwise(F.lit("00112233445566778899AABBCC")))
    return heads.image_heads(e.select(F.concat(F.lit("/m/"), F.col("vec_id").cast("string")).alias("path"), F.octet_length(content).cast("long").alias("size"), content.alias("content"))).select("path", "format", "width", "height", "error")


# ---- rules
query("j1_match_rules", f"{with_views('inbox')}, {RULES_SQL}, {MATCHED_SQL} SELECT id, status, error, rule_id, destination, date_source, date_used FROM matched")(lambda s, d: rules.match_rules(view(s, d, "inbox"), RULES).select("id", "status", "error", "rule_id", "destination", "date_source", "date_used"))


@query("j2_validate_rules", "WITH r AS (SELECT n_nationkey AS k, DATE '2000-01-01' + CAST(n_nationkey * 10 AS INT) AS f, DATE '2000-01-01' + CAST(n_nationkey * 10 + CASE WHEN n_nationkey % 5 = 0 THEN 12 ELSE 5 END AS INT) AS l FROM nation) SELECT 'r' || a.k AS id, CASE WHEN EXISTS (SELECT 1 FROM r b WHERE a.k <> b.k AND a.f <= b.l AND a.l >= b.f) THEN 'RULE_CONFLICT' END AS error FROM r a")
def j2(s, d):
    n = s.read.parquet(f"{d}/nation.parquet")
    day = lambda x: F.date_add(F.lit("2000-01-01").cast("date"), x.cast("int")).cast("string")
    k = F.col("n_nationkey")
    return rules.validate_rules(n.select(F.concat(F.lit("r"), k).alias("id"), F.col("n_name").alias("name"), day(k * 10).alias("start_date"), day(k * 10 + F.when(k % 5 == 0, 12).otherwise(5)).alias("end_date"), F.lit(True).alias("enabled")))


query("j3_assign_presets", f"{with_views('inbox')}, {RULES_SQL}, {MATCHED_SQL} SELECT id, CASE rule_id WHEN 'p1' THEN 'main' WHEN 'c1' THEN 'plain' ELSE 'main' END AS preset_id FROM matched")(lambda s, d: rules.assign_presets(rules.match_rules(view(s, d, "inbox"), RULES), RULE_PRESETS, "main").select("id", "preset_id"))
simple("w1_plan_counter", "inbox", lambda v: rules.plan_counter(v.select("path")).select("path", F.col("counter").cast("long").alias("counter")), "SELECT path, row_number() OVER (ORDER BY path) AS counter FROM inbox")
query("a5_rule_counts", f"{with_views('inbox')}, {RULES_SQL}, {MATCHED_SQL} SELECT r.id AS rule_id, count(m.id) AS files FROM rules r LEFT JOIN matched m ON m.rule_id = r.id GROUP BY 1")(lambda s, d: rules.rule_counts(rules.match_rules(view(s, d, "inbox"), RULES), RULES))
query("a5_inbox_counts", f"{with_views('inbox')}, {RULES_SQL}, {MATCHED_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'matched') AS matched, 0::BIGINT AS waiting, count(*) FILTER (status <> 'matched') AS unmatched FROM matched")(lambda s, d: rules.inbox_counts(rules.match_rules(view(s, d, "inbox"), RULES)))
_STEM = rf"regexp_extract({NAME}, '^(.+)\.[^.]*$', 1)"
_SUFFIX = rf"regexp_extract({NAME}, '^.+(\.[^.]*)$', 1)"
NAMED_SQL = f"{with_views('inbox')}, {RULES_SQL}, {MATCHED_SQL}, counted AS (SELECT *, row_number() OVER (ORDER BY path) AS counter FROM matched WHERE status = 'matched'), named AS (SELECT *, CASE WHEN rule_id = 'c1' THEN replace(upper(strftime(date_used, '%Y%m%d') || ' ' || {_STEM}), ' ', '_') ELSE replace(lower(rule_name || '_' || strftime(date_used, '%Y-%m-%d') || '_' || {_STEM} || ' ' || CASE WHEN counter < 1000 THEN lpad(CAST(counter AS VARCHAR), 4, '0') ELSE CAST(counter AS VARCHAR) END), ' ', '-') END || {_SUFFIX} AS new_name FROM counted)"
query("p9_render_name", f"{NAMED_SQL} SELECT path, new_name FROM named")(lambda s, d: resolve.named_targets(view(s, d, "inbox"), RULES, PRESETS, RULE_PRESETS, "main").select("path", "new_name"))


def _named(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The named files, and a library in which half of their targets are taken already."""
    named = resolve.named_targets(view(s, d, "inbox"), RULES, PRESETS, RULE_PRESETS, "main")
    return named, named.where("id % 2 = 0").select(F.col("destination_path").alias("path"), "digest")


# Half of the targets are in the library, with the contents of the files that want them; contents are shared by files of one id modulo 900.
FIRST_SQL = "row_number() OVER (PARTITION BY id % 900 ORDER BY counter) = 1"
B1_SQL = f"{NAMED_SQL}, b1 AS (SELECT *, {FIRST_SQL} AS leads, destination || '/' || new_name AS target FROM named)"


@query("b1_plan_organization", f"{B1_SQL} SELECT counter AS seq, path AS source, target AS destination, size, rule_id, CASE WHEN id % 2 = 1 AND leads THEN 'move' ELSE 'skip' END AS action, false AS backup, id % 2 = 0 AS conflict, NULL::VARCHAR AS error FROM b1")
def b1(s, d):
    return resolve.plan_named(*_named(s, d))


@query("b1_plan_organization_keep_both", f"{NAMED_SQL} SELECT counter AS seq, path AS source, destination || '/' || CASE WHEN id % 2 = 0 THEN regexp_extract(new_name, '^(.+)\\.[^.]*$', 1) || ' (1)' || regexp_extract(new_name, '^.+(\\.[^.]*)$', 1) ELSE new_name END AS destination, size, rule_id, 'move' AS action, false AS backup, id % 2 = 0 AS conflict, NULL::VARCHAR AS error FROM named")
def b1_keep_both(s, d):
    return resolve.plan_named(*_named(s, d), "keep-both", "keep-both")


@query("b1_copies", f"{B1_SQL} SELECT counter AS seq, path AS source, target AS destination, size, rule_id, 'move' AS action, false AS backup, id % 2 = 0 AS conflict, CASE WHEN NOT leads THEN 'DUPLICATE_ACTION_UNAVAILABLE' END AS error FROM b1 UNION ALL SELECT l.counter, c.target, c.destination || '/.recovery/' || l.counter || '-' || c.new_name, l.size, l.rule_id, 'move', true, false, NULL FROM b1 l JOIN b1 c ON l.leads AND l.id % 2 = 0 AND c.id % 900 = l.id % 900")
def b1_copies(s, d):
    return resolve.plan_named(*_named(s, d), "replace", "keep-incoming")


query("b1_plan_header", f"{with_views('inbox')}, {RULES_SQL}, {MATCHED_SQL} SELECT count(*) FILTER (status = 'matched') AS items, count(*) FILTER (status <> 'matched') AS unmatched, NULL::VARCHAR AS error FROM matched")(lambda s, d: resolve.plan_header(rules.match_rules(view(s, d, "inbox"), RULES)))
query("a4_organization_totals", f"{B1_SQL} SELECT count(*) FILTER (id % 2 = 1 AND leads) AS moves, CAST(sum(size) FILTER (id % 2 = 1 AND leads) AS BIGINT) AS bytes, count(*) FILTER (id % 2 = 0 OR NOT leads) AS kept, count(*) FILTER (id % 2 = 0) AS conflicts FROM b1")(lambda s, d: resolve.organization_totals(b1(s, d)))
simple("a3_plan_summary", "journal", lambda v: resolve.plan_summary(v.select("source", "destination", F.col("kind").alias("action"), F.when(F.col("entry_kind") == "folder", "mkdir").otherwise("file").alias("kind"), (F.col("status") == "skipped").alias("backup"), (F.col("status") == "failed").alias("conflict"))),
       "SELECT count(*) FILTER (status <> 'skipped' AND entry_kind <> 'folder') AS files, count(*) FILTER (status <> 'skipped' AND entry_kind <> 'folder') AS renamed, count(*) FILTER (status <> 'skipped' AND entry_kind <> 'folder' AND kind = 'move') AS move, count(*) FILTER (status <> 'skipped' AND entry_kind <> 'folder' AND kind = 'copy') AS copy, count(*) FILTER (status = 'failed') AS conflicts, count(*) FILTER (status = 'skipped') AS backups, count(*) FILTER (entry_kind = 'folder') AS folders FROM journal")

# ---- duplicates
simple("a1_duplicate_groups", "catalog", dedup.duplicate_groups, "SELECT * FROM (SELECT digest, path, count(*) OVER (PARTITION BY digest) AS n, row_number() OVER (PARTITION BY digest ORDER BY path) AS place FROM catalog) WHERE n > 1")
PAIR_RULE = "SELECT a.digest, a.path AS left_path, b.path AS right_path, a.n > {k} AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY path) AS rn, count(*) OVER (PARTITION BY digest) AS n FROM catalog) a JOIN (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY path) AS rn FROM catalog) b ON a.digest = b.digest AND a.rn < b.rn AND (n <= {k} OR a.rn = 1 OR b.rn = a.rn + 1)"
simple("a2_duplicate_pairs", "catalog", dedup.duplicate_pairs, PAIR_RULE.format(k=200))
simple("a2_duplicate_pairs_truncated", "catalog", lambda v: dedup.duplicate_pairs(v, 3), PAIR_RULE.format(k=3))
simple("w6_representatives", "catalog", lambda v: dedup.representatives(v), "SELECT digest, min(path) AS path, count(*) AS copies FROM catalog GROUP BY digest")
simple("j4_find_duplicates", "catalog", lambda v: (lambda w: dedup.find_duplicates(w.where("source = 'src1'"), w))(v.withColumn("sample", scalars.sample_digest(F.col("text").cast("binary")))), "SELECT a.path AS incoming_path, b.path AS library_path, a.digest FROM catalog a JOIN catalog b ON a.size = b.size AND a.digest = b.digest WHERE a.source = 'src1' AND b.source <> 'src1'")
PAIRS_SQL = "pairs AS (SELECT a.digest, a.path AS left_path, b.path AS right_path FROM catalog a JOIN catalog b ON a.digest = b.digest AND a.path < b.path)"


def _pairs(v: DataFrame, later: int = 0) -> DataFrame:
    """Pairs of copies with what their signature tells of both files; later: by how much the files under /en/src1 have changed."""
    p = dedup.duplicate_pairs(v, 1_000_000).drop("truncated")
    told = {f"{side}_{c}": x for side in ("left", "right") for c, x in (("digest", F.col("digest")), ("size", F.length(f"{side}_path")), ("modified_at", F.when(F.col(f"{side}_path").contains("/src1/"), later).otherwise(0)), ("identity", F.lit(None)), ("created_ticks", F.lit("1")), ("modified_ticks", F.lit("2")))}
    return dedup.pair_signature(p.withColumns(told))


SIGNED_SQL = "signed AS (SELECT *, sha256(CASE WHEN l < r THEN l || chr(10) || r ELSE r || chr(10) || l END) AS signature FROM (SELECT *, lower(left_path) || '|' || length(left_path) || '|0|' || digest || '||1|2' AS l, lower(right_path) || '|' || length(right_path) || '|0|' || digest || '||1|2' AS r FROM pairs))"
query("j10_drop_dismissed", f"{with_views('catalog')}, {PAIRS_SQL} SELECT left_path, right_path FROM pairs WHERE left_path NOT LIKE '%/en/%' OR left_path LIKE '%/src1/%' OR right_path LIKE '%/src1/%'")(lambda s, d: dedup.drop_dismissed(_pairs(view(s, d, "catalog"), 1), _pairs(view(s, d, "catalog")).where("left_path like '%/en/%'")).select("left_path", "right_path"))
query("j10_ignored_count", f"{with_views('catalog')}, {PAIRS_SQL} SELECT count(*) AS ignored FROM pairs WHERE left_path LIKE '%/en/%'")(lambda s, d: dedup.ignored_count(_pairs(view(s, d, "catalog")), _pairs(view(s, d, "catalog")).where("left_path like '%/en/%'")))
query("u8_dismiss", f"{with_views('catalog')}, {PAIRS_SQL}, {SIGNED_SQL} SELECT DISTINCT signature FROM signed")(lambda s, d: dedup.dismiss(_pairs(view(s, d, "catalog")).where("left_path like '%/en/%'"), _pairs(view(s, d, "catalog"))))
def _stored(s: SparkSession, schema: str, *changes) -> DataFrame:
    """A store after some changes, each a version of its own."""
    from curatrix.operators.tables import new_folder

    store = stores.Store(s, new_folder(s), schema)
    for how in changes:
        store.change(how)
    return store.read()[0]


query("u5_stored_protection", f"{with_views('media')} SELECT DISTINCT digest FROM media WHERE (protected OR label = 1) AND digest NOT IN (SELECT digest FROM media WHERE label = 2)")(
    lambda s, d: (lambda v: _stored(s, stores.MARKS, lambda r: v.where("protected").select("digest").distinct(), lambda r: media.set_protection(r, v, v.where("label = 1").select("id"), True), lambda r: media.set_protection(r, v, v.where("label = 2").select("id"), False)))(view(s, d, "media"))
)
query("u8_stored_dismissals", f"{with_views('catalog')}, {PAIRS_SQL}, {SIGNED_SQL} SELECT DISTINCT signature FROM signed")(
    lambda s, d: _stored(s, stores.DISMISSED, lambda r: dedup.dismiss(r, _pairs(view(s, d, "catalog")).where("left_path like '%/en/%'")), lambda r: dedup.dismiss(r, _pairs(view(s, d, "catalog"))))
)


query("b5_check_retirement", f"{with_views('catalog')} SELECT path, CASE WHEN doc_id % 9 = 0 THEN 'FILE_CHANGED' WHEN digest IN (SELECT digest FROM catalog WHERE doc_id % 5 = 0 AND doc_id % 9 <> 0) THEN 'MEDIA_PROTECTED' END AS error FROM catalog")(
    lambda s, d: (lambda v: dedup.check_retirement(v.select("path"), v.where("doc_id % 9 <> 0"), v.where("doc_id % 5 = 0 and doc_id % 9 <> 0").select("digest")))(view(s, d, "catalog"))
)
query("b5_retire_pair", f"{with_views('catalog')}, {PAIRS_SQL} SELECT left_path, right_path FROM pairs WHERE left_path <> '/lib/src0/en/doc-0.txt' AND right_path <> '/lib/src0/en/doc-0.txt'")(lambda s, d: dedup.retire_pair(_pairs(view(s, d, "catalog")), "\\LIB\\src0\\en\\doc-0.txt").select("left_path", "right_path"))
simple("b4_plan_cleanup", "catalog", lambda v: dedup.plan_cleanup(v, dedup.representatives(v).select("digest", "path")), "SELECT digest, path, keeper, 'move' AS action, true AS backup, NULL::VARCHAR AS error FROM (SELECT digest, path, min(path) OVER (PARTITION BY digest) AS keeper FROM catalog) WHERE path <> keeper")


_BITS_SQL = "list_sum([CASE WHEN {} THEN (CASE WHEN i = 63 THEN -9223372036854775808 ELSE (1::BIGINT << i) END)::HUGEINT ELSE 0 END FOR i IN range(64)])::BIGINT"
PRINTS_SQL = f"o AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor((x + 1) * 127.5) AS INT)) AS p FROM embeddings), g AS (SELECT vec_id::VARCHAR AS digest, 1 + label * 0.03::DOUBLE AS aspect, p FROM o UNION ALL SELECT 'copy ' || vec_id, (1 + label * 0.03::DOUBLE) * CASE WHEN vec_id % 3 = 0 THEN 1.05::DOUBLE ELSE 1.01::DOUBLE END, [CASE WHEN (i - 1) % 9 = vec_id % 9 THEN (p[i] + 40) % 256 ELSE p[i] END FOR i IN range(1, 65)] FROM o), h AS (SELECT digest, aspect, list_slice(p, 1, 12) AS colors, {_BITS_SQL.format('p[i // 8 * 8 + i % 8 + 1] > p[i // 8 * 8 + (i % 8 + 1) % 8 + 1]')} AS dhash, {_BITS_SQL.format('p[i + 1] > 127')} AS phash FROM g)"
SIMILAR_SQL = f"WITH {PRINTS_SQL} SELECT a.digest AS left_digest, b.digest AS right_digest, bit_count(xor(a.phash, b.phash))::INT AS phash_bits, bit_count(xor(a.dhash, b.dhash))::INT AS dhash_bits FROM h a JOIN h b ON a.digest < b.digest AND bit_count(xor(a.phash, b.phash)) <= 16 AND bit_count(xor(a.dhash, b.dhash)) <= 14 AND abs(a.aspect - b.aspect) / greatest(a.aspect, b.aspect) <= 0.04 AND list_sum([abs(a.colors[i] - b.colors[i]) FOR i IN range(1, 13)]) <= 24 * 12"


def _prints(s: SparkSession, d: str) -> DataFrame:
    """Prints of the embeddings as 8 x 8 grey images, each row's end beside its start, and of a copy of each with some points changed and another shape; the shape goes by the label."""
    e = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", (1 + F.col("label") * F.lit(0.03)).alias("aspect"), F.transform("embedding", lambda x: F.floor((x + 1) * 127.5).cast("int")).alias("p"))
    other = F.transform("p", lambda x, i: F.when(i % 9 == F.col("vec_id") % 9, (x + 40) % 256).otherwise(x))
    copies = e.select(F.concat(F.lit("copy "), F.col("vec_id").cast("string")).alias("digest"), (F.col("aspect") * F.when(F.col("vec_id") % 3 == 0, 1.05).otherwise(1.01)).alias("aspect"), other.alias("p"))
    e = e.select(F.col("vec_id").cast("string").alias("digest"), "aspect", "p").union(copies)
    wide = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.concat(F.slice("p", y * 8 + 1, F.lit(8)), F.slice("p", y * 8 + 1, F.lit(1)))))
    light = [F.shiftleft((F.col("p")[i] > 127).cast("long"), i) for i in range(64)]
    return e.select("digest", dedup.dhash_bits(wide).alias("dhash"), reduce(Column.bitwiseOR, light).alias("phash"), "aspect", F.slice("p", 1, 12).alias("colors"))


def _similar(s: SparkSession, d: str, **more) -> DataFrame:
    found = dedup.similar_images(_prints(s, d), **more)
    return found.withColumns({c: F.col(c).cast("int") for c in ("phash_bits", "dhash_bits")})


query("j11_similar_images", SIMILAR_SQL)(_similar)
query("j11_similar_images_banded", SIMILAR_SQL)(lambda s, d: _similar(s, d, banded_rows=8))


# ---- journals
simple("s4_read_journal", "journal", lambda v: journal.read_journal(v.select("operation_id", "sequence", F.to_json(F.struct("source", "destination", "status", F.when(F.col("kind") != "move", F.col("kind")).alias("kind"), "bytes")).alias("payload"))).select("operation_id", "sequence", "source", "status", "kind", "entry_kind", "bytes"),
       "SELECT operation_id, sequence, source, status, kind, 'file' AS entry_kind, bytes FROM journal")
simple("s5_journal_rows", "journal", lambda v: journal.read_journal(journal.journal_rows(v.select((F.col("operation_id") * 1000 + F.col("sequence")).alias("seq"), F.col("kind").alias("action"), "source", "destination", "bytes"), "op")).select("operation_id", "sequence", "source", "destination", "status", "kind", "entry_kind", "bytes"),
       "SELECT 'op' AS operation_id, operation_id * 1000 + sequence AS sequence, source, destination, CASE WHEN kind = 'skip' THEN 'skipped' ELSE 'planned' END AS status, kind, 'file' AS entry_kind, bytes FROM journal")
simple("a6_operation_status", "journal", lambda v: journal.operation_status(v), "SELECT operation_id, CASE WHEN bool_or(status = 'recovery-required') THEN 'recovery-required' WHEN bool_or(status IN ('failed', 'cancelled') OR error IS NOT NULL) THEN 'partial' WHEN bool_or(status = 'undone') AND bool_and(status IN ('undone', 'skipped')) THEN 'undone' ELSE 'completed' END AS status FROM journal GROUP BY 1")
simple("a7_batch_totals", "journal", lambda v: journal.batch_totals(v), "SELECT operation_id, count(*) AS items, CAST(coalesce(sum(bytes) FILTER (kind NOT IN ('skip', 'dates')), 0) AS BIGINT) AS bytes, CAST(coalesce(sum(bytes) FILTER (kind NOT IN ('skip', 'dates') AND status = 'completed'), 0) AS BIGINT) AS completed_bytes, count(*) FILTER (status = 'completed') AS undoable, CASE WHEN bool_or(kind = 'move') THEN 'move' ELSE 'copy' END AS kind FROM journal GROUP BY 1")
simple("w2_progress", "journal", lambda v: journal.progress(v), "SELECT operation_id, sequence, CAST(sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS completed, CAST(sum(CASE WHEN status = 'completed' THEN bytes ELSE 0 END) OVER w AS BIGINT) AS completed_bytes FROM journal WINDOW w AS (PARTITION BY operation_id ORDER BY sequence ROWS UNBOUNDED PRECEDING)")
query("w5_recent_operations", f"{with_views('journal', 'operations')} SELECT o.operation_id, o.created_at, string_agg(status, ',' ORDER BY sequence) AS statuses FROM (SELECT * FROM operations ORDER BY created_at DESC, operation_id DESC LIMIT 100) o LEFT JOIN journal j USING (operation_id) GROUP BY 1, 2")(lambda s, d: journal.recent_operations(view(s, d, "operations"), view(s, d, "journal")))
query("j12_incomplete_operations", f"{with_views('journal', 'operations')} SELECT operation_id, created_at FROM operations WHERE operation_id IN (SELECT operation_id FROM journal WHERE status = 'planned')")(lambda s, d: journal.incomplete_operations(view(s, d, "operations"), view(s, d, "journal")))
query("j13_pending_references", f"{with_views('journal', 'operations')} SELECT operation_id, created_at FROM operations WHERE operation_id IN (SELECT operation_id FROM journal WHERE entry_kind = 'folder' AND status IN ('completed', 'undone')) AND operation_id % 3 <> 0")(lambda s, d: journal.pending_reference_changes(view(s, d, "operations"), view(s, d, "journal").withColumn("kind", F.when(F.col("entry_kind") == "folder", "rmdir").otherwise(F.col("kind"))), view(s, d, "operations").where("operation_id % 3 = 0").select("operation_id")))
simple("j15_detect_drift", "catalog", lambda v: (lambda w: journal.detect_drift(w, w.where("doc_id % 7 <> 0").withColumn("digest", F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.col("digest")))))(v.withColumns({"modified_at": F.col("doc_id"), "identity": _path()})),
       "SELECT path, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 'FILE_CHANGED' END AS error FROM catalog")
# A file that two items took from one place goes back with the later one; the earlier then finds the place taken.
UNDO_SQL = f"{with_views('journal')}, c AS (SELECT *, split_part(substr(destination, 6), '-', 1)::BIGINT % 3 = 0 AS gone FROM journal WHERE status = 'completed') SELECT operation_id, sequence, row_number() OVER (PARTITION BY operation_id ORDER BY sequence DESC)::INT AS undo_order, CASE WHEN kind = 'copy' THEN '.recovery/' || destination ELSE source END AS undo_to, CASE WHEN gone THEN 'FILE_CHANGED' WHEN kind <> 'copy' AND EXISTS (SELECT 1 FROM c l WHERE l.operation_id = c.operation_id AND l.source = c.source AND l.kind <> 'copy' AND l.sequence > c.sequence) THEN 'DESTINATION_EXISTS' END AS error FROM c"
_THERE = lambda v, k: v.where(f"cast(regexp_extract(source, '([0-9]+)', 1) as bigint) % {k}").select(F.col("destination").alias("path"), "digest").distinct()
query("b8_plan_undo", UNDO_SQL)(lambda s, d: journal.plan_undo(view(s, d, "journal"), _THERE(view(s, d, "journal"), "3 <> 0")))


def _journalled(s: SparkSession, d: str, status) -> DataFrame:
    """The journal view as a plan that was written twice and then brought to the given status, as a journal on disk has it."""
    from curatrix.operators.tables import new_folder

    v, where = view(s, d, "journal"), new_folder(s)
    # What the run is to make of an item is in the item from the start, in fields that it doesn't use.
    plan = v.select("operation_id", F.col("sequence").alias("seq"), F.col("kind").alias("action"), "source", "destination", "bytes", "digest", "entry_kind", status.alias("new_value"), F.col("error").alias("old_value"))
    for _ in range(2):
        journal.write_journal(plan, None, where, "lineitem")
    ran = journal.load_journal(s, where).withColumns({"status": F.col("new_value"), "error": F.col("old_value")}).withColumns({c: F.lit(None).cast("string") for c in ("new_value", "old_value")})
    for _ in range(2):
        journal.update_journal(ran, where, "lineitem", 1)
    return journal.load_journal(s, where)


query("b8_round_trip", UNDO_SQL)(lambda s, d: journal.plan_undo(_journalled(s, d, F.col("status")), _THERE(view(s, d, "journal"), "3 <> 0")))
query("s5_round_trip", f"{with_views('journal')} SELECT operation_id, sequence, source, destination, status, kind, entry_kind, error, bytes, digest FROM journal")(lambda s, d: _journalled(s, d, F.col("status")).select("operation_id", "sequence", "source", "destination", "status", "kind", "entry_kind", "error", "bytes", "digest"))


@query("b8_chains", f"{with_views('journal')} SELECT operation_id, sequence, row_number() OVER (PARTITION BY operation_id ORDER BY sequence DESC)::INT AS undo_order, '/p/' || operation_id || '-' || sequence AS undo_to, CASE WHEN operation_id % 3 = 0 THEN 'FILE_CHANGED' END AS error FROM journal")
def b8_chains(s, d):
    """Each operation moved one file on and on; of every third the file is gone."""
    at = lambda k: F.concat(F.lit("/p/"), F.col("operation_id").cast("string"), F.lit("-"), k.cast("string"))
    v = view(s, d, "journal").select("operation_id", "sequence", at(F.col("sequence")).alias("source"), at(F.col("sequence") + 1).alias("destination"), F.lit("completed").alias("status"), F.lit("move").alias("kind"), F.col("operation_id").cast("string").alias("digest"))
    last = v.where("operation_id % 3 <> 0").groupBy("operation_id").agg(F.max_by("destination", "sequence").alias("path")).select("path", F.col("operation_id").cast("string").alias("digest"))
    return journal.plan_undo(v, last)


RECOVER_SQL = f"{with_views('journal')} SELECT operation_id, sequence, 'failed' AS status, 'INTERRUPTED_OPERATION' AS error FROM journal WHERE status = 'planned' UNION ALL SELECT operation_id, sequence, CASE WHEN entry_kind = 'folder' THEN 'recovery-required' WHEN split_part(substr(destination, 6), '-', 1)::BIGINT % 2 = 0 THEN 'completed' ELSE 'recovery-required' END, CASE WHEN entry_kind <> 'folder' AND split_part(substr(destination, 6), '-', 1)::BIGINT % 2 = 0 THEN NULL ELSE 'INTERRUPTED_OPERATION' END FROM journal WHERE status = 'failed'"
query("b9_recover_journal", RECOVER_SQL)(lambda s, d: journal.recover_journal(view(s, d, "journal").withColumn("status", _begun()), _THERE(view(s, d, "journal"), "2 = 0")))
query("b9_round_trip", RECOVER_SQL)(lambda s, d: journal.recover_journal(_journalled(s, d, _begun()), _THERE(view(s, d, "journal"), "2 = 0")))


def _begun():
    return F.when(F.col("status") == "failed", "pending").otherwise(F.col("status"))


_FIX = lambda v: journal.plan_date_fix(v.select("path", F.concat(F.lit("/i/"), F.col("digest")).alias("identity"), F.when(F.col("id") % 5 == 0, "0").otherwise((F.col("id") + 10).cast("string")).alias("created_ticks"), F.when(F.col("id") % 4 == 0, (F.col("id") + 10).cast("string")).otherwise("99999999").alias("modified_ticks")))
FIX_SQL = "fixed AS (SELECT path, id % 5 = 0 AS none, id % 5 = 0 OR id % 4 = 0 OR row_number() OVER (PARTITION BY digest ORDER BY path) > 1 AS skip, id FROM inbox)"
query("b7_plan_date_fix", f"{with_views('inbox')}, {FIX_SQL} SELECT path, CASE WHEN skip THEN 'skip' ELSE 'dates' END AS action, CASE WHEN none THEN 'INVALID_DATE' END AS error, CASE WHEN NOT skip THEN CAST(id + 10 AS VARCHAR) END AS new_ticks FROM fixed")(lambda s, d: _FIX(view(s, d, "inbox")))
query("a14_date_fix_counts", f"{with_views('inbox')}, {FIX_SQL} SELECT count(*) FILTER (NOT skip) AS changes, count(*) FILTER (skip) AS skipped FROM fixed")(lambda s, d: journal.date_fix_counts(_FIX(view(s, d, "inbox"))))
# ---- media
CATS = [f"c{k}" for k in range(10)]
PROTO_SQL = "unit AS (SELECT category, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS x FROM media), sums AS (SELECT category, pos, sum(x) AS x FROM unit GROUP BY 1, 2), raw AS (SELECT category, list(x ORDER BY pos) AS v FROM sums GROUP BY 1), proto AS (SELECT category, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM raw)"


def _proto(v: DataFrame) -> DataFrame:
    return media.category_prototypes(v.select("category", F.col("embedding").alias("vector")))


def _scored(v: DataFrame) -> DataFrame:
    return media.category_scores(v, _proto(v))


query("a8_prototypes", f"{with_views('media')}, {PROTO_SQL} SELECT category, (unnest(range(64)))::INT AS pos, round(unnest(v), 6) AS x FROM proto")(lambda s, d: _proto(view(s, d, "media")).select("category", F.posexplode("vector").alias("pos", "x")).select("category", "pos", F.round("x", 6).alias("x")))
SCORE_SQL = f"{with_views('media')}, {PROTO_SQL}, scored AS (SELECT id, p.category, greatest(least(list_inner_product(embedding::DOUBLE[], p.v), 1), 0) AS score FROM media, proto p)"
query("a12_category_scores", f"{SCORE_SQL} SELECT id, category, round(score, 6) AS score FROM scored")(lambda s, d: _scored(view(s, d, "media")).select("id", F.explode("scores").alias("s")).select("id", "s.category", F.round("s.score", 6).alias("score")))
query("a13_decide_labels", f"{SCORE_SQL}, ranked AS (SELECT id, list(category ORDER BY score DESC, category) AS c, list(score ORDER BY score DESC, category) AS s FROM scored GROUP BY id) SELECT id, CASE WHEN s[1] < 0.225 THEN 'other' ELSE array_to_string(list_slice(list_filter(c, lambda x, i: s[i] >= 0.225 AND s[i] >= s[1] - 0.025), 1, 3), ',') END AS categories, s[1] < 0.24 OR s[1] - s[2] < 0.018 AS uncertain FROM ranked")(lambda s, d: media.label(_scored(view(s, d, "media")).drop("uncertain", "category"), "balanced", CATS).select("id", F.array_join("categories", ",").alias("categories"), "uncertain"))
query("a9_merge_view_scores", f"{SCORE_SQL} SELECT id // 4 AS file, category, round(CASE WHEN count(*) > 1 THEN 0.8 * max(score) FILTER (id % 4 = 0) + 0.1 * avg(score) FILTER (id % 4 > 0) + 0.1 * max(score) FILTER (id % 4 > 0) ELSE max(score) END, 6) AS score FROM scored GROUP BY 1, 2")(
    lambda s, d: _scored(view(s, d, "media")).select((F.col("id") / 4).cast("long").alias("file"), (F.col("id") % 4).alias("view"), F.explode("scores").alias("s")).groupBy("file", F.col("s.category").alias("category")).agg(F.max(F.when(F.col("view") == 0, F.col("s.score"))).alias("w"), F.collect_list(F.when(F.col("view") > 0, F.col("s.score"))).alias("ds")).select("file", "category", F.round(signals.merge_view_scores(F.col("w"), F.col("ds")), 6).alias("score"))
)
query("a10_merge_view_embeddings", f"{with_views('media')}, e AS (SELECT id // 4 AS file, id % 4 AS view, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM media), m AS (SELECT file, pos, CASE WHEN count(*) > 1 THEN 0.8 * max(x) FILTER (view = 0) + 0.2 * avg(x) FILTER (view > 0) ELSE max(x) END AS x FROM e GROUP BY 1, 2), v AS (SELECT file, list(x ORDER BY pos) AS v FROM m GROUP BY 1) SELECT file, (unnest(range(64)))::INT AS pos, round(unnest(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))), 6) AS x FROM v")(
    lambda s, d: media.merge_view_embeddings(view(s, d, "media").select((F.col("id") / 4).cast("long").alias("id"), (F.col("id") % 4).alias("view"), F.col("embedding").cast("array<double>").alias("vector"))).select(F.col("id").alias("file"), F.posexplode("vector").alias("pos", "x")).select("file", "pos", F.round("x", 6).alias("x"))
)
DECIDED = "CASE WHEN s[1] < 0.225 THEN 'other' ELSE array_to_string(list_slice(list_filter(c, lambda x, i: s[i] >= 0.225 AND s[i] >= s[1] - 0.025), 1, 3), ',') END"
FRAMES_SQL = f"{SCORE_SQL}, each AS (SELECT id, {DECIDED} AS chosen FROM (SELECT id, list(category ORDER BY score DESC, category) AS c, list(score ORDER BY score DESC, category) AS s FROM scored GROUP BY id)), top AS (SELECT id // 3 AS id, category, max(score) AS score FROM scored GROUP BY 1, 2), ranked AS (SELECT id, list(category ORDER BY score DESC, category) AS c, list(score ORDER BY score DESC, category) AS s FROM top GROUP BY id), total AS (SELECT id, sqrt(sum(x * x)) AS norm, max(x) FILTER (pos = 1) AS x FROM (SELECT id // 3 AS id, pos, sum(x) AS x FROM (SELECT id, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM media) GROUP BY 1, 2) GROUP BY id)"
query("a11_merge_video_frames", f"{FRAMES_SQL} SELECT id, {DECIDED} AS categories, s[1] < 0.24 OR s[1] - s[2] < 0.018 OR id IN (SELECT id // 3 FROM each GROUP BY 1 HAVING count(DISTINCT chosen) > 1) AS uncertain, round(x / norm, 5) AS first FROM ranked JOIN total USING (id)")(
    lambda s, d: media.merge_video_frames(_scored(view(s, d, "media")).select((F.col("id") / 3).cast("long").alias("id"), (F.col("id") % 3).alias("frame"), "scores", "embedding"), "balanced", CATS).select("id", F.array_join("categories", ",").alias("categories"), "uncertain", F.round(F.col("embedding")[0], 5).alias("first"))
)
query("a11_merge_video_vectors", f"{with_views('media')}, e AS (SELECT id // 3 AS id, generate_subscripts(embedding, 1)::INT AS pos, unnest(embedding)::DOUBLE AS x FROM media), m AS (SELECT id, pos, sum(x) AS x FROM e GROUP BY 1, 2) SELECT id, pos - 1 AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 5) AS x FROM m")(
    lambda s, d: media.merge_video_frames(_scored(view(s, d, "media")).select((F.col("id") / 3).cast("long").alias("id"), (F.col("id") % 3).alias("frame"), "scores", "embedding"), "balanced", CATS).select("id", F.posexplode("embedding").alias("pos", "x")).select("id", "pos", F.round("x", 5).alias("x"))
)
simple("j6_apply_corrections", "media", lambda v: media.apply_corrections(v.withColumn("categories", F.array("category")), v.where("id % 10 = 0").select("digest", F.array(F.lit("memes")).alias("categories")).distinct()).select("id", F.array_join("categories", ",").alias("categories"), "corrected", "uncertain"),
       "SELECT id, CASE WHEN c THEN 'memes' ELSE category END AS categories, c AS corrected, uncertain AND NOT c AS uncertain FROM (SELECT *, digest IN (SELECT digest FROM media WHERE id % 10 = 0) AS c FROM media)")
# The newest examples of one model and mode teach by the production thresholds; the media are the same vectors, so that an example's own row is taught.
EXAMPLES_SQL = "ex AS (SELECT id, embedding, CASE WHEN label < 5 THEN 'memes' ELSE 'people' END AS cat FROM (SELECT * FROM media ORDER BY id DESC LIMIT 1024) WHERE id % 2 = 0 AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) BETWEEN 0.98 AND 1.02 ORDER BY id DESC LIMIT 256), s AS (SELECT m.id, cat, list_inner_product(m.embedding::DOUBLE[], ex.embedding::DOUBLE[]) AS sim FROM media m, ex), t AS (SELECT id, arg_max(cat, sim) AS categories, max(sim) AS similarity FROM s GROUP BY id), taught AS (SELECT * FROM t WHERE similarity >= 0.94 AND NOT EXISTS (SELECT 1 FROM s WHERE s.id = t.id AND s.cat <> t.categories AND s.sim >= t.similarity - 0.03))"


def _examples(v: DataFrame) -> DataFrame:
    kept = v.select("id", "digest", "label", "embedding", F.col("id").alias("updated_at"), F.lit("m").alias("model"), F.when(F.col("id") % 2 == 0, "fast").otherwise("thorough").alias("mode"))
    return media.recent_examples(kept, "m", "fast", 64).select("digest", "embedding", F.array(F.when(F.col("label") < 5, "memes").otherwise("people")).alias("categories"))


simple("j7_nearest_feedback", "media", lambda v: media.nearest_feedback(v, _examples(v)).select("id", F.array_join("categories", ",").alias("categories"), F.round("similarity", 5).alias("similarity")))
simple("j7_learned_labels", "media", lambda v: media.learned_labels(v.withColumn("categories", F.array("category")), _examples(v), v.where("id % 10 = 0").select("digest", F.array(F.lit("memes")).alias("categories")).distinct()).select("id", F.array_join("categories", ",").alias("categories"), "corrected", "learned", "uncertain"))
ORACLES["j7_nearest_feedback"] = f"{with_views('media')}, {EXAMPLES_SQL} SELECT id, categories, round(similarity, 5) AS similarity FROM taught"
ORACLES["j7_learned_labels"] = f"{with_views('media')}, {EXAMPLES_SQL}, c AS (SELECT *, digest IN (SELECT digest FROM media WHERE id % 10 = 0) AS corrected, id IN (SELECT id FROM taught) AS near FROM media) SELECT c.id, CASE WHEN corrected THEN 'memes' WHEN near THEN taught.categories ELSE category END AS categories, corrected, near AND NOT corrected AS learned, NOT corrected AND (uncertain OR near) AS uncertain FROM c LEFT JOIN taught USING (id)"
simple("j8_mark_protected", "media", lambda v: media.mark_protected(v, v.where("id % 50 = 0").select("digest")).select("id", "protected"), "SELECT id, digest IN (SELECT digest FROM media WHERE id % 50 = 0) AS protected FROM media")
simple("j8_guard_retirement", "media", lambda v: media.guard_retirement(v.where("label = 3"), v.where("id % 50 = 0").select("digest")), "SELECT CASE WHEN count(*) > 0 THEN 'MEDIA_PROTECTED' END AS error FROM media WHERE label = 3 AND digest IN (SELECT digest FROM media WHERE id % 50 = 0)")


@query("j9_split_cached", f"{with_views('media')}, m AS (SELECT *, digest IN (SELECT digest FROM media WHERE label < 5 AND id % 3 > 0) AS ok FROM media) SELECT 'hit' AS what, digest, id FROM m WHERE ok UNION ALL SELECT DISTINCT 'miss', digest, NULL::BIGINT FROM m WHERE NOT ok")
def j9(s, d):
    v = view(s, d, "media").withColumn("profile", F.lit("p"))
    cache = v.where("label < 5").groupBy("digest", "profile").agg(F.max("id").alias("m"), F.max(F.col("id") % 3).alias("k")).select("digest", "profile", F.array(F.struct(F.lit("c").alias("category"), F.when(F.col("k") > 0, 0.5).otherwise(2.0).alias("score"))).alias("labels"), F.lit(None).cast("array<float>").alias("embedding"))
    hit, miss = media.split_cached(v.drop("embedding"), cache, 64)
    return hit.select(F.lit("hit").alias("what"), "digest", "id").unionByName(miss.select(F.lit("miss").alias("what"), "digest", F.lit(None).cast("long").alias("id")))


simple("w3_trim_cache", "media", lambda v: media.trim_cache(v.select("id", (F.col("id") * 7 % 100).alias("updated_at")), 120).select("id"), "SELECT id FROM media ORDER BY id * 7 % 100 DESC, id DESC LIMIT 120")
simple("w4_recent_examples", "media", lambda v: media.recent_examples(v.select("id", "embedding", F.col("id").alias("updated_at"), F.lit("m").alias("model"), F.when(F.col("id") % 2 == 0, "fast").otherwise("thorough").alias("mode")), "m", "fast", 64, 100, 300).select("id"),
       "SELECT id FROM (SELECT id FROM media ORDER BY id DESC LIMIT 300) WHERE id % 2 = 0 ORDER BY id DESC LIMIT 100")
simple("a14_gallery_counts", "media", lambda v: media.gallery_counts(v.withColumn("corrected", F.col("id") % 8 == 0), v.where("id % 5 = 0").select("id")),
       "SELECT count(*) FILTER (protected) AS protected, count(*) FILTER (id % 5 = 0) AS excluded, count(*) FILTER (NOT protected AND id % 5 <> 0) AS removable, count(*) FILTER (id % 8 = 0) AS corrected FROM media")
simple("w8_natural_key", "inbox", lambda v: v.select("path", F.rank().over(Window.partitionBy(scalars.extension(_path())).orderBy(scalars.natural_key(scalars.file_name(_path())))).cast("long").alias("place")),
       "SELECT path, rank() OVER (PARTITION BY id % 5 ORDER BY id) AS place FROM inbox")

# ---- plans
simple("j5_destination_conflicts", "journal", lambda v: (lambda o: resolve.destination_conflicts(o, o.where("seq % 10 = 0").select(F.col("destination").alias("path"))).select("seq", "conflict"))(v.select((F.col("operation_id") * 1000 + F.col("sequence")).alias("seq"), F.lower("destination").alias("destination"))),
       "SELECT seq, seq > min(seq) OVER (PARTITION BY destination) OR destination IN (SELECT destination FROM (SELECT operation_id * 1000 + sequence AS seq, destination FROM journal) WHERE seq % 10 = 0) AS conflict FROM (SELECT operation_id * 1000 + sequence AS seq, destination FROM journal)")
simple("j16_apply_resolutions", "inbox", lambda v: resolve.apply_resolutions(v.select("id", _path().alias("source")), v.where("id % 6 = 0").select(_path().alias("source"), F.lit("replace").alias("policy"), F.when(F.col("id") % 12 == 0, "nonsense").otherwise("keep-both").alias("duplicate_action")), "skip", "skip").select("id", "policy", "duplicate_action", "error"),
       "SELECT id, CASE WHEN id % 6 = 0 THEN 'replace' ELSE 'skip' END AS policy, CASE WHEN id % 12 = 0 THEN 'nonsense' WHEN id % 6 = 0 THEN 'keep-both' ELSE 'skip' END AS duplicate_action, CASE WHEN id % 12 = 0 THEN 'INVALID_TRANSFER' END AS error FROM inbox")
simple("w7_available_name", "inbox", lambda v: resolve.available_names(v.select(F.concat(F.lit("/t/f"), (F.col("id") % 50).cast("string"), F.lit(".txt")).alias("target"), F.col("id").alias("seq")), v.where("id % 50 < 25 and id < 100").select(F.concat(F.lit("/t/f"), (F.col("id") % 50).cast("string"), F.lit(" ("), (F.floor(F.col("id") / 50) * 2 + 1).cast("string"), F.lit(").txt")).alias("path"))).select("target", "seq", "available"),
       "SELECT '/t/f' || id % 50 || '.txt' AS target, id AS seq, '/t/f' || id % 50 || ' (' || CASE WHEN id % 50 >= 25 THEN k WHEN k = 1 THEN 2 ELSE k + 2 END || ').txt' AS available FROM (SELECT id, row_number() OVER (PARTITION BY id % 50 ORDER BY id) AS k FROM inbox)")


@query("b2_plan_transfer", f"{with_views('tree')}, d AS (SELECT DISTINCT r_name, n_name FROM tree WHERE r_name = 'ASIA') SELECT 1 AS phase, 0 AS \"order\", path, '/new' || path AS target, 'move' AS action, NULL::VARCHAR AS error FROM tree WHERE r_name = 'ASIA' UNION ALL SELECT 0, 2, '/ASIA/' || n_name, '/new/ASIA/' || n_name, 'mkdir', NULL FROM d UNION ALL SELECT 2, -2, '/ASIA/' || n_name, '/new/ASIA/' || n_name, 'rmdir', NULL FROM d UNION ALL SELECT DISTINCT 0, 1, '/ASIA', '/new/ASIA', 'mkdir', NULL FROM d UNION ALL SELECT DISTINCT 2, -1, '/ASIA', '/new/ASIA', 'rmdir', NULL FROM d")
def b2(s, d):
    t = view(s, d, "tree").select("path")
    dirs = t.select(F.explode(scalars.ancestors(_path(), itself=False)).alias("path")).distinct().withColumn("is_dir", F.lit(True))
    return resolve.plan_transfer(t.withColumn("is_dir", F.lit(False)).union(dirs), s.createDataFrame([("/ASIA",), ("/ASIA/NATION_1",)], "path string"), "/new")


def _walked(s: SparkSession, d: str) -> DataFrame:
    t = view(s, d, "tree").select("path", F.lit(False).alias("is_dir"))
    return t.union(t.select(F.explode(scalars.ancestors(_path(), itself=False)).alias("path")).distinct().withColumn("is_dir", F.lit(True)))


# One of two folders is there already.
_WALK_SQL = "w AS (SELECT path, false AS is_dir, 3 AS level, r_name FROM tree UNION ALL SELECT DISTINCT '/' || r_name || '/' || n_name, true, 2, r_name FROM tree UNION ALL SELECT DISTINCT '/' || r_name, true, 1, r_name FROM tree), x AS (SELECT *, r_name = 'ASIA' AS held FROM w WHERE r_name IN ('ASIA', 'EUROPE'))"


def _two_folders(s: SparkSession, d: str, policy: str) -> DataFrame:
    return resolve.plan_transfer(_walked(s, d), s.createDataFrame([("/ASIA",), ("/EUROPE",)], "path string"), "/new", "copy", policy, s.createDataFrame([("/NEW/asia",), ("/new/ASIA (1)",)], "path string"))


query("b2_plan_transfer_skip", f"{with_views('tree')}, {_WALK_SQL} SELECT CASE WHEN held THEN 3 WHEN is_dir THEN 0 ELSE 1 END AS phase, CASE WHEN is_dir AND NOT held THEN level ELSE 0 END AS \"order\", path, '/new' || path AS target, CASE WHEN held THEN 'skip' WHEN is_dir THEN 'mkdir' ELSE 'copy' END AS action, NULL::VARCHAR AS error FROM x")(lambda s, d: _two_folders(s, d, "skip"))
query("b2_plan_transfer_keep_both", f"{with_views('tree')}, {_WALK_SQL} SELECT CASE WHEN is_dir THEN 0 ELSE 1 END AS phase, CASE WHEN is_dir THEN level ELSE 0 END AS \"order\", path, CASE WHEN held THEN '/new/ASIA (2)' || substr(path, 6) ELSE '/new' || path END AS target, CASE WHEN is_dir THEN 'mkdir' ELSE 'copy' END AS action, NULL::VARCHAR AS error FROM x")(lambda s, d: _two_folders(s, d, "keep-both"))


@query("b2_resolve_transfer", f"{with_views('tree')}, {_WALK_SQL}, f AS (SELECT x.*, c_custkey AS k FROM x LEFT JOIN tree USING (path)) SELECT CASE WHEN is_dir THEN 0 ELSE 1 END AS phase, CASE WHEN is_dir THEN level ELSE 0 END AS \"order\", path, CASE WHEN k % 3 = 0 THEN '/new' || regexp_replace(path, '\\.dat$', ' (1).dat') ELSE '/new' || path END AS target, CASE WHEN is_dir THEN 'mkdir' WHEN k % 3 = 1 THEN 'skip' ELSE 'copy' END AS action, NULL::VARCHAR AS error, false AS backup, coalesce(k % 3 = 0, false) AS conflict FROM f")
def b2_resolved(s, d):
    """Of the files, a third are in the target folder under their name with other contents, a third elsewhere with the same contents."""
    steps = resolve.plan_transfer(_walked(s, d), s.createDataFrame([("/ASIA",), ("/EUROPE",)], "path string"), "/new", "copy")
    files = view(s, d, "tree").select("path", "c_custkey", F.sha2(_path(), 256).alias("digest"))
    third = F.col("c_custkey") % 3
    library = files.where(third < 2).select(F.when(third == 0, F.concat(F.lit("/new"), _path())).otherwise(F.concat(F.lit("/else"), _path())).alias("path"), F.when(third == 1, F.col("digest")).otherwise("other").alias("digest"))
    return resolve.resolve_transfer(steps, files, library, "keep-both")


@query("b3_resolve_items", f"{with_views('inbox')}, i AS (SELECT id, '/t/' || id % 700 AS base FROM inbox), k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) - 1 + CASE WHEN id % 700 % 3 = 0 THEN 1 ELSE 0 END AS n FROM i) SELECT id AS seq, base || CASE WHEN n = 0 THEN '' ELSE ' (' || n || ')' END || '.txt' AS destination, 'move' AS action, n > 0 AS conflict FROM k")
def b3(s, d):
    v = view(s, d, "inbox")
    target = F.concat(F.lit("/t/"), (F.col("id") % 700).cast("string"), F.lit(".txt"))
    items = v.select(F.col("id").alias("seq"), _path().alias("source"), target.alias("destination"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    library = v.where("id % 700 % 3 = 0").select(target.alias("path"), F.lit("other").alias("digest")).distinct()
    return resolve.resolve_items(items, library, "keep-both").select("seq", "destination", "action", "conflict")


# A third of the files share contents only, a third names only, and a third both: of these every fifth is skipped where its contents are there.
MIXED_SQL = "k AS (SELECT id, id % 3 AS kind, CASE id % 3 WHEN 0 THEN id % 900 WHEN 1 THEN id % 700 ELSE id % 600 END AS g, id % 5 > 0 AS both_kept FROM inbox), r AS (SELECT *, row_number() OVER (PARTITION BY kind, g ORDER BY id) AS place FROM k), n AS (SELECT *, sum(CASE WHEN place > 1 AND both_kept THEN 1 ELSE 0 END) OVER (PARTITION BY kind, g ORDER BY id) AS number, place - CASE WHEN g % 3 = 0 THEN 0 ELSE 1 END AS names FROM r)"


@query("b3_mixed", f"{with_views('inbox')}, {MIXED_SQL} SELECT id AS seq, CASE WHEN kind = 0 THEN '/u/' || id WHEN kind = 1 THEN '/n/' || g || CASE WHEN names = 0 THEN '' ELSE ' (' || names || ')' END ELSE '/b/' || g || CASE WHEN place = 1 OR NOT both_kept THEN '' ELSE ' (' || number || ')' END END || '.txt' AS destination, CASE WHEN place > 1 AND (kind = 0 OR kind = 2 AND NOT both_kept) THEN 'skip' ELSE 'move' END AS action, CASE kind WHEN 0 THEN false WHEN 1 THEN names > 0 ELSE place > 1 END AS conflict, NULL::VARCHAR AS error FROM n")
def b3_mixed(s, d):
    v, kind = view(s, d, "inbox"), F.col("id") % 3
    g = F.when(kind == 0, F.col("id") % 900).when(kind == 1, F.col("id") % 700).otherwise(F.col("id") % 600).cast("string")
    target = F.concat(F.when(kind == 0, F.concat(F.lit("/u/"), F.col("id").cast("string"))).when(kind == 1, F.concat(F.lit("/n/"), g)).otherwise(F.concat(F.lit("/b/"), g)), F.lit(".txt"))
    items = v.select(F.col("id").alias("seq"), _path().alias("source"), target.alias("destination"), F.when(kind == 1, F.concat(F.lit("own "), F.col("id").cast("string"))).otherwise(F.concat(kind.cast("string"), F.lit(" "), g)).alias("digest"))
    library = v.where((kind == 1) & (F.col("id") % 700 % 3 == 0)).select(target.alias("path"), F.lit("other").alias("digest")).distinct()
    over = v.select(_path().alias("source"), F.when(kind == 1, "keep-both").otherwise("skip").alias("policy"), F.when((kind == 2) & (F.col("id") % 5 > 0), "keep-both").otherwise("skip").alias("duplicate_action"))
    return resolve.resolve_items(items, library, overrides=over).select("seq", "destination", "action", "conflict", "error")


simple("b6_plan_media_removal", "media", lambda v: media_removal(v), "SELECT id, path, 'move' AS action, true AS backup, 'MEDIA_PROTECTED' AS error FROM media WHERE label = 3")


def media_removal(v: DataFrame) -> DataFrame:
    return resolve.plan_media_removal(v, v.where("label = 3").select("id"), 1_000_000)


def _out(v: DataFrame) -> DataFrame:
    """A library that has every fourth medium in the target folder already, with its contents."""
    return v.where("id % 4 = 0").select(F.concat(F.lit("/OUT/"), "name").alias("path"), "digest")


def _transfer(v: DataFrame, *args, **more) -> DataFrame:
    return resolve.plan_media_transfer(v, v.where("label = 3").select("id"), "/out", _out(v), *args, **more)


_MEDIA_SQL = "SELECT id AS seq, path AS source, '/out/' || {name} AS destination, {action} AS action, false AS backup, id % 4 = 0 AS conflict, {error} AS error FROM media WHERE label = 3"
_SKIPS = "CASE WHEN id % 4 > 0 AND row_number() OVER (PARTITION BY digest ORDER BY id) = 1 THEN 'move' ELSE 'skip' END"
_SUFFIXED = "CASE WHEN id % 4 = 0 THEN id || ' (1).jpg' ELSE name END"
simple("b6_plan_media_transfer", "media", _transfer, _MEDIA_SQL.format(name="name", action=_SKIPS, error="NULL::VARCHAR"))
simple("b6_plan_media_transfer_keep_both", "media", lambda v: _transfer(v, "keep-both", "keep-both"), _MEDIA_SQL.format(name=_SUFFIXED, action="'move'", error="NULL::VARCHAR"))
simple("b6_copy", "media", lambda v: _transfer(v, "keep-both", "keep-both", mode="copy"), _MEDIA_SQL.format(name=_SUFFIXED, action="'copy'", error="NULL::VARCHAR"))
simple("b6_actions", "media", lambda v: _transfer(v, overrides=v.where("label = 3").select(F.col("path").alias("source"), F.lit(None).cast("string").alias("policy"), F.when(F.col("id") % 8 == 0, "replace-existing").otherwise("skip").alias("duplicate_action"))).select("seq", "source", "error"),
       "SELECT id AS seq, path AS source, 'INVALID_TRANSFER' AS error FROM media WHERE label = 3")
simple("b6_gallery_after", "media", lambda v: resolve.gallery_after(v, v.where("id % 3 < 2").select(_path().alias("source"), F.when(F.col("id") % 3 == 0, "move").otherwise("copy").alias("kind"), F.when(F.col("id") % 5 == 0, "failed").otherwise("completed").alias("status"))).select("id"),
       "SELECT id FROM media WHERE NOT (id % 3 = 0 AND id % 5 > 0)")

# ---- streams
T2_SQL = f"{with_views('observations')}, c AS (SELECT *, CASE WHEN lag(modified_at) OVER w IS DISTINCT FROM modified_at THEN 1 ELSE 0 END AS ch FROM observations WINDOW w AS (PARTITION BY path ORDER BY observed_at, modified_at)), g AS (SELECT *, sum(ch) OVER (PARTITION BY path ORDER BY observed_at, modified_at) AS segment FROM c), h AS (SELECT *, min(observed_at) OVER (PARTITION BY path, segment) AS since FROM g), k AS (SELECT *, observed_at >= since + INTERVAL 1 HOUR AND path NOT LIKE '%.part' AS counts FROM h), l AS (SELECT *, sum(CASE WHEN counts AND locked THEN 1 ELSE 0 END) OVER (PARTITION BY path, segment ORDER BY observed_at, modified_at) AS nl FROM k), m AS (SELECT path, segment, min(since) AS since, min(observed_at) FILTER (counts AND NOT locked AND nl < 2) AS ok, min(observed_at) FILTER (counts AND locked AND nl = 2) AS bad FROM l GROUP BY 1, 2)"
query("t2_stable_files_batch", f"{T2_SQL} SELECT path, CAST(segment AS BIGINT) AS segment, since, CASE WHEN ok IS NOT NULL AND (bad IS NULL OR ok < bad) THEN 'ready' WHEN bad IS NOT NULL THEN 'failed' ELSE 'waiting' END AS status, CASE WHEN ok IS NOT NULL AND (bad IS NULL OR ok < bad) THEN ok ELSE bad END AS decided_at FROM m")(lambda s, d: stable.stable_files_batch(view(s, d, "observations"), 3600, 2))
query("t4_retry_failed", f"{T2_SQL} SELECT path, CAST(segment AS BIGINT) AS segment, CASE WHEN ok IS NOT NULL AND (bad IS NULL OR ok < bad) THEN 'ready' ELSE 'waiting' END AS status FROM m")(lambda s, d: stable.retry_failed(stable.stable_files_batch(view(s, d, "observations"), 3600, 2).withColumns({"retries": F.lit(2), "error": F.lit("FILE_LOCKED")})).select("path", "segment", "status"))


def _replay(s: SparkSession, d: str) -> DataFrame:
    """The observations as a stream of files, replayed once into a table."""
    from curatrix.operators.tables import materialized

    seen = materialized(view(s, d, "observations").orderBy("observed_at"))
    source = seen.inputFiles()[0].rsplit("/", 1)[0]
    stream = s.readStream.schema(seen.schema).parquet(source)
    out = stable.stable_files(stream, 3600, 2, "40 days").writeStream.format("parquet").option("path", source + "-out").option("checkpointLocation", source + "-at").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    return s.read.schema(stable.STATUS).parquet(source + "-out")


T1_SQL = T2_SQL.replace("AS bad FROM l", "AS bad, arg_min(nl, observed_at) FILTER (counts AND NOT locked AND nl < 2) AS before FROM l")
query("t1_stable_files", f"{T1_SQL} SELECT path, since AS observed_at, 'detected' AS status, 0::INT AS retries, NULL::VARCHAR AS error FROM m UNION ALL SELECT path, ok, 'ready', before::INT, NULL FROM m WHERE ok IS NOT NULL AND (bad IS NULL OR ok < bad) UNION ALL SELECT path, bad, 'failed', 2, 'FILE_LOCKED' FROM m WHERE bad IS NOT NULL AND (ok IS NULL OR bad < ok)")(_replay)


def _organized(s: SparkSession, d: str) -> DataFrame:
    from curatrix.operators.tables import materialized

    ready = materialized(view(s, d, "inbox").withColumn("status", F.lit("ready")))
    source = ready.inputFiles()[0].rsplit("/", 1)[0]
    stable.organize_stream(s.readStream.schema(ready.schema).parquet(source), RULES, source + "-out", source + "-at").awaitTermination()
    return s.read.parquet(source + "-out").select("id", "status", "rule_id")


query("t3_organize_stream", f"{with_views('inbox')}, {RULES_SQL}, {MATCHED_SQL} SELECT id, status, rule_id FROM matched")(_organized)


@query("t3_revisions", f"{with_views('inbox')}, {RULES_SQL}, {MATCHED_SQL} SELECT id, status, error, rule_id, destination, date_source, date_used FROM matched")
def t3_revisions(s, d):
    """All files of the inbox with half of the rules, then with a revision that has them all: what is decided last equals one match with all of them."""
    from curatrix.operators.tables import new_folder

    at = lambda day: F.lit(f"2030-01-{day:02d}").cast("timestamp")
    files = view(s, d, "inbox").select("path", F.when(F.col("id") % 3 == 0, at(4)).otherwise(at(2)).alias("observed_at"), F.lit("ready").alias("status"), "created", "modified", "accessed", F.lit(None).cast("long").alias("revision"), F.lit(None).cast("string").alias("rules"))
    where = new_folder(s)
    for k, rows in enumerate((revisions.revision_row(s, 1, RULES[:2], dt.datetime(2030, 1, 1)), files.where("id % 3 > 0"), revisions.revision_row(s, 2, RULES, dt.datetime(2030, 1, 3)), files.where("id % 3 = 0"), revisions.revision_row(s, 1, [], dt.datetime(2030, 1, 5)))):
        rows.write.mode("append").parquet(f"{where}/in")
        revisions.replay(s.readStream.schema(revisions.ROWS).parquet(f"{where}/in"), f"{where}/out", f"{where}/at").awaitTermination()
    told = revisions.last_decisions(s.read.schema(revisions.OUT).parquet(f"{where}/out"))
    ids = view(s, d, "inbox").select("id", "path")
    return told.join(ids, "path").select("id", "status", "error", "rule_id", "destination", "date_source", F.col("date_used").cast("date").alias("date_used"))
