"""Listing, filtering and sorting of catalogue rows and media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.scalars import ancestors, extension, file_name, fold_text, natural_key, parent, path_key
from curatrix.operators.rules import plan_counter

# Display names of categories, in Spanish.
CATEGORY_NAMES = {"folder": "Carpeta", "image": "Imagen", "video": "Video", "audio": "Audio", "document": "Documento", "spreadsheet": "Hoja de cálculo", "presentation": "Presentación", "archive": "Comprimido", "code": "Código", "executable": "Aplicación", "other": "Otro"}


def list_folder(catalog: DataFrame, folder: str, root: str | None = None) -> DataFrame:
    """Direct children, with the root and the folder's parent (null at the root)."""
    above = folder.rpartition("/")[0] if root is not None and folder.lower() != root.lower() else None
    return catalog.where(parent(F.col("path")) == folder).withColumns({"root": F.lit(root).cast("string"), "parent": F.lit(above).cast("string")})


def scan_report(candidates: DataFrame, max_files: int | None = None, max_entries: int | None = None) -> DataFrame:
    """candidates (path, kind: null if not media, readable): how many are kept, skipped, unreadable, and whether a cap cut some.

    At most max_entries entries are looked at, in order of path."""
    if max_entries is not None:
        seen = plan_counter(candidates, "path", "_entry")
        looked = scan_report(seen.where(F.col("_entry") <= max_entries), max_files)
        more = seen.agg(F.coalesce(F.max("_entry") > max_entries, F.lit(False)).alias("_more"))
        return looked.join(F.broadcast(more)).select("kept", "skipped", "unreadable", (F.col("truncated") | F.col("_more")).alias("truncated"))  # one row each
    totals = candidates.agg(F.count_if(F.col("kind").isNotNull() & F.col("readable")).alias("media"), F.count_if(F.col("kind").isNull()).alias("skipped"), F.count_if(F.col("kind").isNotNull() & ~F.col("readable")).alias("unreadable"))
    cap = F.lit(max_files).cast("long")
    return totals.select(F.least("media", cap).alias("kept"), "skipped", "unreadable", F.coalesce(F.col("media") > cap, F.lit(False)).alias("truncated"))


def filter_files(catalog: DataFrame, category: str | None = None, query: str = "", ext: str = "", show_hidden: bool = False, min_size: int = 0) -> DataFrame:
    name = file_name(F.col("path"))
    keep = F.lit(True) if show_hidden else ~F.col("hidden")
    if category:
        keep &= F.col("category") == category
    if query.strip():
        keep &= F.contains(fold_text(name), fold_text(F.lit(query.strip())))
    if ext.strip():
        keep &= extension(F.col("path")) == ext.strip().lstrip(".").lower()
    if min_size:
        keep &= F.coalesce(F.col("size") >= min_size, F.lit(False))
    return catalog.where(keep)


def sort_key(field: str) -> Column:
    if field == "name":
        return natural_key(file_name(F.col("path")))
    if field == "category":
        table = F.create_map(*[x for k, v in CATEGORY_NAMES.items() for x in (F.lit(k), F.lit(v))])
        return fold_text(F.coalesce(F.try_element_at(table, F.col("category")), F.col("category")))
    return F.col(field)


def file_order(field: str = "name", direction: str = "asc") -> list[Column]:
    """Folders first and nulls last in both directions; ties by name."""
    key = sort_key(field)
    return [F.col("is_dir").desc(), key.asc_nulls_last() if direction == "asc" else key.desc_nulls_last(), natural_key(file_name(F.col("path"))).asc(), F.col("path").asc()]


def sort_files(catalog: DataFrame, field: str = "name", direction: str = "asc") -> DataFrame:
    return catalog.orderBy(*file_order(field, direction))


def placed_files(catalog: DataFrame, field: str = "name", direction: str = "asc", name: str = "place") -> DataFrame:
    """sort_files as a column: each file's place in that order, from 1."""
    return plan_counter(catalog, file_order(field, direction), name)


def page(df: DataFrame, order: list[Column], number: int, size: int = 36) -> DataFrame:
    """One page, from 0: a top-k of (number + 1) * size rows, not a full sort to one task."""
    return df.orderBy(*order).limit((number + 1) * size).offset(number * size)


def media_filter(category: str | None = None, kind: str | None = None, status: str = "all", query: str = "", excluded: Column | None = None) -> Column:
    keep = F.lit(True)
    if category:
        keep &= F.exists("labels", lambda x: x["category"] == category)
    if kind:
        keep &= F.col("kind") == kind
    if status == "excluded":
        keep &= excluded if excluded is not None else F.lit(False)
    elif status in ("protected", "uncertain"):
        keep &= F.col(status)
    elif status == "error":
        keep &= F.col("status") == "error"
    elif status == "available":
        keep &= ~F.col("protected") & (~excluded if excluded is not None else F.lit(True))
    if query.strip():
        q = query.strip().lower()
        keep &= F.contains(F.lower("path"), F.lit(q)) | F.contains(F.lower("name"), F.lit(q))
    return keep


def filter_media(media: DataFrame, excluded: DataFrame | None = None, **filters) -> DataFrame:
    if excluded is None:
        return media.where(media_filter(**filters))
    flagged = media.join(excluded.select("id").distinct().withColumn("_out", F.lit(True)), "id", "left")
    return flagged.where(media_filter(excluded=F.col("_out").isNotNull(), **filters)).drop("_out")


def visible_media(media: DataFrame, excluded: DataFrame, show_excluded: bool = False, show_protected: bool = False, **filters) -> DataFrame:
    """filter_media; excluded and protected rows only where they are asked for."""
    out = filter_media(media, excluded, **filters)
    status = filters.get("status", "all")
    if not show_excluded and status != "excluded":
        out = out.join(excluded.select("id"), "id", "left_anti")
    return out if show_protected or status == "protected" else out.where(~F.col("protected"))


def select_media(media: DataFrame, ids: DataFrame, removable_only: bool = False) -> DataFrame:
    out = media.join(ids.select("id"), "id", "left_semi")
    return out.where(~F.col("protected")) if removable_only else out


def exclude(excluded: DataFrame, ids: DataFrame) -> DataFrame:
    """The session's exclusions (id) with these ids too."""
    return excluded.select("id").union(ids.select("id")).distinct()


def restore(excluded: DataFrame, ids: DataFrame) -> DataFrame:
    """The session's exclusions without these ids."""
    return excluded.select("id").join(ids.select("id"), "id", "left_anti")


def review_queue(inbox: DataFrame, query: str = "") -> DataFrame:
    return inbox.where(F.col("status").isin("needs-review", "failed") & F.contains(F.lower("name"), F.lit(query.strip().lower())))


def plan_issues(plan: DataFrame) -> DataFrame:
    return plan.where(~F.col("backup") & (F.col("conflict") | F.col("has_duplicates"))).withColumn("kind", F.when(F.col("has_duplicates"), "identical-content").otherwise("name-conflict"))


def _prefixes(files: DataFrame) -> DataFrame:
    return files.select("path", F.explode(ancestors(path_key(F.col("path")))).alias("_key"))


def in_scope(files: DataFrame, roots: DataFrame) -> DataFrame:
    """path and error: null if a root covers the path by components, else FOLDER_NOT_AUTHORIZED."""
    keys = roots.select(path_key(F.col("root")).alias("_key")).distinct()
    covered = _prefixes(files).join(keys, "_key", "left_semi").select("path").distinct().withColumn("_in", F.lit(True))
    return files.join(covered, "path", "left").withColumn("error", F.when(F.col("_in").isNull(), "FOLDER_NOT_AUTHORIZED")).drop("_in")


def attribute_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """path and the deepest root that covers it (null: none)."""
    keys = roots.select("root", path_key(F.col("root")).alias("_key")).distinct()
    best = _prefixes(files).join(keys, "_key").groupBy("path").agg(F.max_by("root", F.length("_key")).alias("root"))
    return files.select("path").distinct().join(best, "path", "left")


def managed_roots(*frames: DataFrame) -> DataFrame:
    out = frames[0].toDF("root")
    for f in frames[1:]:
        out = out.unionByName(f.toDF("root"))
    return out.where(F.col("root").isNotNull()).distinct()


def check_roots(roots: DataFrame, most: int = 32) -> DataFrame:
    """One row: INVALID_FOLDERS unless there are 1 to `most` different roots. No roots never mean all."""
    many = roots.select(path_key(F.col("root")).alias("_key")).where("_key is not null").distinct()
    return many.agg(F.when(~F.count(F.lit(1)).between(1, most), "INVALID_FOLDERS").alias("error"))


def collapse_roots(roots: DataFrame, recursive: bool = True) -> DataFrame:
    """One root per path key; recursive: those inside another go."""
    one = roots.groupBy(path_key(F.col("root")).alias("_key")).agg(F.min("root").alias("root"))
    if recursive:
        above = one.select("root", F.explode(ancestors(F.col("_key"), itself=False)).alias("_up"))
        inside = above.join(one.select(F.col("_key").alias("_up")), "_up", "left_semi").select("root").distinct()
        one = one.join(inside, "root", "left_anti")
    return one.select("root")


def remap_paths(paths: DataFrame, moves: DataFrame, undo: bool = False) -> DataFrame:
    """Paths below the outermost moved folder get its new place; moves (source, target), swapped for undo; repeats go."""
    a, b = ("target", "source") if undo else ("source", "target")
    table = moves.select(path_key(F.col(a)).alias("_key"), F.col(a).alias("_from"), F.col(b).alias("_to"))
    hit = _prefixes(paths.select("path").distinct()).join(table, "_key").groupBy("path").agg(F.min_by(F.struct("_from", "_to"), F.length("_key")).alias("m"))
    new = F.when(F.col("m").isNull(), F.col("path")).otherwise(F.concat(F.col("m._to"), F.substring(F.col("path"), F.length("m._from") + 1, F.length("path"))))
    return paths.select("path").distinct().join(hit, "path", "left").select(new.alias("path")).distinct()


def distinct_files(files: DataFrame) -> DataFrame:
    """One row per path key; of rows with one identity the first by path stays, the others are to be skipped."""
    one = files.withColumn("_r", F.row_number().over(Window.partitionBy(path_key(F.col("path"))).orderBy("path"))).where("_r = 1").drop("_r")
    rank = F.row_number().over(Window.partitionBy("identity").orderBy("path"))
    return one.withColumn("action", F.when(F.col("identity").isNotNull() & (rank > 1), "skip").otherwise("keep"))
