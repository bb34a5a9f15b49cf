"""Operation journals: reading, status, progress, recovery, undo."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.functions.scalars import ancestors, path_key, ticks
from curatrix.operators.stores import claim, recorded
from curatrix.operators.tables import Grown, materialized

# What a payload holds: its names in JSON, and the columns of a journal's items.
FIELDS = {
    "id": "id string", "source": "source string", "destination": "destination string", "status": "status string", "kind": "kind string", "entryKind": "entry_kind string", "error": "error string",
    "bytes": "bytes long", "digest": "digest string", "identity": "identity string", "size": "size long", "modifiedAt": "modified_at long", "createdAt": "created_at long", "oldValue": "old_value string",
    "newValue": "new_value string", "undoPath": "undo_path string", "recoveryParent": "recovery_parent string", "ruleName": "rule_name string", "dateSource": "date_source string", "dateUsed": "date_used long",
}
ITEM = f"struct<{','.join(f'{name}:{column.split()[1]}' for name, column in FIELDS.items())}>"
OPEN = ("planned", "pending", "undo-pending")
FOLDERS = ("directory", "folder")
STEPS = ("mkdir", "rmdir")
LARGE_OPERATION = 10_000  # steps that one task may replay
COMMIT = "batch string, attempt string, revision long, whole boolean"
KEY = ["batch", "attempt", "revision"]


def read_journal(items: DataFrame) -> DataFrame:
    """operation_id, sequence and the payload's fields; a missing kind is a move, a missing entryKind a file, others are null."""
    defaults = {"kind": "move", "entryKind": "file"}
    field = lambda name: F.coalesce(F.col(f"p.{name}"), F.lit(defaults[name])) if name in defaults else F.col(f"p.{name}")
    return items.withColumn("p", F.from_json("payload", ITEM)).select("operation_id", "sequence", *[field(name).alias(column.split()[0]) for name, column in FIELDS.items()])


def _payload(rows: DataFrame) -> Column:
    """The fields that the rows have, as JSON; nulls are left out."""
    held = {name: column.split() for name, column in FIELDS.items()}
    return F.to_json(F.struct(*[F.col(c).cast(kind).alias(name) for name, (c, kind) in held.items() if c in rows.columns]))


def journal_rows(plan: DataFrame, operation_id: str | None = None) -> DataFrame:
    """plan (seq, action, source, destination and any of the journal's columns; operation_id where none is given) as items in plan order, as JSON payloads."""
    status = F.when(F.col("action") == "skip", "skipped").otherwise("planned")
    own = F.lit(operation_id) if operation_id is not None else F.col("operation_id")
    rows = plan.drop("status", "kind").withColumns({"status": status, "kind": F.col("action")})
    return rows.select(own.alias("operation_id"), F.col("seq").alias("sequence"), _payload(rows).alias("payload"))


def _last_whole(commits: DataFrame) -> DataFrame:
    """The commits that still count: of each batch the last whole one and what came after it."""
    whole = commits.where("whole").groupBy("batch").agg(F.max("revision").alias("_whole"))
    return commits.join(whole, "batch", "left").where("_whole is null or revision >= _whole").drop("_whole")


def _is_whole(spark: SparkSession, root: str, batch: str, attempt: str, revision: int) -> bool:
    """Whether a written attempt has each of its items once, and all items of the batch's earlier revisions, which have to be there without a gap."""
    rows = spark.read.parquet(f"{root}/items").where(F.col("batch") == batch)
    mine = rows.where(F.col("attempt") == attempt).select("operation_id", "sequence", F.lit(1).alias("_new"))
    if revision:
        commits = spark.read.schema(COMMIT).json(f"{root}/commits").where((F.col("batch") == batch) & (F.col("revision") < revision))
        if commits.count() != revision:
            return False
        old = rows.join(F.broadcast(_last_whole(commits).select(*KEY)), KEY, "left_semi")
        mine = mine.unionByName(old.select("operation_id", "sequence", F.lit(0).alias("_new")))
    return mine.groupBy("operation_id", "sequence").agg(F.sum("_new").alias("_new")).where("_new <> 1").isEmpty()


def _commit(items: DataFrame, path: str, batch: str, revision: int) -> bool:
    """Items (operation_id, sequence, payload) as one revision: rows first, then the record that makes them count. False, and nothing written that counts, where it is there.

    The record says whether the revision is whole: readers then need nothing before it."""
    spark, root = items.sparkSession, path.rstrip("/")
    record = f"{root}/commits/{quote(batch, safe='')}.{revision}.json"
    if recorded(spark, record):
        return False
    attempt = uuid.uuid4().hex
    rows = items.select("operation_id", F.col("sequence").cast("long").alias("sequence"), F.lit(revision).cast("long").alias("revision"), F.current_timestamp().alias("at"), "payload", F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"))
    rows.write.mode("append").option("compression", "zstd").parquet(f"{root}/items")
    whole = _is_whole(spark, root, batch, attempt, revision)
    return claim(spark, record, {"batch": batch, "attempt": attempt, "revision": revision, "whole": whole})


def write_journal(plan: DataFrame, operation_id: str | None, path: str, batch: str | None = None) -> bool:
    """Append a plan's operation, or the operations of a plan with a column operation_id as one batch of that name. A repeat is ignored (False)."""
    name = batch if batch is not None else operation_id
    if name is None:
        raise ValueError("a plan of several operations needs a name for the batch")
    return _commit(journal_rows(plan, operation_id), path, name, 0)


def update_journal(items: DataFrame, path: str, batch: str, revision: int) -> bool:
    """Append the new state of items (operation_id, sequence and all their columns) of a batch as its revision 1, 2, ...; a repeat is ignored."""
    return _commit(items.select("operation_id", "sequence", _payload(items).alias("payload")), path, batch, revision)


def load_journal(spark: SparkSession, path: str) -> DataFrame:
    """The last committed state of all items of a journal; what failed or repeated writers left doesn't count."""
    root = path.rstrip("/")
    kept = _last_whole(spark.read.schema(COMMIT).json(f"{root}/commits"))
    rows = spark.read.parquet(f"{root}/items").join(kept.select(*KEY), KEY, "left_semi")
    # One batch, whole: each item is there once, and nothing has to be brought together.
    told = kept.agg(F.count(F.lit(1)).alias("n"), F.count_if("whole").alias("whole")).first()
    if (told["n"], told["whole"]) == (1, 1):
        return read_journal(rows.select("operation_id", "sequence", "payload"))
    last = rows.groupBy("operation_id", "sequence").agg(F.max_by("payload", "revision").alias("payload"))
    return read_journal(last)


def load_operations(spark: SparkSession, path: str) -> DataFrame:
    """operation_id, created_at and status of all operations of a journal."""
    root = path.rstrip("/")
    commits = spark.read.schema(COMMIT).json(f"{root}/commits").where("revision = 0")
    heads = spark.read.parquet(f"{root}/items").join(commits, ["batch", "attempt", "revision"], "left_semi").groupBy("operation_id").agg(F.min("at").alias("created_at"))
    return heads.join(operation_status(load_journal(spark, path)), "operation_id")


def operation_status(items: DataFrame) -> DataFrame:
    s = F.col("status")
    bad = s.isin("failed", "cancelled") | F.col("error").isNotNull()
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    status = F.when(has(s == "recovery-required"), "recovery-required").when(has(bad), "partial").when(has(s == "undone") & F.coalesce(F.bool_and(s.isin("undone", "skipped")), F.lit(False)), "undone").otherwise("completed")
    return items.groupBy("operation_id").agg(status.alias("status"))


def batch_totals(items: DataFrame) -> DataFrame:
    work = ~F.col("kind").isin("skip", "dates")
    done = F.col("status") == "completed"
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("bytes"))), F.lit(0))
    kind = F.when(F.bool_or(F.col("kind") == "dates"), "dates").when(F.bool_or(F.col("kind") == "move"), "move").otherwise("copy")
    return items.groupBy("operation_id").agg(F.count(F.lit(1)).alias("items"), total(work).alias("bytes"), total(work & done).alias("completed_bytes"), F.count_if(done).alias("undoable"), kind.alias("kind"))


def progress(items: DataFrame) -> DataFrame:
    """Running completed count and bytes by sequence within an operation."""
    w = Window.partitionBy("operation_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    done = F.col("status") == "completed"
    return items.select("operation_id", "sequence", F.sum(done.cast("long")).over(w).alias("completed"), F.sum(F.when(done, F.col("bytes")).otherwise(0)).over(w).alias("completed_bytes"))


def recent_operations(ops: DataFrame, items: DataFrame, n: int = 100) -> DataFrame:
    """The newest n operations with their items' statuses in order."""
    top = ops.orderBy(F.desc("created_at"), F.desc("operation_id")).limit(n)
    held = items.join(top.select("operation_id"), "operation_id", "left_semi").groupBy("operation_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "status"))).alias("_i"))
    return top.join(held, "operation_id", "left").select("operation_id", "created_at", F.array_join(F.transform("_i", lambda x: x["status"]), ",").alias("statuses"))


def incomplete_operations(ops: DataFrame, items: DataFrame) -> DataFrame:
    return ops.join(items.where(F.col("status").isin(*OPEN)), "operation_id", "left_semi")


def pending_reference_changes(ops: DataFrame, items: DataFrame, applied: DataFrame) -> DataFrame:
    moved = items.where(F.col("entry_kind").isin(*FOLDERS) & (F.col("kind") == "rmdir") & F.col("status").isin("completed", "undone"))
    return ops.join(moved, "operation_id", "left_semi").join(applied, "operation_id", "left_anti")


STAMP = ("size", "modified_at", "created_at", "identity", "created_ticks", "modified_ticks")


def detect_drift(expected: DataFrame, current: DataFrame, with_content: bool = True) -> DataFrame:
    """FILE_CHANGED where the file is gone or what both tables have of its stamp (size, dates), identity, exact times or (with_content) digest differs."""
    told = [c for c in (*STAMP, *(["digest"] if with_content else [])) if c in expected.columns and c in current.columns]
    c = current.select(path_key(F.col("path")).alias("_key"), *[F.col(x).alias(f"_{x}") for x in told])
    same = reduce(Column.__and__, [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in told], F.lit(True))
    return expected.join(c, path_key(F.col("path")) == F.col("_key"), "left").select("path", F.when(F.col("_key").isNull() | ~same, "FILE_CHANGED").alias("error"))


def _undo_steps(items: DataFrame, recovery_dir: str) -> DataFrame:
    """Completed items with the keys of the paths that their undo empties (leaves) and fills (enters)."""
    for c in ("old_value", "new_value", "entry_kind", "undo_path", "digest"):
        items = items if c in items.columns else items.withColumn(c, F.lit(None).cast("string"))
    kind = F.col("kind")
    folder = F.coalesce(F.col("entry_kind").isin(*FOLDERS), F.lit(False)) & kind.isin(*STEPS)
    back = F.when(kind == "dates", F.col("old_value")).when(folder & (kind == "mkdir"), None).when(kind == "copy", F.concat(F.lit(recovery_dir + "/"), F.col("destination"))).otherwise(F.col("source"))
    leaves = F.when(~folder | (kind == "mkdir"), path_key(F.col("destination")))
    rows = items.where("status = 'completed'").withColumns({"undo_to": back, "folder": folder, "leaves": leaves})
    return rows.select("operation_id", "sequence", "kind", "digest", "new_value", "folder", "undo_to", "leaves", F.when(kind != "dates", path_key(F.col("undo_to"))).alias("enters"))


def plan_undo(items: DataFrame, current: DataFrame, recovery_dir: str = ".recovery") -> DataFrame:
    """Completed items in reverse order: where each goes back to (dates: their old value), and what blocks it.

    An operation is undone from its last item to its first, and each step sees what the steps before it freed or filled: of
    A -> B and B -> C the second goes back first. A step that is blocked changes nothing. Operations up to LARGE_OPERATION
    steps are replayed in order where their rows are; larger ones, and those that made folders, in rounds over tables. A folder
    that was made goes only if nothing is left in it once the operation's other items are undone."""
    steps = _undo_steps(items, recovery_dir)
    exact = "modified_ticks" in current.columns
    now = current.select(path_key(F.col("path")).alias("key"), "digest", *(["modified_ticks"] if exact else [F.lit(None).cast("string").alias("modified_ticks")])).dropDuplicates(["key"])
    counts = steps.groupBy("operation_id").agg(F.count(F.lit(1)).alias("_n"), F.bool_or(F.col("folder") & (F.col("kind") == "mkdir")).alias("_made"))
    odd = materialized(counts.where((F.col("_n") > LARGE_OPERATION) | F.col("_made")).select("operation_id"))
    if odd.isEmpty():
        return _replayed(steps, now, exact)
    rounds = _in_rounds(steps.join(odd, "operation_id", "left_semi"), materialized(now), exact)
    return _replayed(steps.join(odd, "operation_id", "left_anti"), now, exact).unionByName(rounds)


def _replayed(steps: DataFrame, now: DataFrame, exact: bool) -> DataFrame:
    """plan_undo of operations that fit one task. Only keys go to the catalogue and only what is there comes back, with the operation's first step."""
    keys = steps.select("operation_id", F.explode(F.array_compact(F.array("leaves", "enters"))).alias("key"))
    found = keys.join(now, "key").groupBy("operation_id").agg(F.collect_set(F.struct("key", "digest", "modified_ticks")).alias("found"))
    order = Window.partitionBy("operation_id").orderBy(F.desc("sequence"))
    rows = steps.withColumn("_first", F.row_number().over(order) == 1)
    found = found.withColumnRenamed("operation_id", "_op")
    rows = rows.join(found, F.col("_first") & (F.col("operation_id") == F.col("_op")), "left").drop("_op", "_first")
    rows = rows.withColumn("undo_order", F.row_number().over(order))  # the window keeps an operation in one task and in order
    kind = {f.name: f.dataType.simpleString() for f in steps.schema}
    told = f"operation_id {kind['operation_id']}, sequence {kind['sequence']}, undo_order int, undo_to string, error string"

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, ticks = {}, {}
        for batch in batches:
            errors = []
            columns = [batch.column(c).to_pylist() for c in ("undo_order", "found", "kind", "folder", "digest", "new_value", "leaves", "enters")]
            for place, found, kind, folder, digest, value, leaves, enters in zip(*columns, strict=True):
                if place == 1:
                    state = {f["key"]: f["digest"] for f in found or ()}
                    ticks = {f["key"]: f["modified_ticks"] for f in found or ()} if exact else {}
                error = None
                if enters is not None and enters in state:
                    error = "DESTINATION_EXISTS"
                elif not folder and (leaves not in state or state[leaves] != digest or (exact and kind == "dates" and ticks.get(leaves) != value)):
                    error = "FILE_CHANGED"
                elif kind != "dates":
                    state.pop(leaves, None)
                    if enters is not None:
                        state[enters] = digest
                errors.append(error)
            kept = [batch.column(c) for c in ("operation_id", "sequence", "undo_order", "undo_to")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(errors, pa.string())], ["operation_id", "sequence", "undo_order", "undo_to", "error"])

    return rows.mapInArrow(replay, told)


def _in_rounds(steps: DataFrame, now: DataFrame, exact: bool) -> DataFrame:
    """plan_undo of operations of any size: a step is decided once all later items of its operation on the same paths are, so there are as many rounds as an operation moved one file."""
    spark = steps.sparkSession
    order = F.row_number().over(Window.partitionBy("operation_id").orderBy(F.desc("sequence")))
    rest = steps = materialized(steps.withColumn("undo_order", order))
    own = steps.schema["operation_id"].dataType.simpleString()
    changed = Grown(spark, f"operation_id {own}, key string, sequence long, there boolean, digest string")
    done = Grown(spark, f"operation_id {own}, sequence long, error string")
    made = steps.where("folder and kind = 'mkdir'").select("operation_id", F.col("leaves").alias("_dir"))
    has_folders = not made.isEmpty()
    while True:
        keys = rest.select("operation_id", "sequence", F.explode(F.array_compact(F.array("leaves", "enters"))).alias("key"))
        last = keys.groupBy("operation_id", "key").agg(F.max("sequence").alias("_last"))
        front = keys.join(last, ["operation_id", "key"]).groupBy("operation_id", "sequence").agg(F.bool_and(F.col("sequence") == F.col("_last")).alias("ready"))
        rows = rest.join(front, ["operation_id", "sequence"], "left").withColumn("ready", F.coalesce("ready", F.lit(True)))
        state = changed.table().groupBy("operation_id", "key").agg(F.min_by(F.struct("there", "digest"), "sequence").alias("s"))
        if has_folders:
            inner = keys.select("operation_id", F.col("key").alias("_key"), F.explode(ancestors(F.col("key"), itself=False)).alias("_dir")).join(made, ["operation_id", "_dir"])
            waits = inner.join(made.select("operation_id", F.col("_dir").alias("_key")), ["operation_id", "_key"], "left_anti").select("operation_id", F.col("_dir").alias("leaves"), F.lit(True).alias("_waits")).distinct()
            rows = rows.join(waits, ["operation_id", "leaves"], "left").withColumn("ready", F.col("ready") & (F.col("_waits").isNull() | (F.col("kind") != "mkdir"))).drop("_waits")
        rows = materialized(rows)
        go = rows.where("ready")
        side = lambda name: state.select("operation_id", F.col("key").alias(name), F.col("s").alias(f"_{name}"))
        was = lambda name: now.select(F.col("key").alias(name), F.lit(True).alias(f"_{name}_there"), F.col("digest").alias(f"_{name}_digest"), F.col("modified_ticks").alias(f"_{name}_ticks"))
        for name in ("leaves", "enters"):
            go = go.join(side(name), ["operation_id", name], "left").join(was(name), name, "left")
        there = lambda name: F.coalesce(F.col(f"_{name}.there"), F.col(f"_{name}_there"), F.lit(False))
        found = F.when(F.col("_leaves").isNotNull(), F.col("_leaves.digest")).otherwise(F.col("_leaves_digest"))
        drifted = ~there("leaves") | ~found.eqNullSafe(F.col("digest"))
        if exact:
            drifted |= (F.col("kind") == "dates") & ~F.col("_leaves_ticks").eqNullSafe(F.col("new_value"))
        go = go.withColumn("_full", F.lit(False))
        if has_folders:
            entries = now.select(F.col("key").alias("_key"), F.explode(ancestors(F.col("key"), itself=False)).alias("_dir")).join(made, "_dir")
            later = changed.table().groupBy("operation_id", "key").agg(F.min_by("there", "sequence").alias("there"))
            gone = later.where("not there").select("operation_id", F.col("key").alias("_key"))
            came = later.where("there").select("operation_id", F.col("key").alias("_key"), F.explode(ancestors(F.col("key"), itself=False)).alias("_dir")).join(made, ["operation_id", "_dir"])
            left = entries.select("operation_id", "_dir", "_key").join(gone, ["operation_id", "_key"], "left_anti").unionByName(came.select("operation_id", "_dir", "_key"))
            left = left.join(made.select("operation_id", F.col("_dir").alias("_key")), ["operation_id", "_key"], "left_anti")
            full = left.select("operation_id", F.col("_dir").alias("leaves"), F.lit(True).alias("_more")).distinct()
            go = go.join(full, ["operation_id", "leaves"], "left").withColumn("_full", F.coalesce("_more", F.lit(False)))
        made_one = F.col("folder") & (F.col("kind") == "mkdir")
        error = F.when(made_one & F.col("_full"), "DIRECTORY_NOT_EMPTY").when(F.col("enters").isNotNull() & there("enters"), "DESTINATION_EXISTS").when(~F.col("folder") & drifted, "FILE_CHANGED")
        told = materialized(go.select("operation_id", "sequence", "kind", "digest", "leaves", "enters", error.alias("error")))
        done.add(told)
        rest = rows.where("not ready").select(steps.columns)
        if rest.isEmpty():
            break
        moved = told.where("error is null and kind <> 'dates'").select("operation_id", "sequence", "digest", F.explode(F.array(F.struct(F.col("leaves").alias("key"), F.lit(False).alias("there")), F.struct(F.col("enters").alias("key"), F.lit(True).alias("there")))).alias("k"))
        changed.add(moved.select("operation_id", "k.key", "sequence", "k.there", F.when(F.col("k.there"), F.col("digest")).alias("digest")).where("key is not null"))
    return steps.join(done.table(), ["operation_id", "sequence"]).select("operation_id", "sequence", "undo_order", "undo_to", "error")


def recover_journal(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """What became of interrupted items, from what exists now: planned ones failed; a folder that was begun needs recovery; others by where
    the file is on its way (undoing: back), where it is there unchanged; dates by the exact time that the file has."""
    for c in ("undo_path", "old_value", "new_value", "digest"):
        items = items if c in items.columns else items.withColumn(c, F.lit(None).cast("string"))
    now = catalog.select(path_key(F.col("path")).alias("_key"), F.col("digest").alias("_d"), (F.col("modified_ticks") if "modified_ticks" in catalog.columns else F.lit(None).cast("string")).alias("_t")).dropDuplicates(["_key"])
    undoing, kind = F.col("status") == "undo-pending", F.col("kind")
    start = F.when(undoing, F.col("destination")).otherwise(F.col("source"))
    goal = F.when(undoing, F.coalesce("undo_path", "source")).otherwise(F.col("destination"))
    rows = items.where(F.col("status").isin(*OPEN)).withColumns({"_from": path_key(start), "_to": F.when(kind == "dates", path_key(F.col("destination"))).otherwise(path_key(goal))})
    a, b = (now.select(F.col("_key").alias(k), F.lit(True).alias(f"{k}_there"), F.col("_d").alias(f"{k}_digest"), F.col("_t").alias(f"{k}_ticks")) for k in ("_from", "_to"))
    rows = rows.join(a, "_from", "left").join(b, "_to", "left")
    here, gone = F.col("_from_there").isNotNull(), F.col("_from_there").isNull()
    there, same = F.col("_to_there").isNotNull(), F.col("_to_digest").eqNullSafe(F.col("digest"))
    dates, whole = kind == "dates", F.when(undoing, "undone").otherwise("completed")
    short = F.when(undoing, "completed").otherwise("failed")
    value = lambda done: F.col("_to_ticks").eqNullSafe(F.when(undoing == F.lit(done), F.col("old_value")).otherwise(F.col("new_value")))
    new = F.when(F.col("status") == "planned", "failed").when(dates, F.when(there & value(True) & same, whole).when(there & value(False) & same, short).otherwise("recovery-required"))
    new = new.when(F.col("entry_kind").isin(*FOLDERS), "recovery-required").when(there & (gone | (~undoing & (kind == "copy"))), F.when(same, whole).otherwise("recovery-required")).when(here & ~there, short).otherwise("recovery-required")
    fine = (new == whole) & (F.col("status") != "planned")
    return rows.select("operation_id", "sequence", new.alias("status"), F.when(~fine, "INTERRUPTED_OPERATION").alias("error"))


def plan_date_fix(files: DataFrame) -> DataFrame:
    """modified := created, exact ticks; skipped where equal, repeated or without a creation date."""
    made, changed = ticks(F.col("created_ticks")), ticks(F.col("modified_ticks"))
    rank = F.row_number().over(Window.partitionBy("identity").orderBy("path"))
    none = made.isNull() | (made == 0)
    skip = none | (made == changed) | (F.col("identity").isNotNull() & (rank > 1))
    return files.select("path", F.when(skip, "skip").otherwise("dates").alias("action"), F.when(none, "INVALID_DATE").alias("error"), F.when(~skip, F.col("created_ticks")).alias("new_ticks"))


def date_fix_counts(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count_if(F.col("action") == "dates").alias("changes"), F.count_if(F.col("action") == "skip").alias("skipped"))
