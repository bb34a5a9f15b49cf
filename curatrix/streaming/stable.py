"""Which observed files are stable: a keyed stream, and the same rule over a bounded table."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from curatrix.functions.scalars import file_name, is_temporary

STABLE_SECONDS = 3
MAX_RETRIES = 8
STATUS = "path string, observed_at timestamp, status string, retries int, error string"
BUCKETS = 1024  # of paths: a call of the stream's step costs some 15 ms, whatever it is given
READ = ["path", "at", "size", "modified_at", "locked", "present", "temporary", "retry"]
STATE = "files string"  # as JSON, by path: size, modified_at, since, last, retries, done


def stable_files(observations: DataFrame, stable_seconds: int = STABLE_SECONDS, max_retries: int = MAX_RETRIES, watermark: str = "10 minutes") -> DataFrame:
    """observations (path, observed_at, size, modified_at, locked, present) as a stream -> a row per change of status.

    A new stamp restarts the timer; after stable_seconds without change a file that isn't temporary is ready at its first
    unlocked reading, and failed at its max_retries-th locked one. present = false ends the path's state, and so does the
    watermark. Observations older than the state's last are late and dropped. A row with retry = true (an optional column) is a
    control row: a failed path waits again from then on, with no retries counted; for others it says nothing.

    Paths are dealt to BUCKETS, whose state holds them: a batch costs its rows and the buckets that these are in."""
    temporary = is_temporary(file_name(F.col("path")))
    control = F.coalesce(F.col("retry"), F.lit(False)) if "retry" in observations.columns else F.lit(False)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        files = json.loads(state.get[0]) if state.exists else {}
        seen, out = set(), []
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values("at", kind="stable")
            for path, *r in zip(*[rows[c].tolist() for c in READ], strict=True):
                seen.add(path)
                held = follow(files.get(path), path, *r, out)
                if held is None:
                    files.pop(path, None)
                else:
                    files[path] = held
        now = state.getCurrentWatermarkMs()
        for path in [p for p, held in files.items() if p not in seen and ends(held) < now]:
            del files[path]
        if files:
            state.update((json.dumps(files),))
            state.setTimeoutTimestamp(max(now, min(ends(held) for held in files.values())))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["path", "at", "status", "retries", "error"])

    def ends(held: list) -> int:
        return held[3] // 1000 + 86_400_000

    def follow(held: list | None, path: str, at: int, size: str, modified_at: str, locked: bool, present: bool, temporary: bool, retry: bool, out: list) -> list | None:
        """A path's state (size, modified_at, since, last, retries, done) after an observation; what it changes is added to out."""
        if retry:
            if held and held[5] and held[4] >= max_retries:
                held = [*held[:2], at, at, 0, False]
                out.append((path, at, "waiting", 0, None))
            return held
        if held and at < held[3]:
            return held
        if not present:
            return None
        if held is None or held[:2] != [size, modified_at]:
            out.append((path, at, "detected", 0, None))
            return [size, modified_at, at, at, 0, False]
        held[3] = at
        if held[5] or temporary or at - held[2] < stable_seconds * 1_000_000:
            return held
        if not locked:
            held[5] = True
            out.append((path, at, "ready", held[4], None))
        else:
            held[4] += 1
            if held[4] >= max_retries:
                held[5] = True
                out.append((path, at, "failed", held[4], "FILE_LOCKED"))
        return held

    bucket = F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int").alias("bucket")
    stamp = [F.col(c).cast("string").alias(c) for c in ("size", "modified_at")]
    rows = observations.withWatermark("observed_at", watermark).select(bucket, "path", "observed_at", F.unix_micros("observed_at").alias("at"), *stamp, "locked", "present", temporary.alias("temporary"), control.alias("retry"))
    told = rows.groupBy("bucket").applyInPandasWithState(step, "path string, at long, status string, retries int, error string", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return told.select("path", F.timestamp_micros("at").alias("observed_at"), "status", "retries", "error")


def stable_files_batch(observations: DataFrame, stable_seconds: int = STABLE_SECONDS, max_retries: int = MAX_RETRIES) -> DataFrame:
    """One row per path and segment (between changes of stamp): status, since, decided_at, locked readings before."""
    by = Window.partitionBy("path").orderBy("observed_at", "modified_at")
    changed = ~F.lag("size").over(by).eqNullSafe(F.col("size")) | ~F.lag("modified_at").over(by).eqNullSafe(F.col("modified_at")) | (F.row_number().over(by) == 1)
    seg = observations.withColumn("segment", F.sum(changed.cast("int")).over(by))
    inside = Window.partitionBy("path", "segment")
    seg = seg.withColumn("since", F.min("observed_at").over(inside))
    counts = (F.unix_micros("observed_at") - F.unix_micros("since") >= stable_seconds * 1_000_000) & ~is_temporary(file_name(F.col("path")))
    ordered = inside.orderBy("observed_at", "modified_at").rowsBetween(Window.unboundedPreceding, 0)
    seg = seg.withColumn("_counts", counts).withColumn("_locked", F.sum((F.col("_counts") & F.col("locked")).cast("int")).over(ordered))
    ok = F.min(F.when(F.col("_counts") & ~F.col("locked") & (F.col("_locked") < max_retries), F.col("observed_at")))
    bad = F.min(F.when(F.col("_counts") & F.col("locked") & (F.col("_locked") == max_retries), F.col("observed_at")))
    out = seg.groupBy("path", "segment").agg(F.min("since").alias("since"), ok.alias("_ok"), bad.alias("_bad"))
    ready = F.col("_ok").isNotNull() & (F.col("_bad").isNull() | (F.col("_ok") < F.col("_bad")))
    return out.select("path", "segment", "since", F.when(ready, "ready").when(F.col("_bad").isNotNull(), "failed").otherwise("waiting").alias("status"), F.when(ready, F.col("_ok")).otherwise(F.col("_bad")).alias("decided_at"))


def organize_stream(stable: DataFrame, rules, sink: str, checkpoint: str):
    """Match ready files of a stream against the rules (map-side) into a table; a repeated batch overwrites its own folder."""
    from curatrix.operators.rules import match_rules

    def put(batch: DataFrame, number: int) -> None:
        match_rules(batch.where("status = 'ready'"), rules).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stable.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reevaluate(inbox: DataFrame, rules) -> DataFrame:
    """inbox (status, dates, what match_rules adds) after the rules have changed: only decided or ready rows are matched anew."""
    from curatrix.operators.rules import match_rules

    decided = F.col("status").isin("matched", "needs-review", "ready")
    added = ("error", "rule_id", "rule_name", "destination", "date_source", "date_used")
    again = match_rules(inbox.where(decided).drop("status", *added), rules)
    return again.select(inbox.columns).unionByName(inbox.where(~decided | F.col("status").isNull()))


def accessed_matters(rules) -> bool:
    """Whether a change of the accessed date alone calls for a new evaluation: only if an enabled rule uses that date."""
    return any(r.enabled and r.date_source == "accessed" for r in rules)


def retry_failed(state: DataFrame) -> DataFrame:
    """Failed files wait again, with no retries counted."""
    failed = F.col("status") == "failed"
    return state.withColumns({"retries": F.when(failed, 0).otherwise(F.col("retries")), "error": F.when(failed, None).otherwise(F.col("error")), "status": F.when(failed, "waiting").otherwise(F.col("status"))})
