"""Files organised as a stream whose rules change: a revision of the rules is a row of the stream like any other.

Paths are dealt to buckets, and a bucket's state holds its files and the rules that it knows. A file's row touches its own
bucket; a revision goes to all of them and has each match anew the files that were decided already. So nothing is read again
from tables, and what a revision changes is what is written."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from curatrix.operators.rules import DateRule

BUCKETS = 64
DECIDED = ("matched", "needs-review", "ready")
ROWS = "path string, observed_at timestamp, status string, created date, modified date, accessed date, revision long, rules string"
OUT = "path string, observed_at timestamp, revision long, step int, status string, error string, rule_id string, rule_name string, destination string, date_source string, date_used string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def revision_row(spark: SparkSession, number: int, rules: list[DateRule], at) -> DataFrame:
    """The row that brings revision `number` of the rules into the stream at a time. A revision not above the last one says nothing."""
    return spark.createDataFrame([(None, at, None, None, None, None, number, json.dumps([asdict(r) for r in rules]))], ROWS)


def outcome(rules: list[dict], dates: dict[str, str | None]) -> tuple:
    """status, error, rule_id, rule_name, destination, date_source, date_used of a file by its days: as match_rules gives them."""
    hits = [r for r in rules if r["enabled"] and dates[r["date_source"]] and r["start_date"] <= dates[r["date_source"]] <= r["end_date"]]
    if len(hits) != 1:
        return ("needs-review", "MULTIPLE_RULE_MATCHES" if hits else None, None, None, None, None, None)
    r = hits[0]
    return ("matched", None, r["id"], r["name"], r["destination"], r["date_source"], dates[r["date_source"]])


class Organizer(StatefulProcessor):
    """A bucket: files (path: status and days) and the last revision of the rules."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getMapState("files", "path string", "status string, created string, modified string, accessed string")
        self.known = handle.getValueState("rules", "revision long, rules string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.known.get() if self.known.exists() else None
        revision, rules = (held[0], json.loads(held[1])) if held else (0, [])
        out: list[tuple] = []
        table = pd.concat(list(rows)).sort_values(["observed_at", "step", "revision"], kind="stable")
        for r in table.itertuples():
            if r.step == 0:
                if int(r.revision) > revision:
                    old, revision, rules = rules, int(r.revision), json.loads(r.rules)
                    self.known.update((revision, r.rules))
                    out += self.again(old, rules, r.observed_at, revision)
                continue
            if r.status == "gone":
                if self.files.containsKey((r.path,)):
                    self.files.removeKey((r.path,))
                out.append((r.path, r.observed_at, revision, 1, "gone", *[None] * 6))
                continue
            days = [None if pd.isna(x) else str(x)[:10] for x in (r.created, r.modified, r.accessed)]
            before = self.files.getValue((r.path,)) if self.files.containsKey((r.path,)) else None
            self.files.updateValue((r.path,), (r.status, *days))
            if r.status not in DECIDED:
                out.append((r.path, r.observed_at, revision, 1, r.status, *[None] * 6))
            elif before is None or before[0] not in DECIDED or list(before[1:3]) != days[:2] or (before[3] != days[2] and any(x["enabled"] and x["date_source"] == "accessed" for x in rules)):
                out.append((r.path, r.observed_at, revision, 1, *outcome(rules, self.named(days))))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def named(self, days) -> dict:
        return dict(zip(("created", "modified", "accessed"), days, strict=True))

    def again(self, old: list[dict], new: list[dict], at, revision: int) -> Iterator[tuple]:
        """What a revision changes for the bucket's decided files."""
        for (path,), (status, *days) in self.files.iterator():
            if status in DECIDED:
                told = outcome(new, self.named(days))
                if told != outcome(old, self.named(days)):
                    yield (path, at, revision, 0, *told)

    def close(self) -> None:
        pass


def organize_revisions(stream: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """stream (of ROWS) -> a row per decision and change of one, in append mode. The session's state store has to be PROVIDER = ROCKS."""
    control = F.col("rules").isNotNull()
    every = F.when(control, F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")))
    days = [F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("created", "modified", "accessed")]
    rows = stream.select(F.explode(every).alias("bucket"), "path", "observed_at", "status", *days, F.coalesce("revision", F.lit(0)).alias("revision"), "rules", F.when(control, 0).otherwise(1).alias("step"))
    return rows.groupBy("bucket").transformWithStateInPandas(Organizer(), OUT, "Append", "None")


def replay(stream: DataFrame, sink: str, checkpoint: str, buckets: int = BUCKETS):
    """Start organize_revisions into a table of parquet files; all that is there is worked off. The session's own state store is set again afterwards."""
    conf = stream.sparkSession.conf
    kept = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKS)
    try:
        return organize_revisions(stream, buckets).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER, kept)


def last_decisions(decisions: DataFrame) -> DataFrame:
    """The last row of each path that isn't gone."""
    fields = [c.split()[0] for c in OUT.split(", ")]
    last = decisions.groupBy("path").agg(F.max_by(F.struct(*fields[1:]), F.struct("observed_at", "revision", "step")).alias("d"))
    return last.select("path", "d.*").where("status <> 'gone'")
