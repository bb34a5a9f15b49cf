"""Journals on disk, undo in reverse order, recovery, and durable stores."""

import json
import random

import pytest
from pyspark.sql import functions as F

from curatrix.operators import journal, media, stores

ITEMS = "operation_id string, sequence long, source string, destination string, kind string, entry_kind string, status string, digest string, old_value string, new_value string"


def items(spark, rows, op="o"):
    return spark.createDataFrame([(op, k, s, d, kind, "directory" if kind in ("mkdir", "rmdir") else "file", "completed", g, *(more or (None, None))) for k, (s, d, kind, g, *more) in enumerate(rows)], ITEMS)


def undone(spark, rows, current, columns="path string, digest string"):
    got = journal.plan_undo(items(spark, rows), spark.createDataFrame(current, columns)).orderBy("undo_order").collect()
    assert [r["sequence"] for r in got] == list(range(len(rows)))[::-1]
    return {r["sequence"]: r["error"] for r in got}


def test_chains_and_swaps_are_undone(spark):
    assert undone(spark, [("/A", "/B", "move", "x"), ("/B", "/C", "move", "x")], [("/C", "x")]) == {0: None, 1: None}
    assert undone(spark, [("/A", "/B", "move", "x"), ("/C", "/A", "move", "y")], [("/b", "x"), ("/a", "y")]) == {0: None, 1: None}
    swap = [("/A", "/T", "move", "x"), ("/B", "/A", "move", "y"), ("/T", "/B", "move", "x")]
    assert undone(spark, swap, [("/A", "y"), ("/B", "x")]) == {0: None, 1: None, 2: None}
    # A step that is blocked changes nothing: what depends on it is blocked too.
    assert undone(spark, swap, [("/A", "y"), ("/B", "other")]) == {2: "FILE_CHANGED", 1: "DESTINATION_EXISTS", 0: "DESTINATION_EXISTS"}
    assert undone(spark, swap, [("/A", "y"), ("/B", "x"), ("/T", "z")]) == {k: "DESTINATION_EXISTS" for k in range(3)}


def test_folders_and_dates_are_undone(spark):
    rows = [(None, "/n", "mkdir", None), (None, "/n/m", "mkdir", None), ("/a", "/n/m/a", "move", "x"), ("/old", None, "rmdir", None), ("/d", "/d", "dates", "g", "5", "9")]
    now = [("/n/m/a", "x", None), ("/d", "g", "9")]
    columns = "path string, digest string, modified_ticks string"
    assert set(undone(spark, rows, now, columns).values()) == {None}
    assert undone(spark, rows, [*now, ("/n/m/new", "q", None)], columns) == {0: "DIRECTORY_NOT_EMPTY", 1: "DIRECTORY_NOT_EMPTY", 2: None, 3: None, 4: None}
    assert undone(spark, rows, [("/n/m/a", "changed", None), ("/d", "g", "8"), ("/old", "z", None)], columns) == {0: "DIRECTORY_NOT_EMPTY", 1: "DIRECTORY_NOT_EMPTY", 2: "FILE_CHANGED", 3: "DESTINATION_EXISTS", 4: "FILE_CHANGED"}


def test_undo_equals_one_step_after_the_other(spark):
    rng = random.Random(8)
    rows, now, here = [], {}, {f"/p{k}": f"d{k}" for k in range(5)}
    for _ in range(25):  # a run of moves that really happened, then some interference
        a = rng.choice(sorted(here))
        b = rng.choice([f"/p{k}" for k in range(9) if f"/p{k}" not in here])
        here[b] = here.pop(a)
        rows.append((a, b, "move", here[b]))
    here[rng.choice(sorted(here))] = "interfered"
    now, want = dict(here), {}
    for k in reversed(range(len(rows))):
        a, b, _, g = rows[k]
        want[k] = "DESTINATION_EXISTS" if a in now else "FILE_CHANGED" if now.get(b) != g else None
        if want[k] is None:
            now[a] = now.pop(b)
    assert undone(spark, rows, list(here.items())) == want and None in want.values() and set(want.values()) - {None}


def test_journal_survives_repeats_and_failed_writers(spark, tmp_path):
    where = f"{tmp_path}/journal"
    plan = spark.createDataFrame([(1, "mkdir", None, "/n", None, None, "directory"), (2, "move", "/a", "/n/a", 5, "x", "file"), (3, "skip", "/b", "/n/b", 7, "y", "file")], "seq long, action string, source string, destination string, bytes long, digest string, entry_kind string")
    assert journal.write_journal(plan, "op/1", where) and not journal.write_journal(plan, "op/1", where)
    # A writer that wrote its rows and died before its record.
    journal.journal_rows(plan, "op/2").withColumns({"revision": F.lit(0).cast("long"), "at": F.current_timestamp(), "batch": F.lit("op/2"), "attempt": F.lit("dead")}).write.mode("append").parquet(f"{where}/items")
    got = journal.load_journal(spark, where).orderBy("sequence").collect()
    assert [(r["operation_id"], r["kind"], r["entry_kind"], r["status"], r["digest"]) for r in got] == [("op/1", "mkdir", "directory", "planned", None), ("op/1", "move", "file", "planned", "x"), ("op/1", "skip", "file", "skipped", "y")]
    ran = journal.load_journal(spark, where).withColumn("status", F.when(F.col("status") == "planned", "completed").otherwise(F.col("status")))
    assert journal.update_journal(ran, where, "op/1", 1) and not journal.update_journal(ran, where, "op/1", 1)
    undo = journal.plan_undo(journal.load_journal(spark, where), spark.createDataFrame([("/n/a", "x")], "path string, digest string"))
    assert {(r["sequence"], r["undo_to"], r["error"]) for r in undo.collect()} == {(1, None, None), (2, "/a", None)}
    assert [(r["operation_id"], r["status"]) for r in journal.load_operations(spark, where).collect()] == [("op/1", "completed")]


def test_recovery_both_ways(spark):
    rows = [("/a", "/b", "pending", None), ("/c", "/d", "undo-pending", None), ("/e", "/f", "undo-pending", None), ("/g", "/h", "undo-pending", "/kept/h"), ("/i", "/j", "pending", None), ("/k", "/l", "planned", None)]
    df = spark.createDataFrame([("o", k, s, d, "move", "file", st, f"x{k}", u) for k, (s, d, st, u) in enumerate(rows)], "operation_id string, sequence long, source string, destination string, kind string, entry_kind string, status string, digest string, undo_path string")
    now = spark.createDataFrame([("/b", "x0"), ("/c", "x1"), ("/f", "x2"), ("/kept/h", "x3"), ("/j", "other"), ("/k", "x5")], "path string, digest string")
    got = {r["sequence"]: (r["status"], r["error"]) for r in journal.recover_journal(df, now).collect()}
    late = "INTERRUPTED_OPERATION"
    assert got == {0: ("completed", None), 1: ("undone", None), 2: ("completed", late), 3: ("undone", None), 4: ("recovery-required", late), 5: ("failed", late)}
    dates = spark.createDataFrame([("o", k, "/d", "/d", "dates", "file", st, "g", "5", "9") for k, st in enumerate(["pending", "undo-pending"])], "operation_id string, sequence long, source string, destination string, kind string, entry_kind string, status string, digest string, old_value string, new_value string")
    at = lambda t: [(r["status"], r["error"]) for r in journal.recover_journal(dates, spark.createDataFrame([("/d", "g", t)], "path string, digest string, modified_ticks string")).orderBy("sequence").collect()]
    assert at("9") == [("completed", None), ("completed", late)] and at("5") == [("failed", late), ("undone", None)] and at("7") == [("recovery-required", late)] * 2


def test_drift_looks_at_all_dates_and_exact_times(spark):
    schema = "path string, size long, modified_at long, created_at long, identity string, modified_ticks string, digest string"
    row = ("/a", 1, 2, 3, "i", "20000001", "d")
    before = spark.createDataFrame([row], schema)
    drift = lambda **more: journal.detect_drift(before, spark.createDataFrame([tuple(more.get(c, v) for c, v in zip(before.columns, row, strict=True))], schema)).first()["error"]
    assert drift() is None and {drift(**{c: v}) for c, v in (("size", 9), ("created_at", 9), ("modified_ticks", "20000002"), ("identity", "j"), ("digest", "e"))} == {"FILE_CHANGED"}


def test_of_two_writers_one_is_refused(spark, tmp_path):
    store = stores.Store(spark, f"{tmp_path}/marks", stores.MARKS)
    marks = lambda *x: spark.createDataFrame([(v,) for v in x], stores.MARKS)
    rows, known = store.read()
    assert rows.isEmpty() and store.write(marks("a"), known) == 1
    with pytest.raises(stores.StaleVersion):
        store.write(marks("b"), known)
    assert [r["digest"] for r in store.read()[0].collect()] == ["a"]
    # A change that fails while it is written, and one whose record was never finished, leave the old version.
    with pytest.raises(Exception, match="no way"):
        store.change(lambda rows: rows.select(F.raise_error(F.lit("no way")).cast("string").alias("digest")))
    open(f"{tmp_path}/marks/versions/000000000002", "w").close()
    assert [r["digest"] for r in store.read()[0].collect()] == ["a"]
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, digest string")
    assert store.change(lambda rows: media.set_protection(rows, table, table.where("id = 2").select("id"), True)) == 3
    assert sorted(r["digest"] for r in store.read()[0].collect()) == ["a", "b"]
    assert json.loads(open(f"{tmp_path}/marks/versions/000000000003").read())["rows"]


def test_replay_and_rounds_agree_on_many_operations(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for op in range(40):
        for k in range(rng.randint(1, 9)):
            a, b = (f"/p{rng.randrange(6)}" for _ in range(2))
            kind = rng.choice(["move", "move", "copy", "dates", "rmdir"])
            rows.append((f"o{op}", k, a, None if kind == "rmdir" else b, kind, "directory" if kind == "rmdir" else "file", rng.choice(["completed"] * 4 + ["planned"]), rng.choice(["x", "y", None]), "5", rng.choice(["8", "9"])))
    df = spark.createDataFrame(rows, ITEMS)
    now = spark.createDataFrame([(f"/P{k}", rng.choice(["x", "y", None]), "9") for k in range(5)], "path string, digest string, modified_ticks string")
    rounds = []
    in_rounds = journal._in_rounds
    monkeypatch.setattr(journal, "_in_rounds", lambda *args: rounds.append(1) or in_rounds(*args))
    told = lambda: sorted(map(tuple, journal.plan_undo(df, now).collect()), key=repr)
    replayed = told()
    assert not rounds  # no loop over tables for operations that fit one task
    monkeypatch.setattr(journal, "LARGE_OPERATION", 4)
    assert told() == replayed and rounds
    assert {r[4] for r in replayed} == {None, "FILE_CHANGED", "DESTINATION_EXISTS"}


def test_partial_revisions_keep_the_other_items(spark, tmp_path):
    where = f"{tmp_path}/journal"
    plan = spark.createDataFrame([(k, "move", f"/a{k}", f"/b{k}") for k in range(4)], "seq long, action string, source string, destination string")
    assert journal.write_journal(plan, "o", where)
    state = lambda: {r["sequence"]: r["status"] for r in journal.load_journal(spark, where).collect()}
    whole = lambda n: json.loads(open(f"{where}/commits/o.{n}.json").read())["whole"]
    set_to = lambda which, status, n: journal.update_journal(journal.load_journal(spark, where).where(which).withColumn("status", F.lit(status)), where, "o", n)
    assert set_to("sequence < 2", "pending", 1) and state() == {0: "pending", 1: "pending", 2: "planned", 3: "planned"}
    assert set_to("true", "completed", 2) and state() == dict.fromkeys(range(4), "completed")
    # A whole revision is read without bringing rows together; a partial one, or one after a gap, isn't whole.
    assert "max_by" not in journal.load_journal(spark, where)._jdf.queryExecution().executedPlan().toString()
    assert set_to("true", "undone", 4) and set_to("sequence = 3", "failed", 5) and state() == {0: "undone", 1: "undone", 2: "undone", 3: "failed"}
    assert [whole(n) for n in (0, 1, 2, 4, 5)] == [True, False, True, False, False]
    assert journal.write_journal(plan, "p", where) and journal.load_journal(spark, where).count() == 8
