"""Plans: items in waves against one item after the other, media and folder transfers, headers."""

import random
import re
from itertools import count

import pytest
from pyspark.sql import functions as F

from curatrix.functions.names import Preset
from curatrix.plans import resolve

KEEPS, REPLACES = ("skip", "keep-existing"), ("keep-incoming", "replace-existing")


class Desk:
    """What earlier items did: names taken, contents planned, files to be backed up."""

    def __init__(self, items, library):
        self.names = {p.lower() for p, _ in library}
        sources = {i["source"].lower() for i in items}
        self.copies = {}
        for p, d in sorted(library, key=lambda x: x[0].lower()):
            if p.lower() not in sources:
                self.copies.setdefault(d, []).append(p)
        self.exists = {p.lower(): p for p, _ in library}
        self.taken, self.planned, self.retired = set(), set(), set()

    def free(self, path):
        return path.lower() not in self.names and path.lower() not in self.taken

    def numbered(self, path):
        folder, name = re.fullmatch(r"(.*/)?([^/]*)", path).groups()
        stem, ext = re.fullmatch(r"(.+?)(\.[^.]*)?", name).groups() if re.fullmatch(r".+\.[^.]*", name) else (name, "")
        stem, ext = (name.rpartition(".")[0], "." + name.rpartition(".")[2]) if ext else (name, "")
        return next(p for p in (f"{folder or ''}{stem} ({n}){ext}" for n in count(1)) if self.free(p))

    def decide(self, item):
        """target, action, error and the files to back up."""
        target, what, policy, backups = item["destination"], item["duplicate_action"], item["policy"], set()
        own = [p for p in self.copies.get(item["digest"], []) if p.lower() not in self.retired]
        planned = item["digest"] in self.planned
        if what not in (*KEEPS, *REPLACES, "keep-both"):
            return target, "move", "INVALID_TRANSFER", backups
        if own or planned:
            if what in KEEPS:
                return target, "skip", None, backups
            if what in REPLACES and planned:
                return target, "move", "DUPLICATE_ACTION_UNAVAILABLE", backups
            policy = "keep-both" if what == "keep-both" else policy
            backups = set(own if what == "keep-incoming" else own[:1] if what == "replace-existing" else [])
            target = own[0] if what == "replace-existing" else target
        if self.free(target) or target in backups:
            return target, "move", None, backups
        if policy == "skip":
            return target, "skip", None, set()
        if policy == "keep-both":
            return self.numbered(target), "move", None, backups
        if target.lower() in self.taken:
            return target, "move", "TARGET_RESERVED", set()
        return target, "move", None, backups | {self.exists[target.lower()]}

    def rows(self, item):
        conflict = not self.free(item["destination"])
        target, action, error, backups = self.decide(item)
        out = []
        if action == "move" and error is None:
            for p in sorted(backups):
                if p.lower() not in self.retired:
                    self.retired.add(p.lower())
                    out.append((item["seq"], p, f"{p.rpartition('/')[0]}/.recovery/{item['seq']}-{p.rpartition('/')[2]}", "move", True, False, None))
            self.taken.add(target.lower())
            self.planned.add(item["digest"])
        return [*out, (item["seq"], item["source"], target, action, False, conflict, error)]


def planned(items, library):
    desk = Desk(items, library)
    return sorted((r for i in sorted(items, key=lambda i: i["seq"]) for r in desk.rows(i)), key=repr)


def resolved(spark, items, library):
    df = spark.createDataFrame([(i["seq"], i["source"], i["destination"], i["digest"]) for i in items], "seq long, source string, destination string, digest string")
    o = spark.createDataFrame([(i["source"], i["policy"], i["duplicate_action"]) for i in items], "source string, policy string, duplicate_action string")
    got = resolve.resolve_items(df, spark.createDataFrame(library, "path string, digest string"), overrides=o)
    return sorted((tuple(r) for r in got.select("seq", "source", "destination", "action", "backup", "conflict", "error").collect()), key=repr)


MIXES = {
    "all": (["skip", "keep-both", "replace"], ["skip", "keep-existing", "keep-both", "keep-incoming", "replace-existing", "odd"], 9, 14),
    "defaults": (["skip"], ["skip"], 5, 6),
    "both": (["skip", "keep-both"], ["keep-both", "skip"], 4, 30),
    "replacing": (["replace"], ["keep-incoming", "replace-existing", "skip"], 8, 10),
}


@pytest.mark.parametrize("mix", sorted(MIXES))
def test_waves_equal_one_after_the_other(spark, mix):
    policies, actions, names, digests = MIXES[mix]
    rng = random.Random(f"{mix}1")
    name = lambda: f"/t/{rng.randrange(names)}{rng.choice(['', '', ' (1)', ' (2)', ' (1) (1)'])}{rng.choice(['.txt', '.TXT', '.b.txt', ''])}"
    items = [{"seq": k, "source": f"/s/{k}" if rng.random() < 0.95 else f"/t/{k % names}.txt", "destination": name(), "digest": f"d{rng.randrange(digests)}", "policy": rng.choice(policies), "duplicate_action": rng.choice(actions)} for k in range(70)]
    items = list({i["source"]: i for i in items}.values())
    library = {name().lower(): f"d{rng.randrange(digests)}" for _ in range(12)}
    assert resolved(spark, items, list(library.items())) == planned(items, list(library.items()))


def test_a_hot_target_and_hot_contents_take_few_waves(spark, monkeypatch):
    """A component of which no key is small: thousands of items of one name and of one digest, one after the other in neither order."""
    from curatrix.plans import waves

    seen = []
    ready = waves._ready
    monkeypatch.setattr(waves, "_ready", lambda rows: seen.append(1) or ready(rows))
    items = [{"seq": k, "source": f"/s/{k}", "destination": "/t/a.txt" if k % 3 else f"/t/b{k}.txt", "digest": "same" if k % 2 else f"d{k}", "policy": "keep-both", "duplicate_action": "skip" if k % 5 else "keep-both"} for k in range(6000)]
    library = [("/t/a (3).txt", "x"), ("/t/b6.txt", "y")]
    assert resolved(spark, items, library) == planned(items, library)
    assert len(seen) <= 8


def test_unknown_contents_equal_none(spark):
    items = spark.createDataFrame([(k, f"/s/{k}", f"/t/{k}", None) for k in range(3)], "seq long, source string, destination string, digest string")
    got = resolve.resolve_items(items, spark.createDataFrame([("/l", None)], "path string, digest string")).collect()
    assert [(r["action"], r["conflict"]) for r in got] == [("move", False)] * 3


def test_media_transfers_refuse_what_may_replace(spark):
    media = spark.createDataFrame([(1, "/a/x.jpg", "d1"), (2, "/out/y.jpg", "d2")], "id long, path string, digest string")
    library = spark.createDataFrame([("/x/z.jpg", "d1"), ("/out/x.jpg", "d7")], "path string, digest string")
    with pytest.raises(ValueError, match="INVALID_TRANSFER"):
        resolve.plan_media_transfer(media, media.select("id"), "/out", library, "skip", "replace-existing")
    over = spark.createDataFrame([("/a/x.jpg", None, "keep-incoming")], "source string, policy string, duplicate_action string")
    assert {r["error"] for r in resolve.plan_media_transfer(media, media.select("id"), "/out", library, overrides=over).collect()} == {"INVALID_TRANSFER"}
    stray = spark.createDataFrame([("/nowhere", "skip", None)], "source string, policy string, duplicate_action string")
    assert {r["error"] for r in resolve.plan_media_transfer(media, media.select("id"), "/out", library, overrides=stray).collect()} == {"INVALID_TRANSFER"}
    got = {(r["seq"], r["backup"]): (r["destination"], r["action"], r["error"]) for r in resolve.plan_media_transfer(media.withColumn("digest", F.concat("digest", F.lit("n"))), media.select("id"), "/out", library, "replace", mode="copy").collect()}
    assert got == {(1, False): ("/out/x.jpg", "copy", None), (1, True): ("/out/.recovery/1-x.jpg", "move", None), (2, False): ("/out/y.jpg", "copy", "SAME_DESTINATION")}
    assert {r["error"] for r in resolve.plan_media_transfer(media, media.select("id"), "/o", library, most=1).collect()} == {"INVALID_SELECTION"}
    assert resolve.check_selection(media.select("id").limit(0)).first()["error"] == "INVALID_SELECTION"
    items = spark.createDataFrame([("/A/x.jpg", "move", "completed"), ("/out/y.jpg", "copy", "completed")], "source string, kind string, status string")
    assert [r["id"] for r in resolve.gallery_after(media, items).collect()] == [2]


def test_headers_and_presets_of_transfers(spark):
    inbox = spark.createDataFrame([("matched",), ("needs-review",), ("waiting",)], "status string")
    assert tuple(resolve.plan_header(inbox).first()) == (1, 2, None) and tuple(resolve.plan_header(inbox.where("status <> 'matched'")).first()) == (0, 2, "NO_MATCHED_FILES")
    tree = spark.createDataFrame([("/r/a", True, None), ("/r/a/x.txt", False, 86_400_000), ("/r/a/y.txt", False, None), ("/r/b.txt", False, 0)], "path string, is_dir boolean, modified_at long")
    steps = resolve.plan_transfer(tree, spark.createDataFrame([("/r/a",), ("/r/b.txt",)], "path string"), "/t", "copy", preset=Preset("p", "P", "{period} {date:yyyy-MM-dd} {counter:00}"), period="Q")
    got = {r["path"]: (r["target"], r["error"]) for r in steps.where("phase = 1").collect()}
    assert got["/r/a/x.txt"] == ("/t/a/Q 1970-01-02 01.txt", None) and got["/r/b.txt"] == ("/t/Q 1970-01-01 03.txt", None) and got["/r/a/y.txt"][1] == "INVALID_DATE"
    files = spark.createDataFrame([("/r/a/x.txt", "d1"), ("/r/b.txt", "d2")], "path string, digest string")
    library = spark.createDataFrame([("/t/a/q 1970-01-02 01.txt", "d9"), ("/t/z", "d2")], "path string, digest string")
    done = {r["path"]: (r["target"], r["action"], r["conflict"]) for r in resolve.resolve_transfer(steps, files, library, "keep-both").where("phase = 1 and error is null").collect()}
    assert done == {"/r/a/x.txt": ("/t/a/Q 1970-01-02 01 (1).txt", "copy", True), "/r/b.txt": ("/t/Q 1970-01-01 03.txt", "skip", False)}


def test_free_names_go_on_beyond_five_digits(spark):
    asked = spark.range(1, 100_004).select(F.lit("/t/a.txt").alias("target"), F.col("id").alias("seq"))
    taken = spark.createDataFrame([("/t/a (99999).txt",), ("/t/a (100001).txt",)], "path string")
    got = resolve.available_names(asked, taken).where("seq >= 99998").orderBy("seq").select("available").collect()
    assert [r[0] for r in got] == [f"/t/a ({n}).txt" for n in (99998, 100000, 100002, 100003, 100004, 100005)]


def test_contents_are_carried_short(spark):
    from curatrix.plans.waves import _contents

    got = spark.createDataFrame([("ab" * 32,), ("?1",), ("AB" * 32,), ("ab" * 32,)], "digest string").select(_contents(F.col("digest"))).collect()
    assert [len(r[0]) for r in got] == [24] * 4 and len({r[0] for r in got}) == 3


def test_a_suffixed_name_may_end_like_another(spark):
    from curatrix.plans.waves import suffix_of

    names = {"/t/a (1).b (2)": ("/t/a.b (2)", 1), "/t/a (2)": ("/t/a", 2), "/t/a.b (2)": None, "/t (3)/a": None, "/t/.x (4)": ("/t/.x", 4), "/t/ (1).b": None, "/t/A (1) (2).txt": ("/t/a (1).txt", 2), "/t/a (01).b": None}
    got = spark.createDataFrame([(n,) for n in names], "path string").select("path", suffix_of(F.col("path")).alias("s")).collect()
    assert {r["path"]: tuple(r["s"]) if r["s"] else None for r in got} == names
    asked = spark.createDataFrame([("/t/a.b (2)", 1)], "target string, seq long")
    assert resolve.available_names(asked, spark.createDataFrame([("/t/a (1).b (2)",)], "path string")).first()["available"] == "/t/a (2).b (2)"


def test_names_are_made_once_a_row(spark):
    from curatrix.functions.names import render_name
    from curatrix.functions.scalars import ancestors

    made = render_name(Preset("p", "P", "{period} {name} {counter:00}", "lower", "dash"), F.col("name"), F.lit("Q"), F.lit(None).cast("date"), F.lit(7))
    assert str(made).count("Q") == 1 and str(ancestors(F.col("path"))).count("split") == 1
    got = spark.createDataFrame([("A\\b.c.TXT",), (".x",), ("no",), (None,)], "name string").select(made.alias("n")).collect()
    assert [r["n"] for r in got] == ["q-b.c-07.TXT", "q-.x-07", "q-no-07", None]


def test_places_need_no_second_shuffle_of_the_rows(spark):
    from curatrix.operators.rules import plan_counter

    got = plan_counter(spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("at").alias("_at")), "k", "n")
    assert "Window [row_number" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.where("n <> k + 1").isEmpty() and got.count() == 5000


def test_plans_without_overrides_join_none(spark, monkeypatch):
    from curatrix.plans import waves

    monkeypatch.setattr(waves, "apply_resolutions", None)
    items = spark.createDataFrame([(1, "/a", "/t/a", "d"), (2, "/b", "/t/b", "d")], "seq long, source string, destination string, digest string")
    assert sorted(r["action"] for r in waves.resolve_items(items, spark.createDataFrame([], "path string, digest string")).collect()) == ["move", "skip"]


def test_copies_wait_without_being_carried(spark, monkeypatch):
    """Of 1,000 items with the same contents one can be decided first: a wave writes no table of the others, and where no name is asked for no suffixes are read."""
    from curatrix.plans import waves

    items = spark.range(1000).select(F.col("id").alias("seq"), F.concat(F.lit("/s/"), "id").alias("source"), F.concat(F.lit("/t/"), "id").alias("destination"), F.lit("same").alias("digest"))
    ready, table, sizes, inside = waves._ready, waves.materialized, [], []

    def counted(df):
        out = table(df)
        if inside:
            sizes.append(out.count())
        return out

    def watched(rows):
        inside.append(1)
        try:
            return ready(rows)
        finally:
            inside.pop()

    def never(taken):
        raise AssertionError("suffixes are read")

    monkeypatch.setattr(waves, "materialized", counted)
    monkeypatch.setattr(waves, "_ready", watched)
    monkeypatch.setattr(waves, "numbered", never)
    got = waves.resolve_items(items, spark.createDataFrame([], "path string, digest string")).collect()
    assert sorted(r["seq"] for r in got if r["action"] == "move") == [0] and len(got) == 1000
    assert sizes and max(sizes) <= 1
