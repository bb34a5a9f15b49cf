"""Plans: organization of an inbox, transfers, media, with targets, conflicts, duplicates and backups.

How items that want the same names or have the same contents are told apart is in waves.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.names import Preset, name_error, render_name
from curatrix.functions.scalars import ancestors, depth, file_name, local_day, path_key
from curatrix.operators.browse import collapse_roots
from curatrix.operators.rules import DateRule, assign_presets, match_rules, plan_counter
from curatrix.operators.tables import materialized
from curatrix.plans.waves import ACTIONS, KEEPS, apply_resolutions, available_names, folder_of, resolve_items

__all__ = ["ACTIONS", "apply_resolutions", "available_names", "destination_conflicts", "resolve_items"]
POLICIES = ("skip", "keep-both", "replace")


def destination_conflicts(items: DataFrame, library: DataFrame) -> DataFrame:
    """items (seq, destination): whether the target exists, or an earlier item claims it."""
    taken = library.select(path_key(F.col("path")).alias("_key")).distinct().withColumn("_there", F.lit(True))
    out = items.withColumn("_key", path_key(F.col("destination"))).join(taken, "_key", "left")
    first = F.min("seq").over(Window.partitionBy("_key"))
    return out.withColumn("conflict", F.col("_there").isNotNull() | (F.col("seq") > first)).drop("_key", "_there")


def named_targets(inbox: DataFrame, rules: list[DateRule], presets: dict[str, Preset], rule_presets: dict[str, str], default_id: str | None) -> DataFrame:
    """Matched files with counter, new name and destination. The names are written as a table: what follows reads each of them several times."""
    matched = assign_presets(match_rules(inbox, rules), rule_presets, default_id).where("status = 'matched'")
    counted = plan_counter(matched)
    name = file_name(F.col("path"))
    new = None
    for p in presets.values():
        case = F.when(F.col("preset_id") == p.id, render_name(p, name, F.col("rule_name"), F.col("date_used"), F.col("counter")))
        new = case if new is None else F.coalesce(new, case)
    new = F.when(F.col("preset_id").isNull(), name).otherwise(new) if new is not None else name
    named = materialized(counted.withColumn("new_name", new))
    return named.withColumns({"destination_path": F.concat_ws("/", "destination", "new_name"), "name_error": name_error(F.col("new_name"))})


def _resolved(items: DataFrame, library: DataFrame, policy: str, duplicate_action: str, overrides: DataFrame | None) -> DataFrame:
    """resolve_items where digests may be unknown (null, or no column): such contents equal no other's."""
    digest = lambda df: (F.col("digest") if "digest" in df.columns else F.lit(None)).cast("string").alias("digest")
    return resolve_items(items.select(F.col("seq").cast("long").alias("seq"), "source", "destination", digest(items)), library.select("path", digest(library)), policy, duplicate_action, overrides)


def plan_organization(inbox: DataFrame, rules: list[DateRule], presets: dict[str, Preset], rule_presets: dict[str, str], default_id: str | None, library: DataFrame, policy: str = "skip", duplicate_action: str = "skip", overrides: DataFrame | None = None) -> DataFrame:
    """inbox (path, size, digest, dates): where each matched file goes, by plan_named."""
    return plan_named(named_targets(inbox, rules, presets, rule_presets, default_id), library, policy, duplicate_action, overrides)


def plan_named(named: DataFrame, library: DataFrame, policy: str = "skip", duplicate_action: str = "skip", overrides: DataFrame | None = None) -> DataFrame:
    """named (of named_targets): a plan row per file, and the backups that its replacements need, told by `backup`.

    Contents always count: a file whose digest the library or an earlier item has is a duplicate, whatever its name is."""
    items = named.select(F.col("counter").cast("long").alias("seq"), F.col("path").alias("source"), F.col("destination_path").alias("destination"), "digest", "size", "rule_id", "new_name", "name_error")
    done = _resolved(items, library, policy, duplicate_action, overrides)
    told = items.select(F.col("seq"), F.col("size").alias("_size"), F.col("rule_id").alias("_rule"), F.col("name_error").alias("_wrong"))
    return done.join(told, "seq").select("seq", "source", "destination", F.col("_size").alias("size"), F.col("_rule").alias("rule_id"), "action", "backup", "conflict", F.coalesce("_wrong", "error").alias("error"))


def plan_header(matched: DataFrame) -> DataFrame:
    """matched (of match_rules): how many files a plan of it has, how many no rule takes, and NO_MATCHED_FILES where it has none."""
    hit = F.col("status") == "matched"
    counts = matched.agg(F.count_if(hit).alias("items"), F.count_if(F.coalesce(~hit, F.lit(True))).alias("unmatched"))
    return counts.withColumn("error", F.when(F.col("items") == 0, "NO_MATCHED_FILES"))


def plan_summary(plan: DataFrame) -> DataFrame:
    work = ~F.col("backup") & ~F.col("kind").isin("mkdir", "rmdir")
    return plan.agg(F.count_if(work).alias("files"), F.count_if(work & (file_name(F.col("source")) != file_name(F.col("destination")))).alias("renamed"), F.count_if(work & (F.col("action") == "move")).alias("move"), F.count_if(work & (F.col("action") == "copy")).alias("copy"), F.count_if(F.col("conflict")).alias("conflicts"), F.count_if(F.col("backup")).alias("backups"), F.count_if(F.col("kind").isin("mkdir", "rmdir")).alias("folders"))


def organization_totals(plan: DataFrame) -> DataFrame:
    moves = F.col("action") == "move"
    return plan.agg(F.count_if(moves).alias("moves"), F.coalesce(F.sum(F.when(moves, F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(F.col("action") == "skip").alias("kept"), F.count_if("conflict").alias("conflicts"))


def _folder_places(tree: DataFrame, sources: DataFrame, destination: str, policy: str, library: DataFrame | None) -> DataFrame:
    """root, _key, place and _held of each selected source that is in no other one: where it goes, or why it doesn't."""
    top = collapse_roots(sources.select(F.col("path").alias("root"))).select("root", path_key(F.col("root")).alias("_key"), F.concat(F.lit(destination.rstrip("/") + "/"), file_name(F.col("root"))).alias("place"))
    none = F.lit(None).cast("string")
    if library is None:
        return top.withColumn("_held", none)
    folders = tree.where("is_dir").select(path_key(F.col("path")).alias("_key")).distinct()
    asked = plan_counter(top.join(folders, "_key", "left_semi").select("_key", "root", "place"), "root", "seq")
    held = destination_conflicts(asked.drop("_key").withColumn("destination", F.col("place")), library).where("conflict").select(path_key(F.col("root")).alias("_key"), "seq", F.col("place").alias("target"))
    if policy == "keep-both":
        free = held.join(available_names(held.select("target", "seq"), library.select("path").union(asked.select("place"))), ["target", "seq"]).select("_key", F.col("available").alias("_new"), none.alias("_why"))
    else:
        free = held.select("_key", none.alias("_new"), F.lit("skip" if policy == "skip" else "FOLDER_CONFLICT").alias("_why"))
    return top.join(free, "_key", "left").select("root", "_key", F.coalesce("_new", "place").alias("place"), F.col("_why").alias("_held"))


def plan_transfer(tree: DataFrame, sources: DataFrame, destination: str, mode: str = "move", policy: str = "skip", library: DataFrame | None = None, preset: Preset | None = None, period: str = "") -> DataFrame:
    """tree (path, is_dir): steps for the selected sources: folders made parents first, files, emptied folders removed children first.

    Sources inside another selected one go; INVALID steps are marked: FOLDER_INTO_ITSELF, SAME_DESTINATION. A folder whose target
    is in the library (path) or claimed by a source before it is skipped with all it holds, gets a free suffix (keep-both), or
    is a FOLDER_CONFLICT (replace). With a preset each file gets a new name from its own name, `period`, the day of tree's modified_at
    (none: INVALID_DATE) and its place among the files in order of path. Files' conflicts are for resolve_transfer."""
    top = materialized(_folder_places(tree, sources, destination, policy, library))
    kept = ["path", "is_dir", *(["modified_at"] if preset else [])]
    within = tree.select(*kept, F.explode(ancestors(path_key(F.col("path")))).alias("_key")).join(top, "_key")
    rows = within.withColumn("target", F.concat("place", F.substring(F.col("path"), F.length("root") + 1, F.length("path")))).withColumn("_wrong", F.lit(None).cast("string"))
    if preset:
        files = plan_counter(rows.where("not is_dir and _held is null"), "path")
        name = render_name(preset, file_name(F.col("path")), F.lit(period), local_day(F.col("modified_at")), F.col("counter"))
        files = materialized(files.withColumn("_name", name))
        wrong = F.when(F.col("modified_at").isNull(), "INVALID_DATE").otherwise(name_error(F.col("_name")))
        files = files.withColumns({"target": F.concat(folder_of(F.col("target")), F.coalesce("_name", file_name(F.col("target")))), "_wrong": wrong}).drop("_name", "counter")
        rows = rows.where("is_dir or _held is not null").unionByName(files)
    same = F.col("target") == F.col("path") if preset else path_key(F.col("target")) == path_key(F.col("path"))
    error = F.when(F.col("is_dir") & F.lit(destination.lower() + "/").startswith(F.concat(F.lower("root"), F.lit("/"))), "FOLDER_INTO_ITSELF").when(same, "SAME_DESTINATION").when(F.col("_held") != "skip", F.col("_held"))
    rows = rows.withColumn("error", F.coalesce(error, "_wrong"))
    step = lambda df, phase, order, action: df.select(F.lit(phase).alias("phase"), order.alias("order"), "path", "target", F.lit(action).alias("action"), "error")
    zero, level = F.lit(0), depth(F.col("path"))
    held = (F.col("_held") == "skip") & F.col("error").isNull()
    skipped = step(rows.where(held), 3, zero, "skip")
    rows = rows.where(F.coalesce(~held, F.lit(True)))
    steps = step(rows.where("is_dir"), 0, level, "mkdir").unionByName(step(rows.where("not is_dir"), 1, zero, mode))
    if mode == "move":
        steps = steps.unionByName(step(rows.where("is_dir"), 2, -level, "rmdir"))
    return steps.unionByName(skipped)


def resolve_transfer(steps: DataFrame, files: DataFrame, library: DataFrame, policy: str = "skip", duplicate_action: str = "skip", overrides: DataFrame | None = None) -> DataFrame:
    """steps (of plan_transfer) with their files resolved against the library: files (path, digest) in order of path. Backups come with
    the files' phase. Steps with an error stay as they are."""
    steps = materialized(steps)
    own = steps.where("phase = 1 and error is null")
    items = materialized(plan_counter(own.select(F.col("path").alias("source"), F.col("target").alias("destination"), F.col("action").alias("_mode")).join(files.select(F.col("path").alias("source"), "digest"), "source", "left"), "source", "seq"))
    plan = _resolved(items, library, policy, duplicate_action, overrides).join(items.select("seq", "_mode"), "seq")
    goes = (F.col("action") == "move") & ~F.col("backup")
    done = plan.select(F.lit(1).alias("phase"), F.lit(0).alias("order"), F.col("source").alias("path"), F.col("destination").alias("target"), F.when(goes, F.col("_mode")).otherwise(F.col("action")).alias("action"), "error", "backup", "conflict")
    rest = steps.where("phase <> 1 or error is not null").select("*", F.lit(False).alias("backup"), F.col("phase").eqNullSafe(3).alias("conflict"))
    return rest.unionByName(done)


def plan_media_removal(media: DataFrame, ids: DataFrame, most: int = 1000) -> DataFrame:
    """A backup move per selected row; the whole batch is MEDIA_PROTECTED if one of it is."""
    chosen = media.join(ids, "id", "left_semi")
    state = chosen.agg(F.coalesce(F.bool_or("protected"), F.lit(False)).alias("_p"), F.count(F.lit(1)).alias("_n"))
    error = F.when(F.col("_n") > most, "INVALID_SELECTION").when(F.col("_p"), "MEDIA_PROTECTED")
    return chosen.join(F.broadcast(state)).select("id", "path", F.lit("move").alias("action"), F.lit(True).alias("backup"), error.alias("error"))  # one row of state


def check_selection(ids: DataFrame, most: int = 1000) -> DataFrame:
    """INVALID_SELECTION where the ids are none, more than `most`, or repeated; one row."""
    counts = ids.agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("id").alias("_d"))
    return counts.select(F.when(~F.col("_n").between(1, most) | (F.col("_n") != F.col("_d")), "INVALID_SELECTION").alias("error"))


def plan_media_transfer(media: DataFrame, ids: DataFrame, destination: str, library: DataFrame, policy: str = "skip", duplicate_action: str = "skip", overrides: DataFrame | None = None, mode: str = "move", most: int = 1_000_000) -> DataFrame:
    """Where the selected media go, or what is copied there: seq (the id), source, destination, action, backup, conflict, error.

    Names stay. Copies in the library or among the media may be skipped or kept, never replaced: a batch with such an action, its own
    or one of its overrides', or with an override for no selected path, is INVALID_TRANSFER as a whole, as a selection of more than
    `most` rows or one with repeats is INVALID_SELECTION. A medium that is in the folder already is SAME_DESTINATION."""
    if policy not in POLICIES or mode not in ("move", "copy") or duplicate_action not in (*KEEPS, "keep-both"):
        raise ValueError("INVALID_TRANSFER")
    chosen = media.join(ids, "id", "left_semi").withColumns({"seq": F.col("id").cast("long"), "source": F.col("path"), "destination": F.concat(F.lit(destination.rstrip("/") + "/"), file_name(F.col("path")))})
    plan = _resolved(chosen, library, policy, duplicate_action, overrides)
    refused = check_selection(ids, most).select(F.col("error").alias("_refused"))
    if overrides is not None:
        safe = F.coalesce(F.col("duplicate_action").isin(*KEEPS, "keep-both"), F.lit(True))
        odd = overrides.join(chosen.select("source", F.lit(True).alias("_own")), "source", "left").where(~safe | F.col("_own").isNull())
        refused = refused.crossJoin(odd.agg((F.count(F.lit(1)) > 0).alias("_odd"))).select(F.coalesce("_refused", F.when(F.col("_odd"), "INVALID_TRANSFER")).alias("_refused"))  # one row each
    here = path_key(F.col("destination")) == path_key(F.col("source"))
    error = F.coalesce("_refused", F.when(here & ~F.col("backup"), "SAME_DESTINATION"), "error")
    goes = (F.col("action") == "move") & ~F.col("backup")
    plan = plan.join(F.broadcast(refused)).where(~F.col("backup") | F.col("_refused").isNull())  # one row of refusal
    return plan.select("seq", "source", "destination", F.when(goes, mode).otherwise(F.col("action")).alias("action"), "backup", "conflict", error.alias("error"))


def gallery_after(media: DataFrame, items: DataFrame) -> DataFrame:
    """The media that are left after a transfer's journal items (source, kind, status): completed moves go, copied media stay."""
    moved = items.where("status = 'completed' and kind = 'move'").select(path_key(F.col("source")).alias("_key")).distinct()
    return media.withColumn("_key", path_key(F.col("path"))).join(moved, "_key", "left_anti").drop("_key")
