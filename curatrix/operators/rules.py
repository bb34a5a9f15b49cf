"""Date rules and presets: validation, matching, counting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.scalars import selected_date

SOURCES = ("created", "modified", "accessed")


@dataclass(frozen=True)
class DateRule:
    id: str
    name: str
    start_date: str
    end_date: str
    destination: str
    date_source: str = "modified"
    enabled: bool = True


RULE_SCHEMA = "id string, name string, start_date string, end_date string, destination string, date_source string, enabled boolean"


def _sum(terms: list[Column]) -> Column:
    """Their sum, halves first: as deep as the logarithm of their number."""
    half = len(terms) // 2
    return _sum(terms[:half]) + _sum(terms[half:]) if half else terms[0]


def rule_hit(rules: list[DateRule], created: Column, modified: Column, accessed: Column) -> tuple[Column, Column]:
    """How many enabled rules have their own date source within their inclusive days, and the first of them: no join, no shuffle, a comparison of days for each rule."""
    days = {"created": created, "modified": modified, "accessed": accessed}
    on = [r for r in rules if r.enabled]
    within = [F.coalesce(days[r.date_source].between(F.lit(r.start_date).cast("date"), F.lit(r.end_date).cast("date")), F.lit(False)) if r.date_source in days else F.lit(False) for r in on]
    table = F.array(*[F.struct(F.lit(r.id).alias("id"), F.lit(r.name).alias("name"), F.lit(r.destination).alias("destination"), F.lit(r.date_source).alias("source")) for r in on])
    return _sum([w.cast("int") for w in within]), F.get(table, F.coalesce(*[F.when(w, k) for k, w in enumerate(within)]))


def match_rules(files: DataFrame, rules: list[DateRule]) -> DataFrame:
    """files (created, modified, accessed: date) with status, error, rule_id, destination, date_source, date_used."""
    if not any(r.enabled for r in rules):
        none = F.lit(None).cast("string")
        return files.select("*", F.lit("needs-review").alias("status"), none.alias("error"), none.alias("rule_id"), none.alias("rule_name"), none.alias("destination"), none.alias("date_source"), F.lit(None).cast("date").alias("date_used"))
    number, first = rule_hit(rules, F.col("created"), F.col("modified"), F.col("accessed"))
    hits = files.withColumns({"_hits": number, "_hit": first})
    one, hit = F.col("_hits") == 1, F.col("_hit")
    out = hits.withColumns({"status": F.when(one, "matched").otherwise("needs-review"), "error": F.when(F.col("_hits") > 1, "MULTIPLE_RULE_MATCHES"), "rule_id": F.when(one, hit["id"]), "rule_name": F.when(one, hit["name"]), "destination": F.when(one, hit["destination"]), "date_source": F.when(one, hit["source"])})
    return out.withColumn("date_used", selected_date(F.col("date_source"), F.col("created"), F.col("modified"), F.col("accessed"))).drop("_hits", "_hit")


def validate_rules(rules: DataFrame) -> DataFrame:
    """id and error (INVALID_RULE, INVALID_DATE, RULE_CONFLICT or null) of each rule."""
    day = lambda c: F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col(c).try_cast("date"))
    own = rules.withColumns({"_first": day("start_date"), "_last": day("end_date"), "_same": F.count(F.lit(1)).over(Window.partitionBy("id"))})
    totals = own.agg(F.count(F.lit(1)).alias("_all"))
    wrong = F.when((F.col("_all") > 200) | (F.col("id") == "") | (F.col("_same") > 1) | (F.trim("name") == "") | (F.octet_length("name") > 120), "INVALID_RULE").when(F.col("_first").isNull() | F.col("_last").isNull() | (F.col("_first") > F.col("_last")), "INVALID_DATE")
    own = own.join(F.broadcast(totals)).withColumn("error", wrong)  # one row of totals
    good = own.where("enabled and error is null").select(F.col("id").alias("_id"), F.col("_first").alias("_f"), F.col("_last").alias("_l"))
    clash = own.join(F.broadcast(good), (F.col("id") != F.col("_id")) & F.col("enabled") & (F.col("_first") <= F.col("_l")) & (F.col("_last") >= F.col("_f")), "left_semi").select(F.col("id").alias("_clash")).distinct()
    out = own.join(F.broadcast(clash), F.col("id") == F.col("_clash"), "left")  # at most 200 rules
    return out.select("id", F.coalesce("error", F.when(F.col("_clash").isNotNull(), "RULE_CONFLICT")).alias("error"))


def assign_presets(files: DataFrame, rule_presets: dict[str, str], default_id: str | None = None) -> DataFrame:
    table = F.create_map(*[x for k, v in rule_presets.items() for x in (F.lit(k), F.lit(v))]) if rule_presets else F.lit(None).cast("map<string,string>")
    return files.withColumn("preset_id", F.coalesce(F.try_element_at(table, F.col("rule_id")), F.lit(default_id)))


def plan_counter(items: DataFrame, order: str | list = "path", name: str = "counter") -> DataFrame:
    """Position in the order (columns or sort expressions), without one task for all rows: range partitions, written in order with each row's place in its own, and their sizes as offsets."""
    from curatrix.operators.tables import materialized

    order = [order] if isinstance(order, str) else order
    # monotonically_increasing_id: the partition's number above 33 bits, the row's place in it below.
    parted = items.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    parted = materialized(parted.withColumns({"_part": F.shiftright("_row", 33), "_row": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # one row per partition
    return parted.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_row") + 1 + F.col("_before")).drop("_part", "_row", "_before")


def inbox_counts(inbox: DataFrame) -> DataFrame:
    waiting = F.col("status").isin("detected", "waiting", "analyzing")
    return inbox.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "matched").alias("matched"), F.count_if(waiting).alias("waiting"), F.count_if(~waiting & (F.col("status") != "matched")).alias("unmatched"))


def rule_counts(inbox: DataFrame, rules: list[DateRule]) -> DataFrame:
    known = inbox.sparkSession.createDataFrame([(r.id,) for r in rules if r.enabled], "rule_id string")
    return known.join(inbox.where("status = 'matched'").groupBy("rule_id").agg(F.count(F.lit(1)).alias("files")), "rule_id", "left").select("rule_id", F.coalesce("files", F.lit(0)).alias("files"))
