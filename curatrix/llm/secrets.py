"""Secret scans with an incremental ledger of blobs.

Every version of a text is addressed by its SHA-256. The ledger holds the pairs of blob and rule version that have been
scanned, and the findings. A scan takes only unseen pairs, one text per blob, and joins findings back to all paths.
DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import cut, shared_folder


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    pattern: str
    group: int = 0  # whose length counts
    least: int = 1
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# Fixed patterns. Where only long runs count, the least length is part of the pattern: a run is taken whole either way.
RULES = (
    Rule("assign", 1, r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, True),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", 1, r"[0-9a-f]{16,}", base=True),
    Rule("private", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("webtoken", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


def _hits(text: Column, rule: Rule) -> Column:
    """Of each match in turn: the code points between it and the match before, its own, and those of the group that counts."""
    pattern = F.lit(rule.pattern)
    lengths = lambda a: F.transform(a, F.length)
    own = F.regexp_extract_all(text, pattern, F.lit(0))
    some = F.arrays_zip(lengths(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(own))).alias("gap"), lengths(own).alias("own"), lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("told"))
    return F.when(text.rlike(rule.pattern), some)


class Ledger:
    """scanned (blob, rule) and findings (blob, rule, start, end), as tables in one folder."""

    def __init__(self, spark, folder: str | None = None):
        self.spark, self.folder = spark, folder or shared_folder(spark)

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        return self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", "blob string, rule string")

    def findings(self) -> DataFrame:
        return self._read("findings", "blob string, rule string, start long, end long").dropDuplicates()

    def add(self, scanned: DataFrame, findings: DataFrame) -> None:
        """Findings first: should the second write fail, the pairs count as unseen and are scanned again."""
        findings.write.mode("append").parquet(f"{self.folder}/findings")
        scanned.write.mode("append").parquet(f"{self.folder}/scanned")


def versions(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(path).alias("path"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))


def scan(docs: DataFrame, ledger: Ledger, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
    """Scan the pairs of blob and rule version that the ledger hasn't, and add them to it."""
    seen = ledger.scanned().groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    all_rules = F.array(*[F.lit(r.key) for r in rules])
    every = versions(docs, path, text)
    wanted = every.groupBy("blob").agg(F.min("path").alias("path")).join(seen, "blob", "left")
    wanted = wanted.select(F.col("blob").alias("_blob"), F.col("path").alias("_path"), F.array_except(all_rules, F.coalesce("seen", F.array().cast("array<string>"))).alias("due")).where(F.size("due") > 0)
    one = every.join(wanted.hint("shuffle_hash"), (F.col("blob") == F.col("_blob")) & F.col("path").eqNullSafe(F.col("_path")))
    hits = cut(one.select("blob", "due", F.array(*[F.when(F.array_contains("due", r.key), _hits(F.col("text"), r)) for r in rules]).alias("hits")).dropDuplicates(["blob"]))
    each = hits.select("blob", F.posexplode("hits").alias("k", "hit")).where(F.col("hit").isNotNull()).select("blob", "k", F.posexplode("hit").alias("at", "h"))
    run = Window.partitionBy("blob", "k").orderBy("at")
    end = F.sum(F.col("h.gap") + F.col("h.own")).over(run)
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("k") + 1)
    found = each.select("blob", F.element_at(all_rules, F.col("k") + 1).alias("rule"), (end - F.col("h.own")).alias("start"), end.alias("end"), (F.col("h.told") >= least).alias("long")).where("long").drop("long")
    ledger.add(hits.select("blob", F.explode("due").alias("rule")), found)


def report(docs: DataFrame, ledger: Ledger, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per version: path, counts of the base rules, base_sha256 and spans (all rules), from the ledger.

    Null counts as empty; texts without findings have counts 0 and the digest of the empty string. Repeated rows get a
    row each.
    """
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.key), F.lit(k))])
    names = F.create_map(*[x for r in rules for x in (F.lit(r.key), F.lit(r.name))])
    base = F.col("rule").isin([r.key for r in rules if r.base])
    found = ledger.findings().where(F.col("rule").isin([r.key for r in rules]))
    entry = F.struct(F.col("start"), order[F.col("rule")].alias("k"), F.concat_ws(":", names[F.col("rule")], "start", "end").alias("says"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["says"]), ",")
    counts = [F.count_if(F.col("rule") == r.key).alias(f"n_{r.name}") for r in rules if r.base]
    # Written first: a join of two plain shuffles can be split where very many versions have one blob.
    by = cut(found.groupBy("blob").agg(*counts, joined(F.collect_list(F.when(base, entry))).alias("_base"), joined(F.collect_list(entry)).alias("_spans")))
    out = versions(docs, path, text).select("path", "blob").join(by, "blob", "left")
    zero = [F.coalesce(f"n_{r.name}", F.lit(0)).cast("long").alias(f"n_{r.name}") for r in rules if r.base]
    return out.select(F.col("path").alias(path), *zero, F.sha2(F.coalesce("_base", F.lit("")), 256).alias("base_sha256"), F.coalesce("_spans", F.lit("")).alias("spans"))


def find(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """Scan what the ledger (a new one, if none is given) hasn't seen, then report on all rows."""
    ledger = ledger or Ledger(docs.sparkSession)
    scan(docs, ledger)
    return report(docs, ledger)
