"""Merkle manifest of a dataset: one root for all documents, and for each document a proof of membership.

Leaves are digests of whole rows. Per language they ascend by doc_id, and every WIDTH consecutive nodes become one, level by
level, until one is left: the language's subroot. The subroots, by language, become the root in the same way.

The tree is stored as records from a digest to its children's digests, one for each digest and height (content-addressed:
equal nodes share a record), so that a record can be checked against its own name. A proof is looked up by descent: from the
root, a leaf's place written in base WIDTH says which child is next; the children not chosen are collected, and at the end
the path's segments are reversed, so that the proof starts at the leaf. Requests that share a part of their path take it
together: a level of the descent has a row per node with a request below it, never a row per request, so that neither the
root's record nor any other is met by more rows than it has occurrences.

Rows: a null field counts as `-`. Null and repeated ids are leaves like others: null ids come first, equal ids by digest,
equal rows side by side. An id that is null is never tampered with. An empty text is a field of 0 bytes; texts of any length
are hashed in place and never shuffled. Columns beyond those hashed are ignored, whatever their names. An empty table has
no leaves, no root and no rows. A table with one document has its leaf as root and an empty proof."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import cut
from curatrix.operators.rules import plan_counter

WIDTH = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_MOST = 21  # levels: WIDTH ** 21 leaves are beyond a long


@dataclass(frozen=True)
class Manifest:
    """leaves (doc_id, lang, tree, height, rank, leaf, changed), records (part, height, digest, children), trees (tree, lang, n, height, subroot) and
    top (root, height: one row, none for an empty table)."""

    leaves: DataFrame
    records: DataFrame
    trees: DataFrame
    top: DataFrame


def _joined(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def leaf_digest(**changed: Column) -> Column:
    """The digest of a row's fields, some of them changed."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def tampered_text() -> Column:
    return F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return sum(((n > F.lit(WIDTH**k)).cast("int") for k in range(1, _MOST)), (n > 1).cast("int"))


def _grown(rows: DataFrame, top: int) -> DataFrame:
    """rows (tree, height, rank, digest) with the nodes of all levels above: (at, tree, height, rank, digest, children), at: the node's level."""
    level = rows.select("tree", "height", "rank", "digest")
    out = None
    for k in range(1, top + 1):
        runs = level.where(F.col("height") >= k).groupBy("tree", "height", F.expr(f"rank div {WIDTH}").alias("_run"))
        held = F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"])  # WIDTH at most
        level = cut(runs.agg(held.alias("children")).select("tree", "height", F.col("_run").alias("rank"), _joined(F.col("children")).alias("digest"), "children"))
        node = level.select(F.lit(k).alias("at"), "tree", "height", "rank", "digest", "children")
        out = node if out is None else out.unionByName(node)
    return out if out is not None else rows.select(F.lit(0).alias("at"), "tree", "height", "rank", "digest", F.array("digest").alias("children")).limit(0)


def build(docs: DataFrame) -> Manifest:
    """The manifest of docs (doc_id, source, lang, n_chars, text). `changed` is the leaf as it is after tampering, where 3 divides the id's crc32."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    own = docs.select(*[F.col(c) for c in FIELDS])
    told = own.select("doc_id", "lang", leaf_digest().alias("leaf"), F.when(hit, leaf_digest(text=tampered_text())).alias("_other"))
    told = cut(told.select("doc_id", "lang", "leaf", F.coalesce("_other", "leaf").alias("changed")))
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf", "_tie"]  # the tie deals out equal rows
    placed = cut(plan_counter(told.withColumn("_tie", F.monotonically_increasing_id()), order, "_place").drop("_tie"))
    trees = placed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("_place").alias("_first"))
    trees = cut(plan_counter(trees, [F.col("lang").asc_nulls_first()], "tree").select((F.col("tree") - 1).cast("long").alias("tree"), "lang", "n", "_first", _height(F.col("n")).alias("height")))
    known = trees.select(F.col("lang").alias("_lang"), "tree", "height", "_first")
    leaves = placed.join(known, F.col("lang").eqNullSafe(F.col("_lang"))).select("doc_id", "lang", "tree", "height", (F.col("_place") - F.col("_first")).cast("long").alias("rank"), "leaf", "changed")
    leaves = cut(leaves)
    tallest = trees.agg(F.max("height")).first()[0] or 0
    nodes = _grown(leaves.withColumnRenamed("leaf", "digest"), tallest)
    ends = nodes.where("at = height").select("tree", F.col("digest").alias("subroot")).unionByName(leaves.where("height = 0").select("tree", F.col("leaf").alias("subroot")))
    trees = cut(trees.drop("_first").join(ends, "tree"))
    n = trees.count()
    high = sum(n > WIDTH**k for k in range(_MOST))
    over = _grown(trees.select(F.lit(0).cast("long").alias("tree"), F.lit(high).alias("height"), F.col("tree").alias("rank"), F.col("subroot").alias("digest")), high)
    top = (over.where(f"at = {high}").select("digest") if high else trees.select(F.col("subroot").alias("digest"))).select(F.col("digest").alias("root"), F.lit(high).alias("height"))
    record = lambda df, part: df.groupBy("at", "digest").agg(F.first("children").alias("children")).select(F.lit(part).alias("part"), F.col("at").alias("height"), "digest", "children")
    records = cut(record(over, "top").unionByName(record(nodes, "lang")))
    return Manifest(leaves, records, trees, cut(top))


SEGMENTS = "array<struct<at:int,others:array<string>>>"


def _segment(at: Column, children: Column) -> Column:
    return F.array(F.struct(at.cast("int").alias("at"), F.filter(children, lambda _, i: i != at).alias("others")))


def _below(front: DataFrame, records: DataFrame, part: str, k: int) -> DataFrame:
    """front (..., rank, digest, segments) one level down from level k: a row per child, with the children not chosen as one more segment."""
    held = front.join(records.where((F.col("part") == part) & (F.col("height") == k)).select("digest", "children"), "digest")
    rows = held.select(*[c for c in front.columns if c not in ("rank", "digest", "segments")], "rank", "segments", "children", F.posexplode("children").alias("_at", "_child"))
    return rows.select(*[c for c in front.columns if c not in ("rank", "digest", "segments")], (F.col("rank") * WIDTH + F.col("_at")).alias("rank"), F.col("_child").alias("digest"), F.concat("segments", _segment(F.col("_at"), F.col("children"))).alias("segments"))


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """Requests (rows of the manifest's leaves, none twice; all leaves where there are none) with root, subroot and proof: segments from the leaf to the root,
    each with the place among its run and the run's other digests from left to right."""
    asked = manifest.leaves if requests is None else requests
    records, levels = manifest.records, manifest.top.first()
    if levels is None:
        return asked.select("*", *[F.lit(None).cast("string").alias(c) for c in ("root", "subroot")], F.lit(None).cast(SEGMENTS).alias("proof"))
    front = manifest.top.select(F.lit(0).cast("long").alias("rank"), F.col("root").alias("digest"), F.array().cast(SEGMENTS).alias("segments"), "root")
    wanted = None if requests is None else asked.select("tree", "height", "rank")
    for k in range(levels["height"], 0, -1):
        front = _below(front, records, "top", k)
        if wanted is not None:
            front = front.join(wanted.select(F.expr(f"tree div {WIDTH ** (k - 1)}").alias("rank")).distinct(), "rank", "left_semi")
    if levels["height"]:
        front = cut(front)
    front = front.select(F.col("rank").alias("tree"), F.lit(0).cast("long").alias("rank"), "digest", "segments", "root", F.col("digest").alias("subroot"))
    entry = cut(front.join(manifest.trees.select("tree", "height"), "tree"))
    tallest = entry.agg(F.max("height")).first()[0] or 0
    at = None
    for k in range(tallest, 1, -1):
        own = entry.where(F.col("height") == k)
        at = own if at is None else at.unionByName(own)
        at = _below(at, records, "lang", k)
        if wanted is not None:
            at = at.join(wanted.select("tree", F.expr(f"rank div {WIDTH ** (k - 1)}").alias("rank")).distinct(), ["tree", "rank"], "left_semi")
    # The last level: a run's requests meet its record as one row.
    last = entry.where("height = 1") if at is None else cut(at.unionByName(entry.where("height = 1")))
    last = last.join(records.where("part = 'lang' and height = 1").select("digest", "children"), "digest")
    told = [F.col(c) for c in asked.columns]
    runs = asked.where("height > 0").groupBy(F.col("tree").alias("_tree"), F.expr(f"rank div {WIDTH}").alias("_run")).agg(F.collect_list(F.struct(*told)).alias("_asked"))  # WIDTH at most
    met = runs.join(last.select("tree", "rank", "root", "subroot", "segments", "children"), (F.col("_tree") == F.col("tree")) & (F.col("_run") == F.col("rank")))
    met = met.select("root", "subroot", "segments", "children", F.explode("_asked").alias("_q"))
    place = (F.col("_q.rank") % WIDTH).cast("int")
    found = met.select("_q.*", "root", "subroot", F.reverse(F.concat("segments", _segment(place, F.col("children")))).alias("proof"))
    alone = entry.where("height = 0").select(F.col("tree").alias("_tree"), "root", "subroot", F.reverse("segments").alias("proof"))
    return found.unionByName(asked.where("height = 0").join(alone, F.col("tree") == F.col("_tree")).drop("_tree"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""

    def up(node: Column, s: Column) -> Column:
        return F.sha2(F.concat(F.array_join(F.slice(s["others"], F.lit(1), s["at"]), ""), node, F.array_join(F.slice(s["others"], s["at"] + 1, F.size(s["others"])), "")), 256)

    return F.aggregate(proof, leaf, up)


def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of the documents as they are; folded_root of their tampered selves and whether it is the root."""
    rows = prove(build(docs))
    told = _joined(F.flatten(F.transform("proof", lambda s: s["others"])))
    rows = rows.select("doc_id", "leaf", "subroot", "root", told.alias("proof_sha256"), folded(F.col("changed"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
