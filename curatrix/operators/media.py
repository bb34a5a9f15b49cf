"""Media labels: prototypes, scores, feedback, protection, cache."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.functions.scalars import dot, normalize, squared_norm, valid_embedding
from curatrix.functions.signals import decide_labels, ranked_scores
from curatrix.operators.journal import detect_drift
from curatrix.operators.tables import materialized


def category_prototypes(prompts: DataFrame) -> DataFrame:
    """category, vector: unit prompt vectors summed and made unit again."""
    unit = prompts.select("category", F.posexplode(normalize(F.col("vector"))).alias("pos", "x"))
    sums = unit.groupBy("category", "pos").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector"))
    return rows.withColumn("vector", normalize(F.col("vector")))


def category_scores(media: DataFrame, prototypes: DataFrame) -> DataFrame:
    """media with scores: the clamped dot product with each prototype, as one array. Prototypes are few, one per category: one row holds them."""
    table = prototypes.agg(F.collect_list(F.struct("category", "vector")).alias("_p"))
    score = lambda p: F.struct(p["category"].alias("category"), F.least(F.greatest(dot(F.col("embedding"), p["vector"]), F.lit(0.0)), F.lit(1.0)).alias("score"))
    return media.join(F.broadcast(table)).withColumn("scores", F.transform("_p", score)).drop("_p")


def label(media: DataFrame, sensitivity: str = "balanced", categories=None) -> DataFrame:
    ranked = ranked_scores(F.col("scores"), categories) if categories else ranked_scores(F.col("scores"))
    return media.withColumn("_r", ranked).withColumn("_d", decide_labels(F.col("_r"), sensitivity)).select(*media.columns, F.col("_d.categories").alias("categories"), F.col("_d.uncertain").alias("uncertain"))


def merge_video_frames(frames: DataFrame, sensitivity: str = "balanced", categories=None) -> DataFrame:
    """frames (id, frame, scores, and perhaps embedding): the best score per category, decided anew; uncertain too if frames
    chose differently; the embedding is the unit vector of the frames' sum."""
    each = label(frames, sensitivity, categories).select("id", "frame", F.array_join("categories", ",").alias("c"))
    differ = each.groupBy("id").agg((F.count_distinct("c") > 1).alias("_differ"))
    best = frames.select("id", F.explode("scores").alias("s")).groupBy("id", "s.category").agg(F.max("s.score").alias("score")).groupBy("id").agg(F.collect_list(F.struct("category", "score")).alias("scores"))
    out = label(best, sensitivity, categories).join(differ, "id").select("id", "categories", (F.col("uncertain") | F.col("_differ")).alias("uncertain"))
    if "embedding" not in frames.columns:
        return out
    sums = frames.select("id", F.posexplode("embedding").alias("pos", "x")).groupBy("id", "pos").agg(F.sum(F.col("x").cast("double")).alias("x"))
    vectors = sums.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("_v"))
    return out.join(vectors.select("id", normalize(F.col("_v")).alias("embedding")), "id", "left")


def merge_view_embeddings(views: DataFrame) -> DataFrame:
    """views (id, view, vector): 0.8 of view 0 and 0.2 of the others' mean, made unit."""
    parts = views.select("id", "view", F.posexplode("vector").alias("pos", "x"))
    mean = parts.groupBy("id", "pos").agg(F.max(F.when(F.col("view") == 0, F.col("x"))).alias("w"), F.avg(F.when(F.col("view") > 0, F.col("x"))).alias("d"))
    x = F.when(F.col("d").isNull(), F.col("w")).otherwise(0.8 * F.col("w") + 0.2 * F.col("d"))
    rows = mean.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", x.alias("x")))), lambda s: s["x"]).alias("vector"))
    return rows.withColumn("vector", normalize(F.col("vector")))


def apply_corrections(media: DataFrame, corrections: DataFrame) -> DataFrame:
    """The user's categories by content digest come before the model's."""
    c = corrections.select("digest", F.col("categories").alias("_c"))
    out = media.join(c, "digest", "left")
    return out.withColumns({"categories": F.coalesce("_c", "categories"), "corrected": F.col("_c").isNotNull(), "uncertain": F.when(F.col("_c").isNotNull(), False).otherwise(F.col("uncertain"))}).drop("_c")


EXAMPLE_BLOCK = 4096
PIVOTS = 32
MEDIA_ROWS = 20_000  # in a task's group
TAUGHT = "id long, set string, similarity double"


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.greatest(squared_norm(a) + squared_norm(b) - 2 * dot(a, b), F.lit(0.0)))


def _cells(examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Examples with the cell of their nearest pivot and their block in it; and one row with all cells: pivot, the distances and norms within, blocks.

    Pivots are PIVOTS examples by a hash, so that row is small whatever there is."""
    pivots = examples.select("digest", "vector").orderBy(F.xxhash64("digest"), "digest").limit(PIVOTS)
    pivots = materialized(pivots.agg(F.array_sort(F.collect_list(F.struct("digest", "vector"))).alias("_pivots")))
    near = F.transform("_pivots", lambda p, i: F.struct(_distance(F.col("vector"), p["vector"]).alias("far"), i.alias("cell")))
    placed = examples.join(F.broadcast(pivots)).withColumn("_n", F.array_min(near))  # one row of pivots
    placed = materialized(placed.select("digest", "set", "vector", F.col("_n.cell").alias("cell"), F.col("_n.far").alias("far")))
    wide = placed.groupBy("cell").agg(F.min("far").alias("least"), F.max("far").alias("most"), F.max(squared_norm(F.col("vector"))).alias("norm"), F.ceil(F.count(F.lit(1)) / EXAMPLE_BLOCK).alias("blocks"))
    blocks = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    dealt = placed.join(wide.select("cell", "blocks"), "cell").select("set", "vector", "cell", blocks.alias("block"))
    told = wide.join(F.broadcast(pivots)).select(F.struct("cell", F.get("_pivots", F.col("cell"))["vector"].alias("pivot"), "least", "most", "norm", "blocks").alias("c"))
    return dealt, told.agg(F.collect_list("c").alias("_cells"))


def nearest_feedback(media: DataFrame, examples: DataFrame, min_similarity: float = 0.94, margin: float = 0.03) -> DataFrame:
    """id, categories and similarity of the nearest example, unless one with other categories is within the margin.

    An exact join with any number of examples: only those with a product of at least min_similarity - margin can decide. Examples are
    dealt to the cells of a few pivots, and by distances to the pivot a medium visits only cells that may hold such ones. A task
    multiplies a part of a cell's media with one block of its examples, and gives the best two sets of categories of each; the best two of all blocks decide."""
    least = min_similarity - margin
    told = materialized(examples.where(F.col("embedding").isNotNull()).select("digest", F.col("embedding").cast("array<double>").alias("vector"), F.array_join(F.array_sort("categories"), ",").alias("set")))
    dealt, cells = _cells(told)
    rows = media.where(F.col("embedding").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    salts = max(1, -(-rows.count() // MEDIA_ROWS))
    norm = squared_norm(F.col("vector"))

    def may_hold(c: Column) -> Column:
        reach = F.sqrt(F.greatest(norm + c["norm"] - 2 * least, F.lit(0.0))) + 1e-9
        far = _distance(F.col("vector"), c["pivot"])
        return (F.size(c["pivot"]) == F.size("vector")) & (norm + c["norm"] >= 2 * least - 1e-9) & (far <= c["most"] + reach) & (far >= c["least"] - reach)

    visits = rows.join(F.broadcast(cells)).select("id", "vector", F.explode(F.filter("_cells", may_hold)).alias("c"))  # one row of cells
    visits = visits.select("id", "vector", F.col("c.cell").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("c.blocks").cast("int") - 1)).alias("block"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    dealt = dealt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("set")
            x = np.stack(right["vector"].to_numpy()).astype(float)
            names, first = np.unique(right["set"].to_numpy().astype(str), return_index=True)
            for k in range(0, len(left), 1024):
                part = left.iloc[k : k + 1024]
                by_set = np.maximum.reduceat(np.stack(part["vector"].to_numpy()).astype(float) @ x.T, first, axis=1)
                for _ in range(min(2, len(names))):
                    best = by_set.argmax(1)
                    top = by_set[np.arange(len(part)), best]
                    by_set[np.arange(len(part)), best] = -np.inf
                    ok = top >= least
                    out.append(pd.DataFrame({"id": part["id"].to_numpy()[ok], "set": names[best[ok]], "similarity": top[ok]}))
        return pd.concat(out) if out else pd.DataFrame({"id": pd.Series(dtype="int64"), "set": pd.Series(dtype="str"), "similarity": pd.Series(dtype="float64")})

    key = ["cell", "block", "salt"]
    found = visits.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInPandas(run, TAUGHT)
    best = found.groupBy("id", "set").agg(F.max("similarity").alias("similarity")).groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("similarity", "set")), False), 1, 2).alias("_b"))
    top, rival = F.col("_b")[0], F.coalesce(F.get("_b", F.lit(1))["similarity"], F.lit(float("-inf")))
    kept = best.where((top["similarity"] >= min_similarity) & (top["similarity"] - rival > margin))
    return kept.select("id", F.split(top["set"], ",").alias("categories"), top["similarity"].alias("similarity"))


def learned_labels(media: DataFrame, examples: DataFrame, corrections: DataFrame, min_similarity: float = 0.94, margin: float = 0.03) -> DataFrame:
    """media (id, digest, embedding, categories, uncertain) with the user's corrections first, then what the nearest examples teach
    (marked learned and uncertain), then the model's own."""
    taught = nearest_feedback(media, examples, min_similarity, margin).select("id", F.col("categories").alias("_t"))
    out = apply_corrections(media.join(taught, "id", "left"), corrections)
    learned = ~F.col("corrected") & F.col("_t").isNotNull()
    return out.withColumns({"categories": F.when(learned, F.col("_t")).otherwise(F.col("categories")), "uncertain": F.col("uncertain") | learned, "learned": learned}).drop("_t")


def mark_protected(media: DataFrame, protected: DataFrame) -> DataFrame:
    return media.drop("protected").join(protected.select("digest").distinct().withColumn("protected", F.lit(True)), "digest", "left").withColumn("protected", F.coalesce("protected", F.lit(False)))


def guard_retirement(items: DataFrame, protected: DataFrame) -> DataFrame:
    """One row: MEDIA_PROTECTED if the batch has a protected content, else null."""
    return mark_protected(items, protected).agg(F.when(F.coalesce(F.bool_or("protected"), F.lit(False)), "MEDIA_PROTECTED").alias("error"))


def unchanged_or_none(result: DataFrame, before: DataFrame, chosen: DataFrame, current: DataFrame) -> DataFrame:
    """result, or all of before if any of the chosen files (path, size, modified_at, identity, digest) has drifted from what is there now."""
    drifted = detect_drift(chosen, current).where("error is not null").limit(1).agg((F.count(F.lit(1)) > 0).alias("_bad"))
    both = result.withColumn("_new", F.lit(True)).unionByName(before.select(result.columns).withColumn("_new", F.lit(False)))
    return both.join(F.broadcast(drifted)).where(F.col("_new") != F.col("_bad")).drop("_new", "_bad")  # one row of drift


def set_protection(marks: DataFrame, media: DataFrame, ids: DataFrame, on: bool) -> DataFrame:
    chosen = media.join(ids, "id", "left_semi").select("digest").distinct()
    return marks.select("digest").union(chosen).distinct() if on else marks.join(chosen, "digest", "left_anti")


def set_corrections(corrections: DataFrame, media: DataFrame, ids: DataFrame, categories: list[str] | None, model: str | None = None, mode: str | None = None) -> DataFrame:
    """Upsert by digest; None deletes. 1 to 8 distinct categories, else INVALID_MEDIA_CATEGORIES.

    With a model, corrections teach: they have the embedding of the digest's first row (by id), its model and its mode."""
    if categories is not None and not (1 <= len(categories) <= 8 and len(set(categories)) == len(categories)):
        raise ValueError("INVALID_MEDIA_CATEGORIES")
    rows = media.join(ids, "id", "left_semi")
    chosen = rows.select("digest").distinct()
    taught = [] if model is None else ["embedding", "model", "mode"]
    if taught:
        chosen = rows.groupBy("digest").agg(F.min_by("embedding", "id").alias("embedding")).withColumns({"model": F.lit(model), "mode": F.lit(mode)})
    kept = corrections.join(chosen, "digest", "left_anti").select("digest", "categories", *taught)
    return kept if categories is None else kept.unionByName(chosen.withColumn("categories", F.array(*map(F.lit, categories))))


def clear_corrections(media: DataFrame) -> DataFrame:
    """The model's labels again (baseline: struct of categories and uncertain); protection stays."""
    return media.withColumns({"categories": F.col("baseline.categories"), "uncertain": F.col("baseline.uncertain"), "corrected": F.lit(False)})


def split_cached(media: DataFrame, cache: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(rows with a valid cached result, digests that need inference, one each)."""
    finite = F.forall("labels", lambda l: l["score"].isNotNull() & ~F.isnan(l["score"]) & l["score"].between(0, 1))
    ok = cache.where(F.size("labels").between(1, 8) & finite & ((F.size("embedding") <= 0) | F.col("embedding").isNull() | valid_embedding(F.col("embedding"), dim)))
    hit = media.join(ok.select("digest", "profile", F.col("labels").alias("cached_labels")), ["digest", "profile"])
    return hit, media.join(ok, ["digest", "profile"], "left_anti").select("digest", "profile").distinct()


def trim_cache(cache: DataFrame, keep: int = 50_000) -> DataFrame:
    return cache.orderBy(F.desc("updated_at"), F.desc("id")).limit(keep)


def recent_examples(corrections: DataFrame, model: str, mode: str, dim: int, keep: int = 256, look_back: int = 1024) -> DataFrame:
    """The newest look_back rows first, then the valid ones of this model and mode, then the newest keep of them."""
    new = [F.desc("updated_at"), F.desc("id")]
    seen = corrections.orderBy(*new).limit(look_back)
    return seen.where((F.col("model") == model) & (F.col("mode") == mode) & valid_embedding(F.col("embedding"), dim)).orderBy(*new).limit(keep)


def gallery_counts(media: DataFrame, excluded: DataFrame) -> DataFrame:
    m = media.join(excluded.select("id").distinct().withColumn("_x", F.lit(True)), "id", "left")
    return m.agg(F.count_if("protected").alias("protected"), F.count_if(F.col("_x").isNotNull()).alias("excluded"), F.count_if(~F.col("protected") & F.col("_x").isNull()).alias("removable"), F.count_if("corrected").alias("corrected"))


def newest(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("updated_at")))).where("_r = 1").drop("_r")
