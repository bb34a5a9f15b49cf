"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, flat neighbour arrays, results merged.

Nearness is the largest inner product. Vectors get one more component, so that all have the same length and the nearest
by distance is the one with the largest inner product; equal vectors are one node with its smallest ids. Shards are
dealt by a hash of the vector and each one's graph is built once, as a row of flat arrays. Queries are dealt into blocks
of about BLOCK_ROWS; each block visits every shard: a task gets the shard's graph, then streams the block's queries over
it in Arrow batches, so that it holds one graph and one batch. The shards' best are merged by query.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import cut

K = 20
LINKS = 16
BUILD = 64
SEARCH = 120
SHARD_ROWS = 16_384
LEAST_SHARDS = 8
BLOCK_ROWS = 65_536


class Graph:
    """neighbours[level]: an array of ids, -1 where a node has fewer; level 0 has twice the links."""

    def __init__(self, x: np.ndarray, links: int = LINKS, build: int = BUILD, seed: int = 11):
        n = len(x)
        self.x, self.links = np.ascontiguousarray(x, np.float32), links
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(rng.random(n)) / np.log(links)).astype(int), 8)
        top = int(self.level.max(initial=0))
        self.flat = [np.full((n, 2 * links if v == 0 else links), -1, np.int32) for v in range(top + 1)]
        self.size = [np.zeros(n, np.int32) for _ in range(top + 1)]
        self.entry, self.seen, self.mark = 0, np.zeros(n, np.int64), 0
        for i in range(1, n):
            self._insert(i, build)

    def _beam(self, q: np.ndarray, start: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        """The ef nearest found, as (minus inner product, node), nearest first."""
        self.mark += 1
        seen, flat, x = self.seen, self.flat[level], self.x
        heap = list(start)
        heapq.heapify(heap)
        best = [(-d, i) for d, i in start]
        heapq.heapify(best)
        for _, i in start:
            seen[i] = self.mark
        while heap:
            d, i = heapq.heappop(heap)
            if len(best) >= ef and d > -best[0][0]:
                break
            near = flat[i]
            near = near[near >= 0]
            near = near[seen[near] != self.mark]
            if not len(near):
                continue
            seen[near] = self.mark
            dist = -(x[near] @ q)
            if len(best) >= ef:
                keep = dist < -best[0][0]
                near, dist = near[keep], dist[keep]
            for e, j in zip(dist.tolist(), near.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (-e, j))
                    heapq.heappush(heap, (e, j))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, j))
                    heapq.heappush(heap, (e, j))
        return sorted((-d, i) for d, i in best)

    def _choose(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Diverse neighbours: one that is nearer to a chosen one than to the node is put off."""
        ids = np.array([i for _, i in found])
        sims = self.x[ids] @ self.x[ids].T
        own = np.array([-d for d, _ in found])
        worst, chosen = np.full(len(ids), -np.inf), []
        for k in range(len(ids)):
            if worst[k] <= own[k]:
                chosen.append(k)
                if len(chosen) == most:
                    break
                worst = np.maximum(worst, sims[k])
        if len(chosen) < most:
            picked = set(chosen)
            chosen += [k for k in range(len(ids)) if k not in picked][: most - len(chosen)]
        return ids[chosen].tolist()

    def _insert(self, i: int, build: int) -> None:
        q, entry, top = self.x[i], self.entry, int(self.level[self.entry])
        found = [(float(-(self.x[entry] @ q)), entry)]
        for v in range(top, int(self.level[i]), -1):
            found = self._beam(q, found[:1], 1, v)
        for v in range(min(top, int(self.level[i])), -1, -1):
            found = self._beam(q, found, build, v)
            chosen = self._choose(found, self.links)
            flat, size = self.flat[v], self.size[v]
            flat[i, : len(chosen)], size[i] = chosen, len(chosen)
            for j in chosen:
                if size[j] < flat.shape[1]:
                    flat[j, size[j]] = i
                    size[j] += 1
                else:
                    all_ids = np.append(flat[j], i)
                    d = -(self.x[all_ids] @ self.x[j])
                    order = np.argsort(d, kind="stable")
                    kept = self._choose(list(zip(d[order].tolist(), all_ids[order].tolist(), strict=True)), flat.shape[1])
                    flat[j] = -1
                    flat[j, : len(kept)], size[j] = kept, len(kept)
        if self.level[i] > top:
            self.entry = i

    def search(self, q: np.ndarray, k: int, ef: int = SEARCH) -> list[int]:
        if not len(self.x):
            return []
        found = [(float(-(self.x[self.entry] @ q)), self.entry)]
        for v in range(int(self.level[self.entry]), 0, -1):
            found = self._beam(q, found[:1], 1, v)
        return [i for _, i in self._beam(q, found, max(ef, k), 0)[:k]]

    def __getstate__(self) -> dict:
        """What a search needs."""
        return {k: getattr(self, k) for k in ("x", "level", "flat", "entry")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.seen, self.mark = np.zeros(len(self.x), np.int64), 0


def dealt(graphs: DataFrame, wanted: DataFrame, shards: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """shard, block, key, v, graph: for each shard and block of queries the graph (key and v null), then the queries."""
    blocks = max(1, -(-wanted.count() // block_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = graphs.select("shard", every(blocks).alias("block"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("array<double>").alias("v"), "graph")
    # The shards' hash is that of the key alone, so the blocks' has another seed.
    ask = wanted.withColumn("block", F.pmod(F.xxhash64("key", F.lit("block")), F.lit(blocks)).cast("int")).select(every(shards).alias("shard"), "block", "key", "v", F.lit(None).cast("binary").alias("graph"))
    return held.unionByName(ask).repartition(shards * blocks, "shard", "block").sortWithinPartitions("shard", "block", F.col("graph").isNull())


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, no null or non-finite component, not all zero."""
    ok = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(ok, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def nearest(vectors: DataFrame, queries: Column, k: int = K, shard_rows: int = SHARD_ROWS, links: int = LINKS, build: int = BUILD, search: int = SEARCH, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among all other rows.

    Ties go to the smaller vec_id; of equal vectors the smallest ids come first. Repeated rows count once; null ids take
    no part. Vectors of another size than the query's are no candidates. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = cut(rows.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).withColumn("key", F.sha2(F.concat_ws(",", F.transform("v", lambda x: F.when(x == 0, F.lit("0.0")).otherwise(x.cast("string")))), 256)))
    # Of equal vectors the k + 1 smallest ids are enough, for a query leaves out itself at most; found by salted parts.
    salted = Window.partitionBy("key", F.pmod("vec_id", F.lit(97))).orderBy("vec_id")
    firsts = rows.select("key", "vec_id").distinct().withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= k + 1)
    firsts = firsts.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    ids = firsts.groupBy("key").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = cut(rows.groupBy("key").agg(F.first("v").alias("v")).join(ids, "key"))
    told = nodes.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2")).collect()
    if not told:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most = {r["size"]: r["norm2"] for r in told}
    shards = max(LEAST_SHARDS, -(-sum(r["n"] for r in told) // shard_rows))
    asked = rows.where(queries).select("key", F.col("vec_id").alias("query_id")).distinct()
    wanted = asked.select("key").distinct().join(nodes, "key").select("key", "v")
    data = nodes.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key", "v", "ids")

    def built(pdf: pd.DataFrame) -> pd.DataFrame:
        held = {}
        for size, base in pdf.groupby(pdf["v"].map(len)):
            base = base.sort_values("key")
            x = np.stack(base["v"].to_numpy())
            unit = x / np.sqrt(most[size])
            extra = np.sqrt(np.maximum(0, 1 - (unit * unit).sum(1)))[:, None]
            held[size] = Graph(np.hstack([unit, extra]), links, build), x, base["ids"].to_numpy()
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "graph": [pickle.dumps(held)]})

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, {}
        for batch in batches:
            out = []
            for shard, block, key, v, graph in batch.itertuples(index=False, name=None):
                if (shard, block) != at:
                    at, held = (shard, block), {}
                if graph is not None:
                    held = pickle.loads(graph)
                elif len(v) in held:
                    graph, x, ids = held[len(v)]
                    found = graph.search(np.append(v / np.linalg.norm(v), 0).astype(np.float32), k + 1, search)
                    scores = np.cumsum(x[found] * v, 1)[:, -1]  # in the order of the components, as a plain sum goes
                    best = sorted((-s, i) for s, n in zip(scores.tolist(), found, strict=True) for i in ids[n])[: k + 1]
                    out += [(key, i, -s) for s, i in best]
            yield pd.DataFrame(out, columns=["key", "vec_id", "score"])

    graphs = cut(data.repartition(shards, "shard").groupBy("shard").applyInPandas(built, "shard int, graph binary"))
    found = dealt(graphs, wanted, shards, block_rows).mapInPandas(within, "key string, vec_id long, score double")
    pairs = asked.join(found, "key").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
