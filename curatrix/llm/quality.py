"""Text quality by a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise interactions in
linear time. Fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import byte_view, held_out, row_blocks, word_hashes

WORDS = 1 << 11
RANK = 8
SAMPLE_ROWS = 6000
THRESHOLD = 0.3

_CLASSES = np.zeros((256, 7), np.float32)  # upper, lower, digit, sentence marks, other marks, white space, beyond ASCII
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b, 6 if _b > 127 else 0 if _c.isupper() else 1 if _c.islower() else 2 if _c.isdigit() else 3 if _c in ".,;:?'\"-()" else 5 if _c.isspace() else 4] = 1
STATS = 18


def features(text: pa.Array, n_chars: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Rows by blocks: the first row, and each row's hashed words (log counts, unit length), statistics and metadata."""
    data, off = byte_view(text)
    told = np.array([-1 if v is None else v for v in n_chars.to_pylist()], float)
    for a, b in row_blocks(off):
        part, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
        h, first, starts, ends = word_hashes(part, at)
        slot = (h & np.uint64(WORDS - 1)).astype(np.int64)
        for i in range(a, b, 512):
            j = min(i + 512, b)
            out = np.zeros((j - i, WORDS + STATS), np.float32)
            for k in range(i, j):
                lo, hi = first[k - a], first[k - a + 1]
                row, x = part[at[k - a] : at[k - a + 1]], out[k - i]
                n, m = max(len(row), 1), max(hi - lo, 1)
                if hi > lo:
                    words = np.log1p(np.bincount(slot[lo:hi], minlength=WORDS))
                    x[:WORDS] = words / np.linalg.norm(words)
                s = x[WORDS:]
                s[:7] = np.bincount(row, minlength=256) @ _CLASSES / n
                s[7] = np.log1p(n)
                s[8] = np.log1p(hi - lo)
                size = ends[lo:hi] - starts[lo:hi]
                s[9], s[10] = (size.mean(), size.std()) if hi > lo else (0, 0)
                s[11] = len(np.unique(h[lo:hi])) / m
                s[12] = np.log1p((row == 10).sum())
                s[13] = (size == 1).mean() if hi > lo else 0
                s[14] = len(np.unique(h[lo + 1 : hi] * np.uint64(3) + h[lo : hi - 1])) / m if hi - lo > 1 else 0
                s[15] = np.bincount(slot[lo:hi]).max() / m if hi > lo else 0
                s[16] = np.log1p(told[k]) if told[k] >= 0 else np.log1p(n)
                s[17] = told[k] < 0
            yield i, out


def pair_scores(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores by the sum-of-squares identity."""
    x = np.hstack([x[:, :WORDS], (x[:, WORDS:] - model["mean"]) / model["std"]]).clip(-6, 6)
    s = x @ model["v"]
    return 1 / (1 + np.exp(-np.clip(model["b"] + x @ model["w"] + 0.5 * ((s * s).sum(1) - (x * x) @ (model["v"] ** 2).sum(1)), -30, 30)))


def fit_machine(x: np.ndarray, y: np.ndarray, epochs: int = 25, seed: int = 3) -> dict:
    """A factorisation machine by Adam on batches of 128 rows."""
    mean, std = x[:, WORDS:].mean(0), x[:, WORDS:].std(0) + 1e-3
    z = np.hstack([x[:, :WORDS], (x[:, WORDS:] - mean) / std]).clip(-6, 6).astype(np.float32)
    rng = np.random.default_rng(seed)
    p = {"w": np.zeros(z.shape[1], np.float32), "v": rng.normal(0, 0.02, (z.shape[1], RANK)).astype(np.float32), "b": np.zeros(1, np.float32)}
    m, q, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for lo in range(0, len(z), 128):
            r = z[order[lo : lo + 128]]
            t += 1
            s = r @ p["v"]
            out = p["b"] + r @ p["w"] + 0.5 * ((s * s).sum(1) - (r * r) @ (p["v"] ** 2).sum(1))
            e = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[order[lo : lo + 128]])[:, None] / len(r)
            g = {"b": e.sum(0), "w": (r * e).sum(0) + 1e-4 * p["w"], "v": r.T @ (e * s) - p["v"] * ((r * r) * e).sum(0)[:, None] + 1e-3 * p["v"]}
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                q[k] = 0.99 * q[k] + 0.01 * g[k] * g[k]
                p[k] -= 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(q[k] / (1 - 0.99**t)) + 1e-8)
    return p | {"mean": mean, "std": std}


def _needed(docs: DataFrame) -> DataFrame:
    n = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"), n.alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """The model, from at most 2 * sample_rows labelled rows that are not held out, chosen by a hash of the id.

    An id with several labels counts with their mean; null labels don't count. With no labelled row every score is 0.5."""
    told = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    told = told.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("_y"))
    many = told.count()
    told = told.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < min(1.0, sample_rows / max(many, 1)) * (1 << 20)).limit(2 * sample_rows)
    rows = _needed(docs).join(told, "doc_id").select("text", "n_chars", "_y").limit(2 * sample_rows)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in features(batch.column(0), batch.column(1)):
                at = [np.flatnonzero(r) for r in block]
                yield pa.RecordBatch.from_arrays([batch.column(2)[i : i + len(block)], pa.array([a.astype("<i2").tobytes() for a in at]), pa.array([r[a].tobytes() for r, a in zip(block, at, strict=True)])], names=["y", "at", "n"])

    sample = sorted((r["y"], bytes(r["at"]), bytes(r["n"])) for r in rows.mapInArrow(sparse, "y double, at binary, n binary").collect())
    if not sample:
        return {"w": np.zeros(WORDS + STATS, np.float32), "v": np.zeros((WORDS + STATS, RANK), np.float32), "b": np.zeros(1, np.float32), "mean": np.zeros(STATS), "std": np.ones(STATS)}
    x = np.zeros((len(sample), WORDS + STATS), np.float32)
    for k, (_, at, n) in enumerate(sample):
        x[k, np.frombuffer(at, "<i2")] = np.frombuffer(n, np.float32)
    return fit_machine(x, np.array([s[0] for s in sample], np.float32))


def score(docs: DataFrame, labels: DataFrame, model: dict | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= threshold) of every row.

    A null text counts as empty and is scored from the other inputs. Repeated rows get a row each; a null id is not held
    out. n_chars may be missing or null. Other columns are left out.
    """
    model = model or fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.zeros(batch.num_rows)
            for i, block in features(batch.column(2), batch.column(3)):
                s[i : i + len(block)] = pair_scores(model, block)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _needed(docs).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
