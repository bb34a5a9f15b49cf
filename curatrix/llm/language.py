"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier per bit, over hashed byte n-grams of the lower-cased text, predicts
the bits. Loss-weighted decoding takes the language whose codeword has the smallest weighted loss, and flags a text as
ambiguous if the runner-up is close. The classifiers are fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import PIECE, byte_view, held_out, lean, row_blocks, small_batches

BITS = 12
SAMPLE_ROWS = 2400
MOST_LANGUAGES = 500
AMBIGUOUS = 0.6
SURE = 0.5  # of the weight of all codewords
UNKNOWN = "und"
_C3, _C2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_counts(col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Rows by blocks: the first row, and how often each hashed bigram and trigram of bytes occurs in each row."""
    data, off = byte_view(pc.utf8_lower(pc.fill_null(col.cast(pa.large_string()), "")))
    for a, b in row_blocks(off):
        for i in range(a, b, 256):
            j = min(i + 256, b)
            out = np.zeros((j - i, 1 << BITS), np.float32)
            for k in range(i, j):
                for lo in range(off[k], off[k + 1], PIECE):  # a very long row in pieces that overlap by two bytes
                    x = data[lo : min(lo + (PIECE) + 2, off[k + 1])].astype(np.uint32)
                    if len(x) > 2:
                        out[k - i] += np.bincount(((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * _C3) >> np.uint32(32 - BITS), minlength=1 << BITS)
                    if len(x) > 1:
                        out[k - i] += np.bincount(((x[:-1] << 8 | x[1:]) * _C2) >> np.uint32(32 - BITS), minlength=1 << BITS)
            yield i, out


def unit(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def code_matrix(classes: int, seed: int = 7) -> np.ndarray:
    """Codewords of +1 and -1: all distinct columns for up to 5 classes, else the best of 50 random ones by the least distance of rows."""
    if classes <= 5:
        cols = [[1] + [1 if v >> k & 1 else -1 for k in range(classes - 1)] for v in range(2 ** (classes - 1) - 1)]
        return np.array(cols, np.float32).T if cols else np.ones((classes, 1), np.float32)
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(classes)))
    draws = [rng.choice(np.array([-1, 1], np.float32), (classes, bits)) for _ in range(50)]
    return max(draws, key=lambda m: ((bits - m @ m.T) / 2 + bits * np.eye(classes)).min())


def fit_bits(x: np.ndarray, y: np.ndarray, steps: int = 200, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Logistic classifiers of all bits at once (y: +1 or -1 by row and bit), by Adam on all rows. The last column of x is all ones."""
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = x.T @ (-y / (1 + np.exp(np.clip(y * (x @ w), -30, 30)))) / len(x) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-1], w[-1]


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """The model, from about sample_rows rows with a language, as many of each language as there are, chosen by a hash of the id."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # The sample's bound: the MOST_LANGUAGES languages with the most rows are learned.
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    langs = sorted(counts)
    if not langs:
        return {"langs": []}
    per = max(8, sample_rows // len(langs))
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per / counts[k])))])
    chosen = rows.where(F.col("lang").isin(langs)).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).limit(2 * per * len(langs))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in gram_counts(batch.column(0)):
                at = [np.flatnonzero(r) for r in block]
                places, counts = ([v.tobytes() for v in x] for x in ([a.astype(np.int16) for a in at], [r[a] for r, a in zip(block, at, strict=True)]))
                yield pa.RecordBatch.from_arrays([batch.column(1)[i : i + len(block)].cast(pa.string()), pa.array(places, pa.binary()), pa.array(counts, pa.binary())], names=["lang", "at", "n"])

    with small_batches(docs.sparkSession):
        told = chosen.select("text", "lang").mapInArrow(sparse, "lang string, at binary, n binary").toArrow()
    sample = sorted(zip(*(told.column(c).to_pylist() for c in ("lang", "at", "n")), strict=True))
    sample = [s for k, s in enumerate(sample) if k % 5] + sample[::5]  # a fifth, at the end, tells how sure each bit is
    many = len(sample) - len(sample[::5]) if len(sample) > 1 else len(sample)
    x = np.zeros((len(sample), (1 << BITS) + 1), np.float32)
    for k, (_, at, n) in enumerate(sample):
        own = np.sqrt(np.frombuffer(n, np.float32))
        x[k, np.frombuffer(at, np.int16)] = own / max(float(np.linalg.norm(own)), 1e-9)
    x[:, -1] = 1
    code = code_matrix(len(langs))
    y = code[[langs.index(s[0]) for s in sample]] if sample else np.zeros((0, code.shape[1]), np.float32)
    w, b = fit_bits(x[:many], y[:many])
    wrong = ((x[many:, :-1] @ w + b) * y[many:] <= 0).mean(0) if len(x) > many else np.zeros(code.shape[1])
    wrong = np.clip(wrong, 0.005, 0.495)
    return {"langs": langs, "code": code, "w": w, "b": b, "weight": np.log((1 - wrong) / wrong) / np.log((1 - wrong) / wrong).mean()}


def decode(model: dict, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss-weighted decoding: the nearest codeword, its share of all (0 to 1), and whether the runner-up is close."""
    loss = np.stack([(model["weight"] * np.logaddexp(0, -row * margins)).sum(1) for row in model["code"]], 1)
    share = np.exp(-(loss - loss.min(1, keepdims=True)))
    share /= share.sum(1, keepdims=True)
    best = loss.argmin(1)
    rest = np.sort(loss, 1)
    close = rest[:, 1] - rest[:, 0] < AMBIGUOUS if loss.shape[1] > 1 else np.zeros(len(loss), bool)
    return best, share[np.arange(len(best)), best], close


def predictions(model: dict, col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    n = len(col)
    names, score, close = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
    if model["langs"]:
        for i, block in gram_counts(col):
            best, share, near = decode(model, unit(block) @ model["w"] + model["b"])
            for k in range(len(block)):
                names[i + k] = model["langs"][best[k]]
            score[i : i + len(block)], close[i : i + len(block)] = share, near
        for k, text in enumerate(col):
            if not has_letter(text.as_py()):
                names[k], score[k], close[k] = UNKNOWN, 0.0, False
    return names, score, close


def identify(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row.

    Texts that are null or have no letter are `und` with score 0; so are all if no row has a language. Texts of one
    letter are scored like others. Repeated rows get a row each. A null id is not held out. Other columns are left out.
    """
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, close = predictions(model, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(close)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_known(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """The rows whose language can be told, all columns, whatever their names. Rejected are texts that are null or have no
    letter, and those flagged ambiguous whose nearest codeword has less than SURE of the weight of all. Where no row has
    a language to learn from, nothing but the letters decides. Repeated rows stay, a very long text is a row like others, and
    an empty table gives no rows."""
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            if model["langs"]:
                names, score, close = predictions(model, texts)
                keep = [x != UNKNOWN and not (c and v < SURE) for x, v, c in zip(names, score, close, strict=True)]
            else:
                keep = [has_letter(x.as_py()) for x in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
