"""Best-fit packing of documents into token sequences by a linear grouping scheme.

Lengths are whole numbers up to the sequence length, so that a histogram of at most that many rows describes the whole
packing problem; only it reaches the driver. There, lengths over a quarter of the sequence are rounded up within groups
of equal cardinality, a linear programme over configurations of the few rounded sizes is solved by column generation,
actual lengths take the places of the rounded ones (at the last place of a sequence, the length that fills it best), and what
is left is placed best-fit, longest first. The plan is a list of (length, ranks from .. to, first sequence, offset), of a size
that depends on the lengths and not on the rows: documents find their place by their rank among those of their length, counted
in salted buckets, so that a length that a third of the rows have is no hot key.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import cut, lean

SEQUENCE = 2048
GROUPS = (96, 48, 24, 12)
SMALL = 4  # lengths up to this part of the sequence are small
EOS = 0
VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece int, start long, length long, ids_crc32 long"
BROADCAST_ROWS = 500_000

# White space that touches a space on both sides, or before a last space: there a cut at spaces isn't a cut between tokens.
_ODD_SPACE = re.compile(r"\s \s|\s \Z")
# The pattern by which the byte-level tokenizer splits texts (a fixed value).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CACHED = 400_000


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Token ids as little-endian 32-bit bytes, the same as the tokenizer gives.

    Words seen before come from a cache; others are merged by the ranks that the tokenizer's own file holds, if its
    merges are in the order of its ids (else by the tokenizer)."""

    def __init__(self, path: str):
        import json

        import tiktoken

        self.path, self.tokenizer = path, None
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        self.special, model = [t["content"] for t in whole.get("added_tokens") or []], whole["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [vocab["".join(m)] for m in merges]
        letters = _byte_letters()
        self.ranks = None
        if ids == sorted(ids) and not model.get("ignore_merges"):
            ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in self.special}
            self.ranks = tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        """By the tokenizer itself, which is loaded when it is first needed."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, text: str) -> bytes:
        return array("I", self.ranks.encode_ordinary(text)).tobytes()

    def word(self, word: str) -> bytes:
        """Of a word after a space."""
        ids = self.plain(" " + word)
        if len(word) < 40 and len(self.words) < _CACHED:
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.ranks is None or any(s in text for s in self.special):
            return self.whole(text)
        if _ODD_SPACE.search(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        get, miss = self.words.get, self.word
        return self.plain(first) + b"".join([get(w) or miss(w) for w in rest])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _vocabulary(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def token_pieces(docs: DataFrame, sequence: int = SEQUENCE, vocabulary: str | None = None) -> DataFrame:
    """The pieces of each document: its ids and one end mark, cut into pieces of `sequence` ids, of which the first may be shorter."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = encoder(_vocabulary(vocabulary))
        encode = held.encode
        end = np.array([EOS], "<u4").tobytes()
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(encode(text.as_py() or "") + end)
                n = len(ids) // 4
                first = (n - 1) % sequence + 1
                for k, (a, b) in enumerate(zip([0, *range(first, n, sequence)], range(first, n + 1, sequence), strict=True)):
                    rows.append((i, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        held.words.clear()  # the worker may go on to other tasks

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(pieces), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECES}")


# ---- the packing plan, from the histogram


def grouped_sizes(lengths: list[tuple[int, int]], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, count), longest first, in groups of equal cardinality: (rounded-up size, its members)."""
    total = sum(c for _, c in lengths)
    per, out, room = max(1, -(-total // groups)), [], 0
    for n, c in lengths:
        while c:
            if not room:
                out.append((n, []))
                room = per
            take = min(c, room)
            out[-1][1].append((n, take))
            c, room = c - take, room - take
    merged: list[tuple[int, list[tuple[int, int]]]] = []
    for n, members in out:
        if merged and merged[-1][0] == n:
            merged[-1][1].extend(members)
        else:
            merged.append((n, members))
    return merged


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Configurations of few sizes and how often each is used: column generation, rounded down."""
    k = len(sizes)
    columns = [np.zeros(k) for _ in range(k)]
    for j in range(k):
        columns[j][j] = capacity // sizes[j]
    basis = np.array(columns).T
    slots = int(capacity // sizes.min())
    x = demand / basis.diagonal()
    for _ in range(40 * k):
        try:
            duals = np.linalg.solve(basis.T, np.ones(k))
        except np.linalg.LinAlgError:
            break
        best = np.zeros(capacity + 1)
        chosen = []
        for _ in range(slots):  # the configuration of most value with one more document
            value = np.full((k, capacity + 1), -1.0)
            for j, s in enumerate(sizes):
                value[j, s:] = duals[j] + best[: capacity + 1 - s]
            pick = value.argmax(0)
            top = value[pick, np.arange(capacity + 1)]
            pick = np.where(top > best + 1e-12, pick, -1)
            chosen.append(pick)
            best = np.maximum(best, top)
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        for pick in reversed(chosen):
            j = pick[room]
            if j >= 0:
                column[j] += 1
                room -= sizes[j]
        step = np.linalg.solve(basis, column)
        rows = np.flatnonzero(step > 1e-9)
        if not len(rows):
            break
        out = rows[np.argmin(x[rows] / step[rows])]
        theta = x[out] / step[out]
        x = np.maximum(x - theta * step, 0)
        x[out] = theta
        basis[:, out] = column
    return [(int(n), basis[:, j].astype(int)) for j, n in enumerate(np.floor(x + 1e-6)) if n >= 1]


class _Runs:
    """Equal sequences together: gap -> list of [how many, the lengths in each]."""

    def __init__(self, capacity: int):
        self.capacity, self.by_gap, self.open = capacity, defaultdict(list), np.zeros(capacity + 1, bool)

    def add(self, many: int, lengths: tuple[int, ...]) -> None:
        if many:
            gap = self.capacity - sum(lengths)
            self.by_gap[gap].append((many, lengths))
            self.open[gap] = True

    def place(self, length: int, count: int) -> None:
        """Best-fit: each goes where the least room stays; a new sequence only if none has room."""
        while count:
            fits = np.flatnonzero(self.open[length:])
            if not len(fits):
                per = self.capacity // length
                full, rest = divmod(count, per)
                self.add(full, (length,) * per)
                self.add(1 if rest else 0, (length,) * rest)
                return
            gap = int(fits[0]) + length
            many, held = self.by_gap[gap].pop()
            self.open[gap] = bool(self.by_gap[gap])
            per = gap // length
            full = min(many, count // per)
            rest = min(count - full * per, per) if full < many else 0
            self.add(full, held + (length,) * per)
            self.add(1 if rest else 0, held + (length,) * rest)
            self.add(many - full - (1 if rest else 0), held)
            count -= full * per + rest


def _packed(lengths: np.ndarray, capacity: int, groups: int) -> _Runs:
    """Sequences for lengths[n] pieces of n tokens. Without groups there are no configurations, and all pieces are placed best-fit."""
    runs, left = _Runs(capacity), lengths.copy()
    runs.add(int(left[capacity]), (capacity,))
    left[capacity] = 0
    large = [(n, int(left[n])) for n in range(capacity - 1, capacity // SMALL, -1) if left[n]]
    if large and groups:
        few = len(large) <= groups  # then the sizes are the lengths themselves
        grouped = [(n, [(n, c)]) for n, c in large] if few else grouped_sizes(large, groups)
        sizes, demand = np.array([n for n, _ in grouped]), np.array([sum(c for _, c in m) for _, m in grouped], float)
        below = [*sizes[1:].tolist(), capacity // SMALL]

        def longest(low: int, top: int, taken: list[int]) -> int:
            """The longest length over low, up to top, of which a piece is left; 0 if there is none."""
            for n in (np.flatnonzero(left[low + 1 : top + 1])[::-1] + low + 1).tolist():
                if left[n] > taken.count(n):
                    return n
            return 0

        for many, config in configurations(sizes, demand, capacity):
            slots = [j for j, c in enumerate(config) for _ in range(c)]
            while many:  # actual lengths take the places, at the last place whatever fills the sequence best; equal sequences make one run
                taken: list[int] = []
                for k, j in enumerate(slots):
                    room = capacity - sum(taken)
                    if few:
                        n = longest(int(sizes[j]) - 1, int(sizes[j]), taken)
                    elif k < len(slots) - 1:
                        n = longest(below[j], min(room, int(sizes[j])), taken)
                    else:
                        n = longest(0, room, taken)
                    if not n:
                        break
                    taken.append(n)
                if len(taken) < len(slots):
                    break
                step = min(many, *(int(left[n]) // taken.count(n) for n in taken))
                for n in taken:
                    left[n] -= step
                runs.add(step, tuple(taken))
                many -= step
    for n in np.flatnonzero(left)[::-1].tolist():
        runs.place(n, int(left[n]))
    return runs


def plan(histogram: dict[int, int], capacity: int = SEQUENCE, groups: tuple[int, ...] = GROUPS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, end of ranks, first sequence, offset) for all pieces, and how many sequences there are.

    The numbers of groups are tried in turn and the fewest sequences win; no groups at all, which is plain best-fit, is
    tried too, so that the plan is never worse."""
    lengths = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        lengths[n] = c
    tried = [_packed(lengths, capacity, g) for g in (*groups, 0)]
    runs = min(tried, key=lambda r: sum(many for kept in r.by_gap.values() for many, _ in kept))
    rows, ranks, sequence = [], defaultdict(int), 0
    for kept in runs.by_gap.values():
        for many, lengths in kept:
            offset = 0
            for n in lengths:
                rows.append((n, ranks[n], ranks[n] + many, sequence, offset))
                ranks[n] += many
                offset += n
            sequence += many
    return rows, sequence


def pack(docs: DataFrame, sequence: int = SEQUENCE, vocabulary: str | None = None, groups: tuple[int, ...] = GROUPS) -> DataFrame:
    """One row per piece with its place: sequence_id and offset.

    A null text counts as empty: one end mark. Repeated rows and equal or null ids are packed each on its own. An empty
    table gives no rows. Other columns are left out.
    """
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, sequence, vocabulary))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `sequence` rows
    rows, _ = plan(histogram, sequence, groups)
    places = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "length long, from_rank long, to_rank long, first_sequence long, offset long")
    buckets = max(16, sum(histogram.values()) // 50_000)
    salted = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sums = salted.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = sums.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).drop("_n")
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_row", F.row_number().over(within) - 1).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_row"))
    places = F.broadcast(places) if len(rows) <= BROADCAST_ROWS else cut(places)
    placed = ranked.join(places, "length").where((F.col("_rank") >= F.col("from_rank")) & (F.col("_rank") < F.col("to_rank")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("_rank") - F.col("from_rank")).alias("sequence_id"), "offset")
