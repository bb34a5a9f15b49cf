"""Removal of long repeated byte strings, by suffix groups.

Every window of LENGTH bytes is assigned to its anchor: the 64-byte string in it with the least hash. The windows of one
anchor are parted by where the anchor stands in them; those of one part have a core of 232 bytes in common. Equal windows
have equal cores, so windows are compared only among the stretches of text that share a core. Stretches that are equal as
a whole are found by their hashes and need no comparison; one of each different kind goes on, with the core, which all of a
group have in common, as one character. For cores of up to MOST_SHARERS kinds, the suffixes of these stretches are sorted by
the linear grouping construction: groups of suffixes are processed from the highest to the lowest, pointers to the nearest
place before in a lower group build the groups by Lyndon prefix, and each group's order is emitted from that of the suffixes its
pointers come from, with no recursion or renaming. Windows that are equal then stand side by side. More common cores' stretches
are parted more finely in the same way, and only windows of fine parts that are shared but not equal as a whole are left;
they are dealt by their core and hash, so that no task gets a whole group: the result is the same, whichever way a core goes.

Texts are told apart by two 64-bit hashes. Windows are equal if their cores' 64-bit hashes are and the bytes around them
(or a second 64-bit hash, that of the whole stretch or window) are too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import BASE, PIECE, _power_tables, byte_view, cut, lean, mix, row_blocks, word_hashes

LENGTH = 400
GRAM = 64
WORDS, WORD_GRAM = 50, 5  # of a passage that is reported, whatever its bytes
PARTS, FINE_PARTS = 2, 32
MOST_SHARERS = 48
BROADCAST_IDS = 500_000
BLOCK = PIECE


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sums of the bytes before each place, and what brings the sum of a string to the same scale."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums, down


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each string of so many bytes."""
    sums, down = _sums(data)
    return mix((sums[size:] - sums[:-size]) * down[: len(sums) - size])


def least_in_window(h: np.ndarray, w: int) -> np.ndarray:
    n = len(h)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def parted(sums: np.ndarray, down: np.ndarray, p: np.ndarray, i: np.ndarray, j: np.ndarray, parts: int, length: int = LENGTH, gram: int = GRAM) -> Iterator[np.ndarray]:
    """The windows from i to j, whose anchor is at p, by where it stands in them: columns as of stretches."""
    w = length - gram + 1
    hashes = lambda a, b, salt: mix(mix((sums[b] - sums[a]) * down[a]) ^ (b - a + salt).astype(np.uint64) * np.uint64(BASE)).view(np.int64)
    for k in range(parts):
        near, far = -(-k * w // parts), -(-(k + 1) * w // parts) - 1  # from the window's start to the anchor
        first, last = np.maximum(i, p - far), np.minimum(j, p - near)
        has = first <= last
        if has.any():
            first, last, at = first[has], last[has], p[has]
            yield np.stack([hashes(at - near, at - far + length, k << 32), hashes(first, last + length, 0), first, last])


def stretches(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[np.ndarray]:
    """Columns core, whole, first, last: the windows that start from first to last have one anchor and are of one part;
    the hashes of what all of that part have in common, and of the bytes from first to the end of the last window."""
    w = length - gram + 1
    for lo in range(0, len(data) - length + 1, BLOCK):
        part = data[lo : lo + BLOCK + length - 1]
        sums, down = _sums(part)
        h = mix((sums[gram:] - sums[:-gram]) * down[: len(sums) - gram])
        least = least_in_window(h, w)
        ends = np.flatnonzero(np.append(least[1:] != least[:-1], True))
        runs, i = [], 0
        for j in ends.tolist():
            while i <= j:  # equal hashes within reach: each has the windows up to it
                p = i + int(h[i : i + w].argmin())
                runs.append((p, i, min(p, j)))
                i = runs[-1][2] + 1
        for x in parted(sums, down, *np.array(runs, np.int64).T, PARTS, length, gram):
            x[2:] += lo
            yield x


def suffix_order(s: str) -> list[int]:
    """The suffixes of s in order, by linear grouping.

    Suffixes start in groups by their first character. From the highest group to the lowest, each member's pointer goes to
    the nearest place before it in a lower group; the places pointed to leave their group for a new one just above it, those
    with more pointers higher, and so grow their common prefix by the group's. At the end a group holds the suffixes with
    one longest Lyndon prefix. Its order then follows from that of the suffixes behind these prefixes, which are lower: from each
    suffix in order, the chain of pointers from the place before it leads to the next members of their groups."""
    n = len(s)
    members = sorted(range(n), key=s.__getitem__)
    place, start, size = [0] * n, [0] * n, [0] * (n + 1)  # a group is known by where it starts among the members
    g, last = 0, None
    for k, i in enumerate(members):
        if s[i] != last:
            g, last = k, s[i]
        place[i], start[i] = k, g
        size[g] += 1
    smaller, top = [-1] * n, n
    while top:
        g = start[members[top - 1]]
        led: dict[int, int] = {}
        for i in sorted(members[g:top]) if top - g > 1 else members[g:top]:
            j = i - 1
            while j >= 0 and start[j] >= g:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                led[j] = led.get(j, 0) + 1
        levels: dict[int, list[int]] = {}
        for j, c in led.items():
            levels.setdefault(c, []).append(j)
        for c in sorted(levels, reverse=True) if len(levels) > 1 else levels:
            for j in levels[c]:  # to its group's end
                h = start[j]
                size[h] -= 1
                end, at = h + size[h], place[j]
                other = members[end]
                members[at], place[other] = other, at
                members[end], place[j] = j, end
            for j, h in [(j, start[j] + size[start[j]]) for j in levels[c]]:
                start[j] = h
                size[h] += 1
        top = g
    order, filled, done = [0] * n, [0] * n, [False] * n
    for k in range(-1, n):
        j = (order[k] if k >= 0 else n) - 1
        while j >= 0 and not done[j]:
            h, done[j] = start[j], True
            order[h + filled[h]] = j
            filled[h] += 1
            j = smaller[j]
    return order


def repeated_starts(texts: list[str], starts: list[int], length: int = LENGTH) -> list[tuple[int, int] | None]:
    """Of each of some different texts: the first and last start, below starts[k], of a string of `length` characters that is also in another."""
    whole = "".join(t + chr(0x1000 + k) for k, t in enumerate(texts))
    owner = [k for k, t in enumerate(texts) for _ in range(len(t) + 1)]
    first = [0]
    for t in texts:
        first.append(first[-1] + len(t) + 1)
    out: list[tuple[int, int] | None] = [None] * len(texts)

    def mark(p: int) -> None:
        k = owner[p]
        o = p - first[k]
        out[k] = (o, o) if out[k] is None else (min(out[k][0], o), max(out[k][1], o))

    held = None
    for p in suffix_order(whole):
        if p - first[owner[p]] >= starts[owner[p]]:
            continue
        if held is not None and whole[held : held + length] == whole[p : p + length]:
            mark(held)
            mark(p)
        held = p
    return out


def around_core(context: bytes, length: int = LENGTH, gram: int = GRAM, parts: int = PARTS) -> tuple[str, int]:
    """A stretch's context with its core as one character, and how many bytes that has."""
    w = length - gram + 1
    p = int(gram_hashes(np.frombuffer(context, np.uint8)[:length], gram).argmin())  # all windows of a stretch have this anchor
    k = p * parts // w
    near, far = -(-k * w // parts), -(-(k + 1) * w // parts) - 1
    return context[: p - near].decode("latin-1") + "\u0fff" + context[p - far + length :].decode("latin-1"), near - far + length


def _stretch_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = set()
        for batch in batches:
            data, off = byte_view(batch.column(1))
            found = [np.zeros((6, 0), np.int64)]
            for k, text in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if off[k + 1] - off[k] < LENGTH or text in given:
                    continue
                if len(given) < 200_000:
                    given.add(text)
                for x in stretches(data[off[k] : off[k + 1]]):
                    found.append(np.concatenate([x, np.repeat(np.array([text]).T, x.shape[1], 1)]))
            core, whole, first, last, d, e = np.concatenate(found, 1)
            yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(whole), pa.array(d), pa.array(e), pa.array(first), pa.array((last - first).astype(np.int16))], names=["core", "whole", "d", "e", "lo", "more"])

    return docs.select("d", "text", "e").mapInArrow(lean(run), "core long, whole long, d long, e long, lo long, more short")


def _contexts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = byte_view(batch.column(1))
            rows = []
            for k, (d, told, e) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x = data[off[k] : off[k + 1]]
                for t in told:
                    rows.append((t["core"], t["n"], t["sure"], d, e, t["lo"], t["more"] + 1, x[t["lo"] : t["lo"] + t["more"] + LENGTH].tobytes()))
                    if len(rows) == 20_000:
                        yield _context_batch(rows)
                        rows = []
            yield _context_batch(rows)

    return docs.select("d", "text", "told", "e").mapInArrow(lean(run), "core long, n long, sure boolean, d long, e long, lo long, starts long, context binary")


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 8
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["core", "n", "sure", "d", "e", "lo", "starts", "context"])


def _by_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by core: the spans of each core's different stretches that another has too."""
    out: list[tuple[int, int, int, int]] = []

    def settle(group: list[dict]) -> None:
        if all(r["sure"] for r in group):
            return
        cores = [around_core(r["context"]) for r in group]  # of one length, as all are of one part
        for r, span in zip(group, repeated_starts([x for x, _ in cores], [r["starts"] for r in group], LENGTH - cores[0][1] + 1), strict=True):
            if span and not r["sure"]:
                out.append((r["d"], r["e"], r["lo"] + span[0], r["lo"] + span[1] + LENGTH))

    group: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if group and group[0]["core"] != r["core"]:
                settle(group)
                group = []
            group.append(r)
        yield _span_batch(out)
        out.clear()
    if group:
        settle(group)
    yield _span_batch(out)


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["d", "e", "first", "last"])


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each stretch, known by d and its start at, by finer parts."""
    for batch in batches:
        found = [np.zeros((7, 0), np.int64)]
        for r in batch.to_pylist():
            x = np.frombuffer(r["context"], np.uint8)
            sums, down = _sums(x)
            p = gram_hashes(x[:LENGTH], GRAM).argmin()  # all windows of a stretch have this anchor
            for part in parted(sums, down, np.array([p]), np.array([0]), np.array([r["starts"] - 1]), FINE_PARTS):
                part[2:] += r["lo"]
                found.append(np.concatenate([part, [[r["d"]], [r["e"]], [r["lo"]]]]))
        core, whole, first, last, d, e, at = np.concatenate(found, 1)
        yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(whole), pa.array(d), pa.array(e), pa.array(at), pa.array(first), pa.array((last - first).astype(np.int16))], names=["core", "whole", "d", "e", "at", "lo", "more"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the parts that each stretch is told."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            own = gram_hashes(np.frombuffer(r["context"], np.uint8), LENGTH).view(np.int64)
            for t in r["told"]:
                k = t["lo"] - r["lo"]
                h = own[k : k + t["more"] + 1]
                same = [np.full(len(h), x) for x in (t["core"], r["d"], r["e"])]
                out.append(np.stack([h, *same, t["lo"] + np.arange(len(h))]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, 1)], names=["h", "core", "d", "e", "s"])


def _shared(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows core, whole, d, lo, more: the distinct kinds (core and whole) of cores that are in several places, with x <> y where
    such a kind is in several places too; the spans of all rows of those kinds; and cores with several kinds of which some are in one place."""
    # Rows of one text come from each task that has a copy of it, so places are compared, not counted.
    here = F.xxhash64("d", "e", "lo")
    # The small sides are written first: a join of two plain shuffles can be split where one core has very many rows.
    places = rows.groupBy("core").agg(F.min(here).alias("x"), F.max(here).alias("y")).where("x <> y").select("core")
    held = cut(rows.join(cut(places), "core", "left_semi"))
    other = [F.col(c) for c in rows.columns if c not in ("core", "whole")]
    kinds = cut(held.groupBy("core", "whole").agg(F.min(here).alias("x"), F.max(here).alias("y"), F.min_by(F.struct(*other), here).alias("one")))
    equal = held.join(kinds.where("x <> y").select("core", "whole"), ["core", "whole"], "left_semi")
    many = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("x") == F.col("y")).alias("open")).where("n > 1 and open")
    return kinds, equal.select("d", "e", F.col("lo").alias("first"), (F.col("lo") + F.col("more") + LENGTH).alias("last")), cut(many.select("core", "n"))


def passages(rows: DataFrame) -> DataFrame:
    """d and n of the texts (d, text) with passages of WORDS words or more that other places have too: in how many stretches.

    As with bytes, windows of WORDS words are parted by anchor, and equal windows have equal cores, here of 27 words; places
    that share a core are reported, so that no repeated passage is missed, and what is reported repeats in 27 words at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = set()
        for batch in batches:
            data, off = byte_view(batch.column(1))
            ids, found = batch.column(0).to_pylist(), [np.zeros((3, 0), np.int64)]
            for a, b in row_blocks(off):
                words, first, _, _ = word_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a])
                for k in range(a, b):
                    own = words[first[k - a] : first[k - a + 1]]
                    if len(own) < WORDS or ids[k] in given:
                        continue
                    if len(given) < 200_000:
                        given.add(ids[k])
                    found += [np.stack([x[0], np.full(x.shape[1], ids[k]), x[2]]) for x in stretches(own, WORDS, WORD_GRAM)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(found, 1)], names=["core", "d", "lo"])

    # Both are written, so that the texts are read once and a join of two plain shuffles can be split at a very common core.
    found = cut(rows.select("d", "text").mapInArrow(lean(run), "core long, d long, lo long").select("core", "d", F.xxhash64("d", "lo").alias("place")))
    several = cut(found.groupBy("core").agg(F.min("place").alias("x"), F.max("place").alias("y")).where("x <> y").select("core"))
    return found.join(several, "core", "left_semi").groupBy("d").agg(F.count_distinct("place").alias("n"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_passages of every row.

    A byte is removed if a string of LENGTH bytes that covers it also starts elsewhere, in the same document or another;
    a null text is empty. Passages of WORDS words that repeat are often shorter than that and stay, but n_passages tells of
    them (0: none). Rows with equal texts of that length are removed whole. A very long text is read in blocks. Repeated and null ids are rows like
    others; an empty table gives no rows, and other columns are left out."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("d", F.xxhash64("text")).withColumn("e", F.xxhash64(F.lit(1), "text"))  # texts are told apart by both
    texts = cut(rows.groupBy("d", "e").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep")))
    kinds, equal, many = _shared(cut(_stretch_rows(rows)))
    # One stretch of each kind, where a core has several kinds and not all are known to be repeated.
    one = kinds.join(many, "core").select("core", "n", (F.col("x") != F.col("y")).alias("sure"), "one.*")
    told = cut(one.groupBy("d", "e").agg(F.collect_list(F.struct("core", "n", "sure", "lo", "more")).alias("told")).join(texts, ["d", "e"]).select(F.col("d").alias("_d"), F.col("e").alias("_e"), "rep", "told"))
    reps = told.select("rep").where("rep is not null").distinct()
    named = rows
    if reps.count() <= BROADCAST_IDS and not told.where("rep is null").count():
        named = rows.join(F.broadcast(reps), F.col("doc_id") == F.col("rep"), "left_semi")
    same = (F.col("d") == F.col("_d")) & (F.col("e") == F.col("_e")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    kept = cut(_contexts(named.join(told.hint("shuffle_hash"), same)))

    few = kept.where(F.col("n") <= MOST_SHARERS).drop("n").repartition("core").sortWithinPartitions("core").mapInArrow(lean(_by_suffixes), "d long, e long, first long, last long")
    common = kept.where(F.col("n") > MOST_SHARERS).select("d", "e", "lo", "starts", "context")
    kinds, alike, many = _shared(cut(common.mapInArrow(lean(_finer), "core long, whole long, d long, e long, at long, lo long, more short")))
    open_parts = kinds.join(many, "core").groupBy(F.col("one.d").alias("d"), F.col("one.e").alias("e"), F.col("one.at").alias("at")).agg(F.collect_set(F.struct("core", "one.lo", "one.more")).alias("told"))
    left = common.dropDuplicates(["d", "e", "lo"]).join(open_parts.withColumnRenamed("at", "lo"), ["d", "e", "lo"])
    windows = cut(left.select("d", "e", "lo", "context", "told").mapInArrow(lean(_windows), "h long, core long, d long, e long, s long"))
    place = F.xxhash64("d", "e", "s")
    seen = windows.groupBy("h", "core").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select("h", "core")
    rest = windows.join(seen, ["h", "core"], "left_semi").select("d", "e", F.col("s").alias("first"), (F.col("s") + LENGTH).alias("last"))
    spans = cut(equal.unionByName(few).unionByName(alike).unionByName(rest).distinct())
    by_text = spans.groupBy("d", "e").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans")).join(texts.where("copies > 1").select("d", "e", "copies"), ["d", "e"], "full")
    by_words = cut(passages(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text, copies, own, n in zip(batch.column(0).to_pylist(), batch.column(1), *(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                x = text.as_py().encode()
                merged: list[list[int]] = [[0, len(x)]] if copies and len(x) >= LENGTH else []
                for s in own or [] if not merged else []:
                    if merged and s["first"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["last"])
                    else:
                        merged.append([s["first"], s["last"]])
                kept, at = hashlib.sha256(), 0
                for a, b in merged:
                    kept.update(x[at:a])
                    at = b
                kept.update(x[at:])
                n = max(n or 0, int(bool(copies) and len(x.split()) >= WORDS))
                out.append((i, len(x), sum(b - a for a, b in merged), len(merged), kept.hexdigest(), n))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(0).type), *[pa.array(c, pa.int64()) for c in cols[1:4]], pa.array(cols[4], pa.string()), pa.array(cols[5], pa.int64())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    told = by_text.join(by_words, "d", "full").select(F.col("d").alias("_d"), F.col("e").alias("_e"), "copies", "spans", "n")
    same = (F.col("d") == F.col("_d")) & (F.col("_e").isNull() | (F.col("e") == F.col("_e")))
    final = rows.join(told.hint("shuffle_hash"), same, "left").select("doc_id", "text", "copies", "spans", "n")
    return final.mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long")
