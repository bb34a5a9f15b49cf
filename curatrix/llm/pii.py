"""Personal data: fixed patterns, and a skip-chain conditional random field that carries their labels to similar tokens.

Nodes are the spans that the patterns find (their labels are fixed) and weaker candidates: runs of digits and
separators, and addresses with a written-out at sign. Neighbouring nodes, of either sort, share a chain potential; nodes with
the same digits or the same address, however far apart, share a skip potential. Loopy message passing gives each
candidate's marginal, and one that is likelier some kind than `other` is added.

Node weights and both tables of potentials are learned together, by pseudo-likelihood, from a bounded sample of rows. Their
labels come from the patterns: a candidate counts as `other`, but for those that the patterns can't speak of (written-out
addresses, and tokens similar to a fixed span), whose labels are left open. As labels are weak, a candidate's own log odds
are kept within ODDS, so that what the rest of the document says can outweigh them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
SAMPLE_ROWS = 3000
ODDS = 2.0
REACH = 80  # characters between neighbours
AGREE = 3.0  # the skip potential of like labels before anything is learned
ROUNDS = 40

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"\+?[0-9](?:[\x20().-]{0,3}[0-9]){6,18}(?![0-9])")
_WRITTEN = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++)\x20?[(\[]at[)\]]\x20?([A-Za-z0-9-]++)((?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)+)")
_CUES = {"mail": 0, "e-mail": 0, "email": 0, "ip": 1, "host": 1, "address": 1, "card": 2, "visa": 2, "phone": 3, "tel": 3, "call": 3, "fax": 3, "mobile": 3}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if k % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start. Each pattern takes time in proportion to the text."""
    out = []
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:
            a = at
            while a > done and text[a - 1] in _LOCAL:
                a -= 1
            m = _DOMAIN.match(text, at + 1) if a < at else None
            if m:
                out.append((0, a, m.end()))
                done = m.end()
            at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def nodes(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(start, end, label or -1, key) in the order of the text; candidates don't touch the fixed spans. Equal keys are similar tokens."""
    out = []
    for kind, a, b in base:
        out.append((a, b, kind, text[a:b].lower() if kind == 0 else text[a:b] if kind == 1 else _digits(text[a:b])[-9:]))
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken])
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else starts

    def free(a: int, b: int) -> bool:
        k = int(np.searchsorted(starts, b)) if len(starts) else 0
        return not k or reach[k - 1] <= a

    if "at)" in text or "at]" in text:
        for m in _WRITTEN.finditer(text):
            if free(m.start(), m.end()):
                out.append((m.start(), m.end(), -1, f"{m[1]}@{m[2]}{re.sub(r'[\x20()\[\]]|dot(?=[)\]])', lambda x: '.' if x[0] == 'dot' else '', m[3])}".lower()))
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            if free(m.start(), m.end()):
                out.append((m.start(), m.end(), -1, _digits(m[0])[-9:]))
    return sorted(out)


WIDTH = 4 + 4 + 5 + 1


def node_features(text: str, a: int, b: int) -> np.ndarray:
    """Shape and the word before: nothing that tells whether a fixed pattern matched."""
    x, s = np.zeros(WIDTH), text[a:b]
    n = len(_digits(s))
    x[0 if "@" in s or "at)" in s or "at]" in s else 1 if s.count(".") == 3 else 2 if n >= 13 else 3] = 1
    for k, c in enumerate("-. ("):
        x[4 + k] = c in s
    cue = re.findall(r"[a-z-]+", text[max(0, a - 16) : a].lower())
    x[8 + (_CUES.get(cue[-1], 4) if cue else 4)] = 1
    x[-1] = 1
    return x


def allowed(s: str) -> np.ndarray:
    """Which labels a span of text can have at all: an address has an at sign, an ip four parts up to 255, a card a check digit that holds."""
    d = _digits(s)
    at = "@" in s or "at)" in s or "at]" in s
    parts = s.split(".")
    ip = len(parts) == 4 and all(p.isdigit() and p.isascii() and int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in parts)
    return np.array([at, ip, not at and 13 <= len(d) <= 19 and luhn(d), not at and 9 <= len(d) <= 15, True])


def edges(all_nodes: list[tuple[int, int, int, str]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Pairs of neighbours, and pairs of similar nodes of which the second is the next after the first."""
    chain = [(k - 1, k) for k in range(1, len(all_nodes)) if all_nodes[k][0] - all_nodes[k - 1][1] < REACH]
    last: dict[str, int] = {}
    skip = []
    for k, node in enumerate(all_nodes):
        if node[3] in last:
            skip.append((last[node[3]], k))
        last[node[3]] = k
    return chain, skip


def _told(text: str) -> Iterator[tuple[int, ...]]:
    """Of each node whose label the patterns tell: its features, its label, and those of its neighbours and of similar nodes (-1: none, or open)."""
    all_nodes = nodes(text, base_spans(text))
    if not all_nodes:
        return
    chain, skip = edges(all_nodes)
    fixed = {key for _, _, label, key in all_nodes if label >= 0}
    label = [v if v >= 0 else -1 if key in fixed or "@" in key else OTHER for _, _, v, key in all_nodes]
    near = [[-1] * 4 for _ in all_nodes]
    for k, pairs in ((0, chain), (2, skip)):
        for i, j in pairs:
            near[j][k], near[i][k + 1] = label[i], label[j]
    for (a, b, _, _), y, others in zip(all_nodes, label, near, strict=True):
        if y >= 0:
            yield (*node_features(text, a, b).astype(int).tolist(), y, *others)


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Node weights, chain and skip potentials, from a sample of rows chosen by a hash of the id."""
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    many = max(1, docs.count())
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < min(1.0, sample_rows / many) * (1 << 20)).limit(2 * sample_rows)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple[int, ...], int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for k in _told(text):
                    count[k] = count.get(k, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in count], pa.list_(pa.int32())), pa.array(list(count.values()), pa.int64())], names=["k", "n"])

    told = rows.select("text").mapInArrow(sums, "k array<int>, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # at most one row per combination of features and labels
    return learned(sorted((tuple(r["k"]), r["n"]) for r in told))


def learned(data: list[tuple[tuple[int, ...], int]]) -> dict:
    """The model of such rows and their counts, by gradient ascent of the pseudo-likelihood; potentials stay near their start where nothing is told."""
    w, start = np.zeros((WIDTH, OTHER + 1)), AGREE * np.eye(OTHER + 1)
    chain, skip = np.zeros_like(start), start.copy()
    if data:
        k, n = np.array([d[0] for d in data]), np.array([d[1] for d in data], float)
        x, y, share = k[:, :WIDTH].astype(float), np.eye(OTHER + 1)[k[:, WIDTH]], (n / n.sum())[:, None]
        one = np.vstack([np.eye(OTHER + 1), np.zeros(OTHER + 1)])  # -1: the last row
        near, alike = one[k[:, WIDTH + 1]] + one[k[:, WIDTH + 2]], one[k[:, WIDTH + 3]] + one[k[:, WIDTH + 4]]
        for _ in range(400):
            p = x @ w + near @ chain + alike @ skip
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            miss = (y - p) * share
            w += 0.5 * (x.T @ miss - 1e-3 * w)
            for table, seen, kept in ((chain, near, 0), (skip, alike, start)):
                step = seen.T @ miss
                table += 0.5 * ((step + step.T) / 2 - 1e-3 * (table - kept))
    return {"w": w, "chain": chain, "skip": skip}


def infer(unary: np.ndarray, links: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Log marginals by loopy message passing; each link has its table of potentials. Exact where the links make no loop."""
    def marginals(belief: np.ndarray) -> np.ndarray:
        belief = belief - belief.max(1, keepdims=True)
        return belief - np.log(np.exp(belief).sum(1, keepdims=True))

    if not links:
        return marginals(unary)
    i, j = np.array([x[0] for x in links]), np.array([x[1] for x in links])
    table = np.array([x[2] for x in links])
    src, dst, table = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([table, table.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(i)) + len(i), np.arange(len(i))])
    msg = np.zeros((len(src), unary.shape[1]))
    for _ in range(max(ROUNDS, 2)):
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        out = (belief[src] - msg[back])[:, :, None] + table
        top = out.max(1)
        new = np.log(np.exp(out - top[:, None, :]).sum(1)) + top
        new -= new.max(1, keepdims=True)
        done = np.abs(new - msg).max() < 1e-6
        msg = 0.3 * msg + 0.7 * new
        if done:
            break
    belief = unary.copy()
    np.add.at(belief, dst, msg)
    return marginals(belief)


def find(text: str | None, model: dict) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The fixed spans, and those that the random field adds: candidates that are likelier some kind than all else."""
    text = text or ""
    if "@" not in text and not _DIGIT.search(text) and "at)" not in text and "at]" not in text:
        return [], []
    base = base_spans(text)
    all_nodes = nodes(text, base)
    if all(n[2] >= 0 for n in all_nodes):
        return base, []
    odds = np.array([node_features(text, a, b) for a, b, _, _ in all_nodes]) @ model["w"]
    odds = np.clip(odds - odds[:, [OTHER]], -ODDS, ODDS)
    for k, n in enumerate(all_nodes):
        odds[k, np.arange(OTHER + 1) != n[2] if n[2] >= 0 else ~allowed(text[n[0] : n[1]])] = -1e3
    chain, skip = edges(all_nodes)
    belief = infer(odds, [(i, j, model["chain"]) for i, j in chain] + [(i, j, model["skip"]) for i, j in skip])
    label = belief.argmax(1)
    return base, [(int(label[k]), n[0], n[1]) for k, n in enumerate(all_nodes) if n[2] < 0 and label[k] != OTHER and belief[k, label[k]] > np.log(0.5)]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def detect(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, counts of the fixed patterns by kind, base_sha256, spans (fixed and added) and n_added of every row.

    Null and empty texts have no spans. Repeated rows get a row each. Other columns are left out.
    """
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, spans, added = np.zeros((len(KINDS), batch.num_rows), np.int64), [], [], []
            for k, text in enumerate(batch.column(1)):
                base, more = find(text.as_py(), model)
                for kind, _, _ in base:
                    n[kind, k] += 1
                sha.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(base + more))
                added.append(len(more))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, n), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], names=["doc_id", *(f"n_{x}" for x in KINDS), "base_sha256", "spans", "n_added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """All rows and columns, personal data in text replaced; n_chars, where there is one, follows the text."""
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out, changed = batch.schema.get_field_index("text"), [], []
            for text in batch.column(at).to_pylist():
                base, more = find(text, model)
                out.append(redacted(text, base + more) if base or more else text)
                changed.append(bool(base or more))
            batch = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
            n = batch.schema.get_field_index("n_chars")
            if n >= 0 and any(changed):
                told = [len(t) if c and v is not None else v for t, c, v in zip(out, changed, batch.column(n).to_pylist(), strict=True)]
                batch = batch.set_column(n, batch.schema.field(n), pa.array(told, batch.schema.field(n).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
