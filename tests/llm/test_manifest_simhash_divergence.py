"""The manifest, the SimHash links and the divergence audit against brute force, on tables and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from curatrix.llm import divergence, merkle, queries, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {c: c + 32 for c in range(65, 91)}
LONG = " ".join(f"Word{k % 977}x{k % 13}" for k in range(20_000))
ODD = [
    (3, "Some Words Here And There", "aa", "s", 5), (1, None, "aa", "s", None), (2, "", None, None, 0), (2, "", None, None, 0), (2, "", None, None, 0), (None, "no Id", "aa", "t", 1),
    (9, LONG, "bb", "s", 7), (10, LONG + " End", "bb", "t", 7), (11, "one", "é", "t", 7), (12, "ONE", "aa", "t", 7), (13, "Ünïcode stays ÜBER two", "aa", "s", 3), (None, None, None, None, None),
    (-5, "\t \x0b ", "aa", "", 3), (14, "x" * 100_000, "aa", "s", 1), (15, "x" * 100_000 + "y", "aa", "t", 1), (16, "x" * 100_000, "aa", "t", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    extra = {"leaf": F.lit("clash"), "tree": F.lit(1.5), "_place": F.lit(True), "term": F.lit("q"), "fingerprint": F.lit("f"), "component_id": F.lit(0), "n": F.lit(1)}
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).withColumns(extra)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, low=False):
    out = ""
    for k, v in zip(("doc_id", "source", "lang", "n_chars", "text"), (row[0], row[3], row[2], row[4], row[1]), strict=True):
        v = None if v is None else str(v).translate(LOWER) if low and k == "text" else str(v)
        out += "-" if v is None else f"{len(v.encode())}:{v}"
    return h(out)


def grow(digests):
    """The root of digests and each one's path: its place in the run and the others."""
    paths, level, under = [[] for _ in digests], list(digests), [[k] for k in range(len(digests))]
    while len(level) > 1:
        runs = [range(a, min(a + 8, len(level))) for a in range(0, len(level), 8)]
        for run in runs:
            for k in run:
                for leaf in under[k]:
                    paths[leaf].append((k - run[0], [level[x] for x in run if x != k]))
        level, under = [h(*[level[k] for k in run]) for run in runs], [sum((under[k] for k in run), []) for run in runs]
    return level[0], paths


def manifest(rows):
    """Expected rows of the audit, as a multiset."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    held = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for x in langs}
    trees = {x: grow([leaf_of(r) for r in held[x]]) for x in langs}
    root, over = grow([trees[x][0] for x in langs])
    out = Counter()
    for at, x in enumerate(langs):
        for r, path in zip(held[x], trees[x][1], strict=True):
            path = path + over[at]
            node = leaf_of(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for k, others in path:
                node = h(*others[:k], node, *others[k:])
            out[r[0], leaf_of(r), trees[x][0], root, h(*[d for _, others in path for d in others]), node, node == root] += 1
    return out


def test_manifest_of_odd_rows(odd):
    got = Counter(tuple(r) for r in merkle.audit(odd).collect())
    assert got == manifest(ODD)
    assert {r[0] for r in got if not r[6]} <= {r[0] for r in ODD if r[0] is not None}


@pytest.mark.parametrize("n", [1, 8, 9, 65])
def test_manifest_of_one_language(spark, n):
    rows = [(k * 7 % 101, f"Text {k}", "aa", "s", k) for k in range(n)]
    assert Counter(tuple(r) for r in merkle.audit(spark.createDataFrame(rows, SCHEMA)).collect()) == manifest(rows)


def test_manifest_of_many_languages_and_repeats(spark):
    """More languages than a run has, and one row so often that whole runs are equal and share a record."""
    rows = [(k, f"T {k}", f"l{k % 70:02d}", "s", k) for k in range(300)] + [(5000, "again", "l05", "s", 1)] * 200
    made = merkle.build(spark.createDataFrame(rows, SCHEMA))
    assert Counter(tuple(r) for r in merkle.audit(spark.createDataFrame(rows, SCHEMA)).collect()) == manifest(rows)
    records = made.records.collect()
    assert all(h(*r["children"]) == r["digest"] for r in records) and len({(r["part"], r["height"], r["digest"]) for r in records}) == len(records)
    assert len(records) < sum(-(-n // 8**k) for n in [204] + [5] * 20 + [4] * 49 for k in (1, 2, 3) if n > 8 ** (k - 1))


def test_a_few_requests_prove_themselves(spark):
    rows = [(k, f"T {k}", f"l{k % 3}", "s", k) for k in range(700)]
    made = merkle.build(spark.createDataFrame(rows, SCHEMA))
    asked = made.leaves.where("doc_id in (0, 1, 350, 699)")
    got = merkle.prove(made, asked).select("doc_id", "root", "leaf", "proof", merkle.folded(F.col("leaf"), F.col("proof")).alias("up")).collect()
    assert sorted(r["doc_id"] for r in got) == [0, 1, 350, 699] and all(r["up"] == r["root"] for r in got)
    assert all(len(r["proof"]) == 4 for r in got)  # three levels in the language and one above it


def test_manifest_and_audit_of_an_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.audit(none).collect() == [] and merkle.build(none).top.collect() == []
    assert simhash.link_components(none).collect() == []
    assert divergence.audit(none).collect() == []


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words)] if 0 < len(words) < 3 else [" ".join(words[k : k + 3]) for k in range(len(words) - 2)]
    values = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def grouped(prints, radius=2):
    """The smallest id that each id reaches; prints: id, value."""
    ids = sorted(prints)
    up = {k: k for k in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    values = np.array([prints[k] for k in ids], np.uint64)
    for at, k in enumerate(ids):
        for other in np.flatnonzero(np.bitwise_count(values[at + 1 :] ^ values[at]) <= radius):
            a, b = sorted((find(k), find(ids[at + 1 + other])))
            up[b] = a
    return {k: find(k) for k in ids}


def test_simhash_query_equals_brute_force(spark, sf_dir):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op12_simhash(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {r["doc_id"]: fingerprint(r["text"]) for r in rows}
    reach = grouped(prints)
    assert got == {k: (f"{v:016x}", reach[k]) for k, v in prints.items()} and len(set(reach.values())) < len(reach)


def test_simhash_of_odd_rows(odd):
    got = Counter(tuple(r) for r in simhash.link_components(odd).collect())
    prints = [fingerprint(r[1]) for r in ODD]
    reach = grouped(dict(enumerate(prints)))
    least = defaultdict(list)
    for k, r in enumerate(ODD):
        least[reach[k]] += [r[0]] if r[0] is not None else []
    assert got == Counter((r[0], f"{prints[k]:016x}", min(least[reach[k]], default=None)) for k, r in enumerate(ODD))


def test_covering_masks_meet_every_near_pair():
    rng = random.Random(2)
    for open_bits in ((1 << 64) - 1, (1 << 27) - 1 << 20, 0b1011):
        masks = simhash.covering(open_bits)
        places = [k for k in range(64) if open_bits >> k & 1]
        pairs = list(itertools.combinations(places, 2)) if len(places) < 30 else [rng.sample(places, 2) for _ in range(2000)]
        assert all(any(not m & (1 << a | 1 << b) for m in masks) for a, b in pairs)
        assert all(m & ~open_bits == 0 for m in masks)


@pytest.mark.parametrize("most", [32, 64])
def test_near_links_through_buckets_of_any_size(spark, most):
    rng = random.Random(most)
    centre = rng.getrandbits(64)
    values = {centre} | {centre ^ 1 << a ^ 1 << b for a, b in (rng.sample(range(64), 2) for _ in range(300))} | {rng.getrandbits(64) for _ in range(100)} | {(centre ^ k) for k in range(256)}
    rows = sorted(simhash._signed(v) for v in values)
    got = {(r["a"], r["b"]) for r in simhash.near_links(spark.createDataFrame([(v,) for v in rows], "fingerprint long"), most=most).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(rows, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}


def audited(rows):
    """Expected rows of the divergence audit, by plain counting over all kept terms."""
    counts, docs, total, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        own = Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER)))
        groups[lang].add(source)
        counts[lang, source].update(own)
        total[lang].update(own)
        docs[lang].update(own.keys())
    out = set()
    f = lambda p, q: (p - q) * (p - q) // q
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= 3)
        share = lambda c: [1 + 1_000_000_000 * (c[t] + 1) // (sum(c[t] for t in kept) + len(kept)) for t in kept]  # noqa: B023, E731
        whole, each = share(total[lang]), {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            far = sorted((-sum(map(f, each[s], each[o])), o.encode()) for o in sources if o != s)
            own = sorted((-f(p, q), t.encode()) for t, p, q in zip(kept, each[s], whole, strict=True) if counts[lang, s][t] and p > q)[:200]
            out |= {(lang, s, part, x.decode(), -v, k + 1) for part, found in (("pair", far), ("term", own)) for k, (v, x) in enumerate(found)}
    return out


def test_divergence_of_odd_rows(odd):
    assert {tuple(r) for r in divergence.audit(odd).collect()} == audited(ODD)


@pytest.mark.parametrize("flush", [7, 1 << 20])
def test_divergence_of_terms_of_all_lengths(spark, monkeypatch, flush):
    """Terms of 1 to 70 bytes, some that differ in the last byte only; groups with nothing in common, with one term, with none."""
    monkeypatch.setattr(divergence, "FLUSH", flush)
    rng = random.Random(4)
    terms = ["é" * k for k in range(1, 36)] + [("ab" * 40)[:k] for k in range(1, 71)] + [("ab" * 40)[:k] + "z" for k in range(6, 19)]
    rows = [(k, " 1".join(rng.choice(terms).title() for _ in range(rng.randint(0, 60))), f"l{k % 2}", f"s{k % 9}" if k % 13 else None, 1) for k in range(120)]
    rows += [(500 + k, "only", "l2", f"s{k}", 1) for k in range(2)] + [(600 + k, "...", "l3", f"s{k}", 1) for k in range(3)] + [(700 + k, "here there", "l4", "alone", 1) for k in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    own = divergence.Counter()
    parts = [p for batch in docs.select("text", "lang", "source").toArrow().to_batches() for p in own.add(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist())] + list(own.close())
    assert sum(p.column(3).to_pylist().count(0) for p in parts) == len({(r[2], r[3] or "") for r in rows})
    assert {tuple(r) for r in divergence.audit(docs).collect()} == audited(rows)


def test_radix_order_is_stable_and_right():
    rng = np.random.default_rng(3)
    high, low = rng.integers(0, 5, 10_000).astype(np.uint32), rng.integers(0, 1 << 63, 10_000).astype(np.uint64) >> rng.integers(0, 60, 10_000).astype(np.uint64)
    assert (divergence.radix_order([high, low]) == np.lexsort((low, high))).all()
