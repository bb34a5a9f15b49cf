"""Odd tables: clashing names, other id types, nulls and repeats in labels, weights in short benchmark items, the pipeline on odd and empty tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from curatrix.llm import decontaminate, jaccard, packing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, letters="etaoinshrdlu"):
    return [("".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))) for _ in range(n)]


def test_columns_of_any_name_stay(spark):
    rng = random.Random(3)
    text = " ".join(words(rng, 60))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "other words here"), (None, None)], "doc_id long, text string").withColumns({"_gone": F.lit(1), "_bad": F.lit(2), "component_id": F.lit(3), "nid": F.lit(4)})
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 3, None}
    bench = spark.createDataFrame([(7, text)], "item_id long, text string").withColumn("_bad", F.lit(0))
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {3, None}


def test_ids_of_another_type(spark):
    rng = random.Random(5)
    text = " ".join(words(rng, 60))
    docs = spark.createDataFrame([("b", text), ("a", text + " more"), ("c", "x"), (None, text)], "doc_id string, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link_components(docs).collect()}
    assert got == {"b": "a", "a": "a", "c": "c", None: None}


def weighted(docs, items):
    """The best similarity of each document and item, by all windows and shingle counts."""
    best = {}
    for d, w in docs.items():
        for i, x in items.items():
            k = min(5, len(x))
            mine = Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
            for s in range(max(1, len(w) - len(x) + 1)):
                part = w[s : s + len(x)]
                own = Counter(tuple(part[j : j + k]) for j in range(len(part) - k + 1))
                both, all_of = sum((mine & own).values()), sum(own.values()) + sum(mine.values())
                if both:
                    own_size = max(1, len(x) - k + 1)  # of a window of the item's size
                    best[d, i] = max(best.get((d, i), 0), both / (sum(own.values()) + own_size - both))
    return best


def test_weighted_shingles_of_short_and_repetitive_items(spark):
    rng = random.Random(11)
    vocabulary = words(rng, 6)
    items = {k: [rng.choice(vocabulary) for _ in range(n)] for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 9, 12, 12, 15, 20, 20, 30])}
    items[20] = [vocabulary[0]] * 18
    docs = {}
    for d in range(150):
        x = list(items[rng.choice(list(items))])
        for _ in range(rng.randint(0, 2)):
            x[rng.randrange(len(x))] = rng.choice(vocabulary)
        docs[d] = [rng.choice(vocabulary) for _ in range(rng.randint(0, 20))] + x + [rng.choice(vocabulary) for _ in range(rng.randint(0, 20))]
    docs[900] = items[11][:10]  # shorter than the item
    want = {p: s for p, s in weighted(docs, items).items() if s >= 0.75}
    frame = lambda rows, name: spark.createDataFrame([(k, " ".join(w)) for k, w in rows.items()], f"{name} long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.matches(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert set(got) == set(want) and all(got[p] == pytest.approx(want[p]) for p in want) and len(want) > 100


def test_labels_with_nulls_and_repeats(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, " ".join(words(rng, 30, "abc" if k % 2 else "xyz"))) for k in range(200)], "doc_id long, text string")
    rows = [(k, k % 2) for k in range(200)] + [(k, k % 2) for k in range(0, 200, 3)] + [(k, None) for k in range(0, 200, 5)] + [(None, 1), (999, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    got = {r["doc_id"]: r["predicted"] for r in quality.score(docs, labels).collect()}
    assert len(got) == 200 and sum(got[k] == k % 2 for k in got) >= 190


@pytest.mark.parametrize("rows", [True, False])
def test_pipeline_on_odd_and_empty_tables(spark, tmp_path, rows):
    rng = random.Random(9)
    text, item = " ".join(words(rng, 80)), " ".join(words(rng, 25))
    table = [(1, text, "aa", "s", None), (2, text, "aa", "s", 5), (2, text, "aa", "s", 5), (3, None, None, None, None), (4, "", "aa", "s", 0), (5, "12 34", "aa", "s", 5), (6, f"{' '.join(words(rng, 9))} {item} x", "aa", "s", 9), (7, " ".join(words(rng, 30_000)), "aa", "s", 1), (None, "no id but words", "aa", "s", 3), (8, f"mail me at jo@mail.org {' '.join(words(rng, 9))}", None, "s", 1)]
    docs = spark.createDataFrame(table if rows else [], SCHEMA)
    docs.withColumns({"_bad": F.lit(1), "piece": F.lit("p"), "_key": F.lit(2.5)}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == ({1, 7, 8, None} if rows else set())
    assert all(r["length"] <= packing.SEQUENCE for r in got)
