"""The random field: exact marginals on small graphs, what it adds on planted texts, and that it leaves clean ones alone."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import pii

LABELS = pii.OTHER + 1


def exact(unary, links):
    total = np.zeros_like(unary)
    for y in itertools.product(range(LABELS), repeat=len(unary)):
        p = np.exp(sum(unary[k, v] for k, v in enumerate(y)) + sum(t[y[i], y[j]] for i, j, t in links))
        for k, v in enumerate(y):
            total[k, v] += p
    return total / total.sum(1, keepdims=True)


@pytest.mark.parametrize("seed", range(6))
def test_marginals_of_trees_are_exact(seed):
    rng = np.random.default_rng(seed)
    n = 5
    unary = rng.normal(size=(n, LABELS))
    links = [(int(rng.integers(0, k)), k, rng.normal(size=(LABELS, LABELS))) for k in range(1, n)]
    assert np.allclose(np.exp(pii.infer(unary, links)), exact(unary, links), atol=1e-4)


@pytest.mark.parametrize("seed", range(6))
def test_marginals_of_loops_are_near(seed):
    rng = np.random.default_rng(seed)
    unary, chain, skip = rng.normal(size=(5, LABELS)), 0.4 * rng.normal(size=(LABELS, LABELS)), 2.0 * np.eye(LABELS)
    chain = (chain + chain.T) / 2
    links = [(k, k + 1, chain) for k in range(4)] + [(0, 3, skip), (1, 4, skip)]
    assert np.abs(np.exp(pii.infer(unary, links)) - exact(unary, links)).max() < 0.1


def planted(n, seed):
    """Texts, and where each holds obfuscated personal data (none in clean ones)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    words = lambda k: " ".join(word() for _ in range(k))
    out = []
    for k in range(n):
        kind = k % 4
        a, b, c = rng.randint(200, 999), rng.randint(200, 999), rng.randint(1000, 9999)
        if kind == 0:  # a number that is written plainly too
            plain, hidden = f"+1 ({a}) {b}-{c}", f"{a} {b} {c}"
            out.append((f"{words(20)} call {plain} {words(30)} or {hidden} {words(5)}", hidden))
        elif kind == 1:  # an address in words
            hidden = f"{word()} (at) {word()} (dot) org"
            out.append((f"{words(20)} {hidden} {words(20)}", hidden))
        elif kind == 2:  # fixed spans only
            out.append((f"{words(10)} {word()}@{word()}.org {words(10)} 10.0.{a % 256}.{b % 256} {words(9)}", None))
        else:  # clean, with numbers
            out.append((f"{words(20)} order {rng.randint(10**6, 10**7)} {words(5)} {rng.randint(1, 99)} {words(5)} 4{rng.randint(10**14, 10**15 - 1)}{'0'} {words(3)}", None))
    return out


def test_field_on_planted_texts(spark):
    rows = [(k, t) for k, (t, _) in enumerate(planted(400, 1))]
    model = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    caught = missed = wrong = 0
    for text, hidden in planted(400, 2):
        base, more = pii.find(text, model)
        found = {text[a:b] for _, a, b in more}
        caught += hidden in found
        missed += hidden is not None and hidden not in found
        wrong += hidden is None and any(not pii.allowed(x)[pii.OTHER - 1] and not pii.allowed(x)[2] for x in found)
    assert caught >= 0.95 * (caught + missed) and wrong == 0


def test_field_leaves_the_documents_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = pii.detect(docs)
    clean = got.where("n_email + n_ip + n_card + n_phone = 0")
    assert clean.where("n_added > 0").count() <= 0.005 * clean.count()


def test_labels_that_a_span_cannot_have():
    assert pii.allowed("4111111111111111").tolist() == [False, False, True, False, True]
    assert pii.allowed("4111111111111112").tolist() == [False, False, False, False, True]
    assert pii.allowed("10.0.0.256").tolist() == [False, False, False, False, True] and pii.allowed("10.0.0.255")[1]
    assert pii.allowed("a (at) b.org").tolist() == [True, False, False, False, True]


def test_redaction_follows_the_field(spark):
    w = np.zeros((pii.WIDTH, LABELS))
    w[0, 0] = 2  # the fitted sign of the shape of an address
    model, text = {"w": w, "chain": np.zeros((LABELS, LABELS)), "skip": 3 * np.eye(LABELS)}, "write to jane (at) example (dot) org, I said jane (at) example (dot) org"
    row = pii.redact(spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long"), model).first()
    assert row["text"] == "write to [EMAIL], I said [EMAIL]" and row["n_chars"] == len(row["text"])
    assert pii.redacted("call +1 (202) 555-0142 now", pii.base_spans("call +1 (202) 555-0142 now")) == "call [PHONE] now"


def test_long_names_are_not_cut(spark):
    text = f"{'a' * 300} (at) {'b' * 200} (dot) org"
    assert [(a, b) for a, b, _, _ in pii.nodes(text, [])] == [(0, len(text))]
    assert spark.createDataFrame([(1, text)], "doc_id long, text string").transform(lambda d: pii.detect(d)).agg(F.count("*")).first()[0] == 1
