"""Nearest examples against brute force, with more examples than a block holds and cells that are left out."""

import numpy as np
import pytest

from curatrix.operators import media


@pytest.mark.parametrize("block", [50, 4096])
def test_many_examples_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(media, "EXAMPLE_BLOCK", block)
    monkeypatch.setattr(media, "MEDIA_ROWS", 300)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    ex = unit(centres[rng.integers(0, 40, 2500)] + 0.25 * rng.normal(size=(2500, 16)))
    own = unit(centres[rng.integers(0, 40, 800)] + 0.25 * rng.normal(size=(800, 16)))
    sets = [sorted({f"c{k % 3}", f"c{k % 40 % 5}"}) for k in range(2500)]
    examples = spark.createDataFrame([(f"d{k}", v.tolist(), sets[k][::-1]) for k, v in enumerate(ex)], "digest string, embedding array<double>, categories array<string>")
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(own)] + [(9000, None), (9001, [1.0])], "id long, embedding array<double>")
    sims, names = own @ ex.T, np.array([",".join(s) for s in sets])
    want = {}
    for k in range(len(own)):
        best = sims[k].argmax()
        others = sims[k][names != names[best]]
        if sims[k][best] >= 0.9 and sims[k][best] - others.max() > 0.02:
            want[k] = (names[best], round(sims[k][best], 9))
    got = {r["id"]: (",".join(r["categories"]), round(r["similarity"], 9)) for r in media.nearest_feedback(rows, examples, 0.9, 0.02).collect()}
    assert got == want and 20 < len(want) < 800
    assert media.nearest_feedback(rows, examples.limit(0)).collect() == []
