"""Embedding near-duplicates against brute force."""

import numpy as np
import pytest

from tallywright.llm import itq_dedup


@pytest.mark.parametrize("shift", [0.0, 1.5])  # vectors around zero, and in a narrow cone
def test_recall(spark, shift):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1500, 32)) + shift
    near = base[:500] + 0.19 * rng.standard_normal((500, 32)) * np.linalg.norm(base[:500], axis=1, keepdims=True) / np.sqrt(32)
    x = np.concatenate([base, near]).astype(np.float32)
    label = np.arange(len(x)) % 500 % 3
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in itq_dedup.near_duplicates(df).collect()}
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = (unit @ unit.T >= itq_dedup.LEAST) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    have = np.array([got[i] for i in range(len(x))])
    assert linked.sum() > 300 and (have <= linked.sum(1)).all()
    assert have.sum() >= 0.98 * linked.sum()


def test_short_vectors(spark):
    rows = [(1, [2.0], 1), (2, [3.0], 1), (3, [-1.0], 1), (4, [1.0, 0.0], 1), (5, [2.0, 0.1], 1), (6, [0.0, 1.0], 1), (6, [0.0, 1.0], 1)]
    got = [tuple(r) for r in itq_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()]
    assert sorted(got) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (6, 1, 6, True)]
