"""The ordinal classifier on planted grades, and its edge cases."""

import random

import numpy as np
import pytest
from tests.llm.conftest import EDGES, SCHEMA

from wakelog.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def planted(n, seed):
    rnd = random.Random(seed)
    words = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(n):
        body = rnd.choices(words, k=rnd.randint(20, 200))
        grade = rnd.choice([0, 1, 2, 2, 2])
        if grade == 0:
            body = [w.upper() + "!!" for w in body]
        elif grade == 1:
            body[3] = body[-2] = rnd.choice(["awful", "nasty"])
        rows.append((i, " ".join(body)))
        labels.append((i, int(grade > 0), int(grade == 1)))
    return rows, labels


def test_held_out(documents, spark):
    rows, labels = planted(900, 1)
    train = spark.createDataFrame([x for x in labels if x[0] < 600], LABELS)
    got = {r["doc_id"]: r for r in quality.rate_documents(documents(rows), train).collect()}
    assert len(got) == 900
    want = {i: q + q * (1 - t) for i, q, t in labels}
    tails = [(got[i]["p_above_0"] > 0.5) + (got[i]["p_above_1"] > 0.5) == want[i] for i in range(600, 900)]
    assert np.mean(tails) > 0.95
    for r in got.values():
        assert r["p_above_0"] >= r["p_above_1"] and r["expected_grade"] == pytest.approx(r["p_above_0"] + r["p_above_1"]) and r["keep"] == (r["p_above_1"] >= 0.5)


def test_edges(documents, spark):
    labels = spark.createDataFrame([(6, 1, 0), (6, 0, 0), (None, 1, 1), (1, None, 0), (99, 1, 0)], LABELS)
    rated = quality.rate_documents(documents(EDGES), labels)
    got = rated.collect()
    assert len(got) == len(EDGES)
    assert len({r["expected_grade"] for r in got if r["doc_id"] in (6, 7)}) == 1
    assert len({r["expected_grade"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    none = spark.createDataFrame([], LABELS)
    assert len(quality.rate_documents(documents(EDGES), none).collect()) == len(EDGES)
    assert not quality.rate_documents(spark.createDataFrame([], SCHEMA), none).collect()
    with pytest.raises(ValueError):
        quality.score_quality(rated, quality.fit_ordinal([], np.zeros(0, int), 3))


def test_thresholds_ascend():
    rnd = np.random.default_rng(1)
    rows = [(np.sort(rnd.choice(50, 5, replace=False)).astype(np.int64), np.ones(5)) for _ in range(200)]
    m = quality.fit_ordinal(rows, rnd.integers(0, 5, 200), 5, rounds=50)
    assert (np.diff(m.thresholds) > 0).all()


def test_nothing_fitted(documents, spark):
    for labels in ([], [(99, 1, 0)], [(1, None, 0)]):
        rated = quality.rate_documents(documents(EDGES), spark.createDataFrame(labels, LABELS)).collect()
        assert len(rated) == len(EDGES) and all(r["keep"] for r in rated)


def test_bounds_of_the_sample(documents, spark):
    """Within both bounds the sample is the same in every run, repeats count once, and one long text does not pass the second."""
    rows, labels = planted(200, 3)
    table, marks = documents([*rows, *rows[:50], (0, rows[1][1])]), spark.createDataFrame(labels, LABELS)
    fit = lambda **k: quality.fit_quality(table, marks, quality.graded(), 3, **k)
    a, b = fit(fit_rows=80), fit(fit_rows=80)
    assert (a.weights == b.weights).all() and (a.places == b.places).all() and a.fitted
    assert fit(fit_bytes=100_000).fitted
    with pytest.raises(ValueError, match="fit_bytes=10 "):
        fit(fit_bytes=10)
    with pytest.raises(ValueError):
        quality.rate_documents(table.withColumn("keep", table["doc_id"]), marks)


def test_fit_against_plain_descent():
    """The fitted model's loss is as low as that of plain gradient descent on the same cumulative-link likelihood."""
    rnd = np.random.default_rng(4)
    true = rnd.normal(size=12)
    x = rnd.integers(0, 2, (600, 12)).astype(float)
    grades = np.digitize(x @ true + rnd.logistic(size=600), [-0.7, 0.9])
    rows = [(np.flatnonzero(r).astype(np.int64), np.ones(int(r.sum()))) for r in x]
    m = quality.fit_ordinal(rows, grades, 3, lasso=0.0)
    weight = 1 / np.sqrt(np.bincount(grades, minlength=3))[grades]
    above = grades[:, None] > np.arange(2)[None, :]

    def loss(w, t):
        p = 1 / (1 + np.exp(-(x @ w)[:, None] + t[None, :]))
        return float(-(weight[:, None] * np.where(above, np.log(p), np.log1p(-p))).sum() / weight.sum())

    w, t = np.zeros(12), np.array([-0.5, 0.5])
    for _ in range(4000):
        p = 1 / (1 + np.exp(-(x @ w)[:, None] + t[None, :]))
        e = (p - above) * weight[:, None] / weight.sum()
        w, t = w - 0.5 * x.T @ e.sum(1), t + 0.5 * e.sum(0)
    full = np.zeros(12)
    full[m.places] = m.weights
    assert loss(full, m.thresholds) < loss(w, t) + 0.01
    assert np.corrcoef(full, w)[0, 1] > 0.99
