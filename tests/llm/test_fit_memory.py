"""The classifier's fit is made in the driver, beside its JVM: what it holds must stay near the features themselves."""

import tracemalloc

import numpy as np

from wakelog.llm import quality


def _rows(n, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        p = np.unique(rng.integers(0, 20_000, rng.integers(0, 900)))
        rows.append((p.astype(np.int32), rng.random(len(p)).astype(np.float32)))
    return rows, rng.integers(0, 3, n)


def test_fit_holds_little_beside_its_rows(monkeypatch):
    """Pipeline, mix sources: the fit took 68 bytes a feature beside its rows before."""
    rows, grades = _rows(4000)
    monkeypatch.setattr(quality, "TOGETHER", 1 << 15, raising=False)
    tracemalloc.start()
    quality.fit_ordinal(rows, grades, 3, rounds=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * sum(len(p) for p, _ in rows)


def test_blocks_do_not_change_the_fit(monkeypatch):
    rows, grades = _rows(300, 2)
    rows[7] = (np.arange(5000, dtype=np.int32), np.ones(5000, np.float32))
    whole = quality.fit_ordinal(rows, grades, 3, rounds=40)
    monkeypatch.setattr(quality, "TOGETHER", 1000, raising=False)
    cut = quality.fit_ordinal(rows, grades, 3, rounds=40)
    assert (whole.places == cut.places).all() and np.allclose(whole.weights, cut.weights, atol=1e-9) and np.allclose(whole.thresholds, cut.thresholds, atol=1e-9)
