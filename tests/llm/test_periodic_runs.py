"""Runs against the definition tried at every start and period."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakelog.llm.periodic_runs import CommonExtensions, periodic_runs, runs_of, runs_of_documents
from wakelog.llm.queries import op13_periodic_runs

from .conftest import EDGES, row


def brute(w, shortest=6, times=4):
    """(start, length, period) of all runs of a list, by trying each period."""
    found = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            smallest = next(p for p in range(1, q + 1) if all(w[x] == w[x + p] for x in range(i, i + length - p)))
            if smallest == q and length >= max(shortest, times * q):
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    drop = {x for s, length, q in runs for x in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    chosen = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *chosen, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=str)


def periodic(rng, n, alphabet):
    w = []
    while len(w) < n:
        block = [rng.randrange(alphabet) for _ in range(rng.randrange(1, 7))]
        w += block * rng.randrange(1, 8) + [rng.randrange(alphabet + 3) for _ in range(rng.randrange(0, 4))]
    return w[:n]


def test_extensions():
    w = np.array([0, 1, 0, 1, 1, 0, 1, 0, 1, 1, 2])
    e = CommonExtensions(w)
    plain = lambda i, j: next((k for k in range(len(w)) if max(i, j) + k >= len(w) or w[i + k] != w[j + k]), 0)
    pairs = [(i, j) for i in range(12) for j in range(12) if i != j]
    assert e.of(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])).tolist() == [plain(*p) for p in pairs]
    assert e.suffixes.tolist() == sorted(range(12), key=lambda i: w[i:].tolist())
    assert np.argsort(e.descending()).tolist() == sorted(range(12), key=lambda i: (-w[i:]).tolist())


@pytest.mark.parametrize("shape", [(6, 4), (2, 2), (8, 3)])
def test_runs_of_random_sequences(shape):
    rng = random.Random(sum(shape))
    for _ in range(300):
        w = periodic(rng, rng.randrange(0, 60), rng.choice((1, 2, 3, 8)))
        assert [tuple(r) for r in runs_of(np.array(w, np.int64), *shape).tolist()] == brute(w, *shape)


def test_stretches_lose_no_run():
    rng = random.Random(5)
    for _ in range(150):
        docs = [periodic(rng, rng.randrange(0, 120), rng.choice((1, 2, 5, 30))) for _ in range(6)]
        got = runs_of_documents([[b"%d" % x for x in d] for d in docs])
        assert [[tuple(r) for r in g.tolist()] for g in got] == [brute(d) for d in docs]


def test_edges_and_the_query(spark, documents, tmp_path):
    rng = random.Random(9)
    rows = [r for r in EDGES if r[0] != 4] + [row(4, "spam " * 500 + "x")]
    rows += [row(100 + i, " ".join(f"w{x}" for x in periodic(rng, 60, 4))) for i in range(60)] + [row(200 + i, " ".join(str(rng.randrange(50)) for _ in range(90))) for i in range(60)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert found(op13_periodic_runs(spark, str(tmp_path))) == sorted((expected(r[0], r[1]) for r in rows), key=str)


def test_long_text(documents):
    out = periodic_runs(documents([row(1, "word " * 60_000)])).collect()[0]
    assert (out["n_runs"], out["start"], out["length"], out["period"], out["exponent_milli"]) == (1, 0, 60_000, 1, 60_000_000)


def test_empty_and_clash(documents):
    assert periodic_runs(documents([])).collect() == []
    clash = documents([row(1, "a b")]).withColumns({"n_runs": F.lit(5), "start": F.lit("x")})
    assert periodic_runs(clash).collect()[0]["n_runs"] == 0
    with pytest.raises(ValueError, match="n_runs"):
        periodic_runs(documents([row(1, "a")]).withColumnRenamed("doc_id", "n_runs"), "n_runs")
