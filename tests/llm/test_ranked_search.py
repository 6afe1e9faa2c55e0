"""Ranked search against scores by plain counting."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from wakelog.llm.queries import op12_ranked_search
from wakelog.llm.ranked_search import search, terms

from .conftest import EDGES, row

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    """Every document scored for every item."""
    bags = [(i, Counter(words(t))) for i, t in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out, wanted = [], {}
    for i, t in items:
        wanted.setdefault(i, set()).update(words(t))
    for item, ts in wanted.items():
        scored = []
        for i, b in bags:
            m = 50 + (50 * sum(b.values()) * n_docs) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in ts if b[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_terms_as_the_pattern_has_them():
    text = "Über-Maß, 3D_x’s ÄÖ a\u0085b 😀C\x7fD [E]"
    assert [t.decode() for t in terms(text.encode())] == words(text)


def tables(spark, documents, seed, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Der", "DER", "été"]
    text = lambda: " ".join(rng.choice(vocabulary[: rng.choice((3, 20, 43))]) for _ in range(rng.randrange(0, 30)))
    pool = [text() for _ in range(60)]
    docs = [row(i, rng.choice(pool) if i % 2 else text()) for i in range(n)]
    items = [(i, text()) for i in range(12)] + [(90, None), (91, "!!"), (3, "extra w1")]
    return docs, items, documents(docs), spark.createDataFrame(items, "item_id long, text string")


def test_against_all_scores(spark, documents):
    for seed, k in ((1, 50), (2, 3)):
        docs, items, d, i = tables(spark, documents, seed)
        assert found(search(d, i, k)) == brute([(r[0], r[1]) for r in docs], items, k)


def test_blocks_give_the_same(spark, documents):
    docs, items, d, i = tables(spark, documents, 3, 80)
    assert found(search(d, i, 5, block_pairs=40)) == brute([(r[0], r[1]) for r in docs], items, 5)


def test_edges(spark, documents):
    items = [(1, "one seven word"), (2, "élan 😀"), (None, "no text at all")]
    i = spark.createDataFrame(items, "item_id long, text string")
    d = documents(EDGES)
    assert found(search(d, i)) == brute([(r[0], r[1]) for r in EDGES], items, 50)
    clash = d.withColumns({"h": F.lit(1), "vector": F.lit("x"), "class": F.lit(2), "item_id": F.lit(3)})
    assert found(search(clash, i)) == found(search(d, i))
    assert search(documents([]), i).collect() == []
    assert search(d, i.limit(0)).collect() == []


def test_hot_class_goes_by_id(spark, documents, tmp_path):
    docs = [row(i, "same words here" if i % 3 else f"same other{i}") for i in range(400, 0, -1)]
    items = [(7, "same words"), (8, "other9 here")]
    documents(docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert found(op12_ranked_search(spark, str(tmp_path))) == brute([(r[0], r[1]) for r in docs], items, 50)
