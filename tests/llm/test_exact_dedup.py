"""Exact dedup: the cuckoo filter, the shards, the index, and the query against plain grouping."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakelog.llm.exact_dedup import CuckooFilter, ExactIndex, Shard, content_records, exact_duplicates
from wakelog.llm.queries import op11_exact_dedup

from .conftest import EDGES, row


def brute(rows):
    """(doc_id, keep_id, group_size, kept, sha256) of (doc_id, text) rows by plain comparison of normalised texts."""
    groups = defaultdict(list)
    flat = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    for (i, _), t in zip(rows, flat, strict=True):
        groups[t].append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[t], len(groups[t]), i == keep[t], hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, flat, strict=True)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_filter_keeps_what_it_took_until_removed():
    digests = np.random.default_rng(1).integers(0, 2**64, 3000, np.uint64)
    f = CuckooFilter(1024)
    assert f.add(digests)
    assert f.has(digests).all()
    assert f.has(np.random.default_rng(2).integers(0, 2**64, 20_000, np.uint64)).mean() < 0.01
    again = CuckooFilter(slots=f.tobytes())
    f.remove(digests[:1000])
    assert f.has(digests[1000:]).all() and f.has(digests[:1000]).mean() < 0.01
    assert again.has(digests).all()


def test_filter_tells_when_it_is_full():
    digests = np.random.default_rng(3).integers(0, 2**64, 200, np.uint64)
    assert not CuckooFilter(16).add(digests)


def test_shard_grows_from_its_stored_keys():
    contents = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    shard = Shard()
    for at in range(0, 5000, 700):
        part = contents[at : at + 700]
        shard.insert(part, list(range(at, at + len(part))), [1] * len(part))
    assert len(shard.filter.slots) >= 2048
    assert shard.filter.has(np.array(shard.digests, np.uint64)).all()
    assert sorted(shard.rows(), key=lambda r: r[1]) == [(c, i, 1) for i, c in enumerate(contents)]


def test_hits_are_verified_by_content():
    same = b"12345678"
    shard = Shard()
    shard.insert([same + b"a", same + b"b", same + b"a"], [5, 3, None], [1, 1, 2])
    shard.insert([same + b"c", same + b"b"], [1, 9], [1, 1])
    assert sorted(shard.rows()) == [(same + b"a", 5, 3), (same + b"b", 3, 2), (same + b"c", 1, 1)]
    shard.delete([same + b"b", same + b"x"])
    assert sorted(r[0] for r in shard.rows()) == [same + b"a", same + b"c"]
    shard.insert([same + b"b"], [7], [1])
    assert (same + b"b", 7, 1) in list(shard.rows())


def test_deleted_digests_are_new_again(spark, documents):
    docs = documents([row(1, "a  b"), row(2, "a b"), row(3, "c"), row(4, "d")])
    index = ExactIndex(spark, "bigint", 3)
    index.insert(content_records(docs))
    index.delete(content_records(docs.where("doc_id in (2, 4)")))
    left = {r["keep_id"]: r["group_size"] for r in index.records().collect()}
    assert left == {3: 1}
    index.insert(content_records(docs.where("doc_id >= 2")))
    assert {r["keep_id"]: r["group_size"] for r in index.records().collect()} == {2: 1, 3: 2, 4: 1}


def test_edges_and_copies(documents):
    rows = [*EDGES, row(20, "one two  three four five six\tseven"), row(21, " one two three four five six seven"), row(22, "\n\none two three four five six seven"), row(23, None)]
    rows += [row(100 + i, f"copy number {i % 7}" if i % 3 else "the same  text") for i in range(300)]
    docs = documents(rows)
    assert found(exact_duplicates(docs)) == brute([(r[0], r[1]) for r in rows])
    assert found(exact_duplicates(docs, batches=1)) == brute([(r[0], r[1]) for r in rows])


def test_empty_table_other_columns_and_ids(spark, documents):
    assert exact_duplicates(documents([])).collect() == []
    clash = documents([row(1, "x"), row(2, "x")]).select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(1).alias("keep_id"), F.lit(2).alias("content"), F.lit(3).alias("doc"))
    assert found(exact_duplicates(clash)) == [(i, "1", 2, i == "1", hashlib.sha256(b"x").hexdigest()) for i in ("1", "2")]


@pytest.mark.parametrize("copies", [1, 400])
def test_query_against_grouping(spark, documents, tmp_path, copies):
    rows = [row(i, "hot  text" if i % 2 else f"text {i % 50}") for i in range(copies)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert found(op11_exact_dedup(spark, str(tmp_path))) == brute([(r[0], r[1]) for r in rows])
