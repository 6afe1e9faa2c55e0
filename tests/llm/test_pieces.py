"""Viterbi over the trie against a plain one, exact round trips, and edge cases."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import EDGES, SCHEMA

from wakelog.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.read(PATH)


def brute(v, text):
    """Plain dynamic programme over the whole text; literal markers are unknown characters."""
    score = {p: (s, i) for i, (p, s, ok) in enumerate(zip(v.pieces, v.scores, v.usable, strict=True)) if ok}
    byte = {int(p[3:5], 16): i for i, p in enumerate(v.pieces) if p.startswith("<0x") and len(p) == 6}
    if not text:
        return []
    t = (" " + text).replace("▁", "\0").replace(" ", "▁")
    unk, best = min(v.scores) - 10, [(0.0, None, None)] + [(float("-inf"), None, None)] * len(t)
    for i in range(len(t)):
        for j in range(i + 1, min(len(t), i + 16) + 1):
            if (got := score.get(t[i:j])) and best[i][0] + got[0] > best[j][0]:
                best[j] = (best[i][0] + got[0], i, [got[1]])
        if t[i] not in score and best[i][0] + unk > best[i + 1][0]:
            best[i + 1] = (best[i][0] + unk, i, [byte[b] for b in t[i].replace("\0", "▁").encode()])
    out, at = [], len(t)
    while at:
        out = best[at][2] + out
        at = best[at][1]
    return out


def some(n):
    rnd = random.Random(4)
    bits = ["the", "ing", " ", "  ", "x", "é", "ß", "▁", "\n", "\t", "😀", "日本", "=====", "123", "Über", " characteristics", "\x00", "퟿"]
    return ["".join(rnd.choices(bits, k=rnd.randint(0, 40))) for _ in range(n)]


def total(v, ids):
    return sum(v.scores[i] if v.usable[i] else 0 for i in ids)


def test_best_paths(vocabulary):
    encoder, decoder = pieces.Encoder(vocabulary), pieces.Decoder(vocabulary)
    texts = [*some(300), "", " ", "   a", "a   "]
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        want = brute(vocabulary, t)
        assert ids == want or total(vocabulary, ids) == total(vocabulary, want), t
        assert decoder.decode(ids) == t


def test_trie(vocabulary):
    trie = pieces.Encoder(vocabulary).trie
    for i in range(259, 32_000, 97):
        s, ok = 0, True
        for c in vocabulary.pieces[i].encode():
            to = trie.base[s] + c + 1
            ok &= trie.check[to] == s
            s = to
        assert ok and trie.value[s] == i


def test_small_parts(documents, spark, vocabulary, monkeypatch):
    """The same ids, however texts and chunks are cut and whatever is remembered."""
    texts = [*some(120), "", "a" * 400, "word " * 300]
    want = pieces.Encoder(vocabulary).encode(texts)
    monkeypatch.setattr(pieces, "TOGETHER", 50)
    monkeypatch.setattr(pieces, "REMEMBERED", 5_000)
    encoder = pieces.Encoder(vocabulary)
    assert [encoder.encode([t])[0] for t in texts] == want
    assert encoder.held < 5_000 + 200 * 1_700
    batch = pa.RecordBatch.from_pydict({"text": [*texts, None]})
    for size in (1, 100, 10**9):
        monkeypatch.setattr(pieces, "BATCH", size)
        parts = list(pieces._in_parts(batch, 0))
        assert [t for _, p in parts for t in p] == [*texts, ""] and all(p.num_rows == len(t) for p, t in parts)


def test_round_trips(documents, spark, vocabulary):
    rows = [(100 + i, t) for i, t in enumerate(some(40))]
    docs = documents([*EDGES, *rows]).withColumnRenamed("lang", "decoded")
    ids = {r["doc_id"]: r["token_ids"] for r in pieces.encode_pieces(docs, vocabulary, keep=["doc_id"]).collect()}
    got = pieces.round_trips(docs, vocabulary).collect()
    assert len(got) == len(EDGES) + 40
    for r in got:
        assert r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) and r["decoded"] in ("en", None)
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
        if r["doc_id"] is not None:
            assert r["token_ids"] == ids[r["doc_id"]]
    with pytest.raises(ValueError):
        pieces.round_trips(docs.withColumn("n_tokens", F.lit(1)), vocabulary)


def test_columns(documents, spark, vocabulary):
    rows = [(100 + i, t) for i, t in enumerate(some(50))]
    got = pieces.decode_pieces(pieces.encode_pieces(documents([*EDGES, *rows]), vocabulary), vocabulary)
    found = got.collect()
    assert len(found) == len(EDGES) + 50
    for r in found:
        assert r["decoded"] == (r["text"] or "") and (len(r["token_ids"]) > 0) == bool(r["text"])
    assert not pieces.encode_pieces(spark.createDataFrame([], SCHEMA), vocabulary).collect()
    with pytest.raises(ValueError):
        pieces.encode_pieces(got, vocabulary)
