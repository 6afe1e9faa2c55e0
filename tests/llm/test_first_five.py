"""Fingerprints, media, token counts, line dedup and mixing against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import EDGES, SCHEMA

from wakelog.llm import fingerprints, line_dedup, media, mixing, token_counts
from wakelog.llm.queries import vocabulary

BLANK = " \t\n\x0b\x0c\r"


def some_texts(n, seed=1):
    rnd = random.Random(seed)
    words = ["the", "of", "alpha", "béta", "γάμμα", "x1", "zz,", "Line"]
    lines = [" ".join(rnd.choices(words, k=rnd.randint(1, 12))) for _ in range(12)]
    return [(i, "\n".join(rnd.choice([f"  {x}\t", x, x.upper()]) for x in rnd.choices(lines, k=rnd.randint(0, 8))), rnd.choice("abc")) for i in range(n)]


def by_order(rows):
    key = lambda r: (r[0] is None, -(r[0] or 0))
    return sorted(rows, key=key)


@pytest.mark.parametrize("per_range", [3, 1000])
def test_fingerprint_edits(documents, per_range):
    rows = some_texts(40)
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(documents(rows), docs_per_range=per_range).collect()}
    ordered = by_order(rows)
    assert len(got) == 40
    for a, b in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        k = len(a[1]) // 3
        edited = a[1][: len(a[1]) - k] + b[1][:k] if k else a[1]
        r = got[a[0]]
        assert (r["n_chars"], r["edited_sha256"]) == (len(a[1]), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == fingerprints.Tree(a[1]).fingerprint() and r["edited_fingerprint"] == fingerprints.Tree(edited).fingerprint()
        assert (r["near_edited"] == 1.0) == (edited == a[1]) and 0 <= r["near_next"] <= 1


def test_fingerprint_edges(documents, spark):
    rows = fingerprints.fingerprint_edits(documents(EDGES), docs_per_range=2).collect()
    assert len(rows) == len(EDGES)
    prints = defaultdict(set)
    for r in rows:
        prints[r["fingerprint"]].add(r["doc_id"])
    assert {6, 7} in prints.values() and {1, 2, None} in prints.values()
    assert not fingerprints.fingerprint_edits(spark.createDataFrame([], SCHEMA)).collect()
    assert [r["near_next"] for r in fingerprints.fingerprint_edits(documents([(1, "only one")])).collect()] == [1.0]


def test_tree_locates_edits():
    words = [f"w{i}" for i in range(3000)]
    a = "\n".join(" ".join(words[i : i + 40]) for i in range(0, 3000, 40))
    b = a.replace("w1500", "EDITED")
    found = fingerprints.changed_ranges(fingerprints.Tree(a), fingerprints.Tree(b))
    at = b.encode().index(b"EDITED")
    assert any(s <= at < e for s, e in found) and sum(e - s for s, e in found) < 400
    assert fingerprints.likeness(fingerprints.Tree(a), fingerprints.Tree(b)) > 0.95
    assert fingerprints.changed_ranges(fingerprints.Tree(a), fingerprints.Tree(a)) == []


def test_likeness_by_spans():
    """Likeness is the share of bytes in common spans, counted over the spans' own bytes."""
    rnd = random.Random(3)
    some = [t for _, t, _ in some_texts(30)] + ["".join(rnd.choices("abcdef", k=2000)), "word " * 900, "x" * 3000, "ab " * 50 + "y" * 700]
    texts_ = [*some, *(t[: len(t) * 2 // 3] + "other end" for t in some)]
    trees = [fingerprints.Tree(t) for t in texts_]
    spans = [Counter(t.encode()[o : o + n] for o, n in zip(x.offsets.tolist(), x.sizes.tolist(), strict=True)) for t, x in zip(texts_, trees, strict=True)]
    for t, x in zip(texts_, trees, strict=True):
        assert int(x.sizes.sum()) == len(t.encode()) and (not t or max(x.sizes) <= fingerprints.LONGEST)
    for i in range(len(some)):
        for j in (i, i + len(some), (i + 1) % len(some)):
            both = sum(len(s) * n for s, n in (spans[i] & spans[j]).items())
            total = len(texts_[i].encode()) + len(texts_[j].encode())
            assert fingerprints.likeness(trees[i], trees[j]) == pytest.approx(1.0 if texts_[i] == texts_[j] else 2 * both / total)


def test_long_runs_are_cut():
    rnd = random.Random(4)
    for t in ("".join(rnd.choices("abcdefgh", k=6000)), "word " * 1200, "z" * 6000, "日本" * 3000):
        a, b = fingerprints.Tree(t), fingerprints.Tree(t[: len(t) * 2 // 3] + "".join(rnd.choices("mnop", k=len(t) // 3)))
        assert max(a.sizes) <= fingerprints.LONGEST and 0.55 < fingerprints.likeness(a, b) < 0.75
        assert sum(e - s for s, e in fingerprints.changed_ranges(a, b)) < 0.5 * sum(b.sizes)


def test_cosine_hash_against_plain_sums():
    rnd = np.random.default_rng(2)
    side, low = media.SIDE, media.LOW
    for _ in range(3):
        image = rnd.integers(0, 256, (side, side)).astype(np.uint8)
        c = np.zeros((low, low))
        for u in range(low):
            for v in range(low):
                c[u, v] = sum(float(image[y, x]) * np.cos(np.pi * u * (y + 0.5) / side) * np.cos(np.pi * v * (x + 0.5) / side) for y in range(side) for x in range(side))
        flat = c.ravel()
        bits = "".join("1" if x > np.median(flat[1:]) else "0" for x in flat)
        assert media.cosine_hash(image) == f"{int(bits, 2):0{len(bits) // 4}x}"


def test_merkle_nodes(documents):
    rows = fingerprints.merkle_nodes(documents(EDGES)).collect()
    roots = [r for r in rows if r["level"] == "root"]
    assert len(roots) == len(EDGES)
    spans = defaultdict(int)
    for r in rows:
        spans[r["doc_id"]] += r["n_bytes"] * (r["level"] == "span")
    assert spans[6] == len(EDGES[6][1])


def test_png_round_trip():
    rnd = np.random.default_rng(1)
    for h in (1, 2, 31, 32, 33, 200):
        for img in (rnd.integers(0, 256, (h, 64), np.uint8), np.repeat(np.arange(h, dtype=np.uint8)[:, None], 64, 1) + np.uint8(200)):
            assert (media.decode_png(media.encode_png(img)) == img).all()


def test_png_filters():
    rnd = np.random.default_rng(2)
    img = rnd.integers(0, 256, (10, 64)).astype(int)
    lines = []
    for r in range(10):
        up, left = (img[r - 1] if r else np.zeros(64, int)), np.concatenate([[0], img[r, :-1]])
        corner = np.concatenate([[0], up[:-1]])
        p = left + up - corner
        paeth = [min((a, b, c), key=lambda v: abs(q - v)) for a, b, c, q in zip(left, up, corner, p, strict=True)]
        guess = [np.zeros(64, int), left, up, (left + up) // 2, np.array(paeth)][r % 5]
        lines.append(np.concatenate([[r % 5], (img[r] - guess) % 256]))
    assert (media._unfiltered(np.array(lines, np.uint8)) == img).all()


def test_png_damage():
    data = bytearray(media.encode_png(np.zeros((3, 64), np.uint8)))
    data[45] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(data))
    with pytest.raises(ValueError):
        media.decode_png(media.encode_png(np.zeros((3, 64), np.uint8))[:-12])


def test_media_columns(documents, spark):
    got = media.read_png(media.store_as_png(documents(EDGES))).collect()
    assert len(got) == len(EDGES)
    for r in got:
        raw = (r["text"] or "").encode()
        raw += bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        x = r["read"]
        assert (x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
        assert (x["media_bytes"], x["media_sha256"]) == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
    assert len({r["read"]["feature"] for r in got if r["doc_id"] in (6, 7)}) == 1
    assert not media.read_png(media.store_as_png(spark.createDataFrame([], SCHEMA))).collect()
    with pytest.raises(ValueError):
        media.store_as_png(documents(EDGES), media="text")


def test_token_counts(documents, spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["a<|endoftext|>b <|startoftext|>", "aaaaaaaaaaaaa" * 50, "ΣΑΣ ΟΔΟΣ Σ", "it's we'll 123 ½ ²", "x\x1cy\x85z q​w", "İstanbul ﬁ é", "don'T I'M", "!!!???...", "퟿ \U0001f600‍\U0001f600"]
    rows = [(100 + i, x) for i, x in enumerate(odd)] + [(200 + i, x) for i, x, _ in some_texts(30, 3)]
    got = token_counts.count_tokens(documents([*EDGES, *rows]), vocabulary("word_bpe_49k.json")).collect()
    assert len(got) == len(EDGES) + len(rows)
    for r in got:
        n = len(t.encode(r["text"] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 2048, len((r["text"] or "").encode())), r["text"][:50]
    assert not token_counts.count_tokens(spark.createDataFrame([], SCHEMA), vocabulary("word_bpe_49k.json")).collect()


def brute_lines(rows, min_chars=20, min_docs=3):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(BLANK))
    docs = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            docs[key(x)].add(r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(docs[key(x)]) < min_docs or r[0] == max(d for d in docs[key(x)] if d is not None)]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_line_dedup(documents, spark, batches):
    rows = [*some_texts(60), *EDGES, (9, EDGES[3][1]), (10, EDGES[3][1])]
    got = line_dedup.dedup_lines(documents(rows), batches=batches)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()) == brute_lines(rows)
    assert not line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).collect()
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(got)


def test_mix_sources(documents, spark):
    rows = [*some_texts(300), *EDGES]
    got = mixing.mix_sources(documents(rows)).collect()
    again = mixing.mix_sources(documents(rows).repartition(2)).collect()
    pick = lambda rs: sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in rs)
    assert len(got) == len(rows) and pick(got) == pick(again)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] == r["copies"] * r["size"] + r["part"] and 0 <= r["part"] < max(1, r["size"])
        target[r["source"]] = r["target"]
    # The targets by the rule itself: reshare what is above until none is.
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, want = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 2 * sizes[s]
            left -= want[s]
        open_ -= over
    want |= {s: level * weight[s] for s in open_}
    for s in names:
        assert target[s] == pytest.approx(want[s]) and taken[s] == math.floor(target[s])
    assert not mixing.mix_sources(spark.createDataFrame([], SCHEMA)).collect()
    assert all(r["taken"] == 0 for r in mixing.mix_sources(documents([(1, None), (2, "")])).collect())


def test_first_words(spark):
    texts = ["one  two\tthree\n", "  béta\n\nγάμμα x", "single", "w " * 5000]
    cuts = [(t, n) for t in texts for n in (1, 2, 3, 4000)]
    got = spark.createDataFrame(cuts, "t string, n long").select("t", "n", mixing.first_words(F.col("t"), F.col("n")).alias("x")).collect()
    assert len(got) == len(cuts)
    for t, n, x in got:
        ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        assert x == (t[: ends[n - 1]] if n <= len(ends) else t)
