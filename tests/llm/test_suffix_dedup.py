"""Repeats against brute force, suffix arrays against sorting, and edge cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
from tests.llm.conftest import EDGES, LONG, SCHEMA

from wakelog.llm import suffix_dedup as sd


def test_suffix_array():
    rnd = random.Random(1)
    for _ in range(300):
        s = [rnd.randint(1, rnd.choice([2, 3, 200])) for _ in range(rnd.randint(0, 60))] + [0]
        sa = sd.suffix_array(s, 200)
        assert sa == sorted(range(len(s)), key=lambda i: s[i:])
        plcp = sd.permuted_prefixes(s, sa, 100, 0)
        for a, b in zip(sa, sa[1:], strict=False):
            k = 0
            while max(a, b) + k < len(s) and s[a + k] == s[b + k]:
                k += 1
            assert plcp[b] == k


def test_anchors_in_every_window():
    rnd = np.random.default_rng(1)
    for raw in (rnd.integers(97, 101, 400).astype(np.uint8), np.full(200, 65, np.uint8)):
        at = sd.anchors(raw)
        for s in range(len(raw) - sd.WIDTH + 1):
            assert ((at >= s) & (at <= s + sd.WIDTH - sd.ANCHOR)).any()


def brute(rows):
    order = {r[0]: 2**63 - 1 if r[0] is None else r[0] for r in rows}
    least = {}
    for r in rows:
        b = (r[1] or "").encode()
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            least[w] = min(least.get(w, 2**63 - 1), order[r[0]])
    out = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < order[r[0]]:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((r[0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def texts(n):
    rnd = random.Random(3)
    bits = ["the ", "of ", "é", "ing ", "x", "\n", "aaaa", "Orre ", "and ", "zz "]
    shared = ["".join(rnd.choices(bits, k=rnd.randint(10, 60))) for _ in range(8)]
    out = []
    for _ in range(n):
        parts = ["".join(rnd.choices(bits, k=rnd.randint(0, 80))) for _ in range(3)]
        for _ in range(rnd.randint(0, 3)):
            s = rnd.choice(shared)
            a = rnd.randint(0, len(s))
            parts.insert(rnd.randint(0, 3), s[a:] if rnd.random() < 0.3 else s)
        out.append("".join(parts))
    return out


def test_repeats(documents, spark, monkeypatch):
    rows = [(100 + i, t) for i, t in enumerate(texts(150))]
    rows += [(90, rows[20][1]), (500, "Orre " * 100), (501, "Orre " * 90), (502, "a" * 49), (503, "a" * 49), (504, "a" * 50), (505, "a" * 51), *[e[:2] for e in EDGES]]
    # A long text that another has in part, and one passage with as many contexts as documents that hold it.
    rnd = random.Random(8)
    own = lambda k: "".join(rnd.choices("bcdfghjklm ", k=k))
    rows += [(9, LONG[40_000:90_000] + own(50)), *[(2000 + i, own(40) + "a passage that stands in very many documents, each in its place" + own(40)) for i in range(300)]]
    for shard in (sd.SHARD, 300):
        monkeypatch.setattr(sd, "SHARD", shard)
        got = sd.remove_repeats(documents(rows)).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute(rows)
        assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert len(sd.remove_repeats(documents(EDGES)).collect()) == len(EDGES)
    assert not sd.remove_repeats(spark.createDataFrame([], SCHEMA)).collect()


def test_repeats_inside_one_document(documents, monkeypatch):
    rnd = random.Random(11)
    own = lambda k: "".join(rnd.choices("bcdfghjklm", k=k))
    p, q = own(70), own(70)
    b, c = own(40) + p + own(40), own(40) + q + own(40)
    # Twice in one document, which a smaller one has in part; in two texts of one id; in rows without an id; many times.
    rows = [(1, p), (2, b + "\n" + b), (3, q), (4, c + "\n" + own(30)), (4, own(30) + "\n" + c), (None, own(20) + b[20:]), (None, b[20:] + own(20)), (None, b[20:] + own(20) + b[20:])]
    rows += [(7, own(60) + p[:60] + own(60)), (8, "\n".join([own(60) + q[5:65] + own(60)] * 30))]
    for shard in (sd.SHARD, 300):
        monkeypatch.setattr(sd, "SHARD", shard)
        got = sd.remove_repeats(documents(rows)).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute(rows)
    assert next(r["n_removed"] for r in got if r["doc_id"] == 2) == 140


def test_equal_windows_have_equal_anchors():
    rnd = random.Random(2)
    for _ in range(50):
        p = "".join(rnd.choices("ab ", k=rnd.randint(50, 90)))
        found = []
        for _ in range(2):
            front = "".join(rnd.choices("ab ", k=rnd.randint(0, 70)))
            raw = np.frombuffer((front + p + "".join(rnd.choices("ab ", k=30))).encode(), np.uint8)
            found.append({int(i) - len(front) for i in sd.anchors(raw)})
        for s in range(len(p) - sd.WIDTH + 1):
            inside = [{i for i in f if s <= i <= s + sd.REACH} for f in found]
            assert inside[0] & inside[1]


def test_batches_of_any_size(monkeypatch):
    """Where batches and shards are cut does not matter."""
    rows = [(100 + i % 140, i, t) for i, t in enumerate(texts(200))]
    docs = pd.DataFrame(rows, columns=["doc", "own", "text"])
    plain = lambda frames: sorted(map(tuple, pd.concat(frames).to_numpy().tolist()))
    cut = lambda df, n: [df.iloc[i : i + n] for i in range(0, len(df), n)]
    found = pd.concat(sd._anchored(iter(cut(docs, 40)))).sort_values(["h", "c", "doc"], kind="stable")
    states = pd.concat(sd._repeated(iter([found])))
    assert set(states["state"]) == {sd.DONE, sd.FIRST, sd.FURTHER}
    groups = states[states["state"] == sd.FIRST].groupby(["doc", "own"])
    first = pd.DataFrame([(*key, *(g[x].to_numpy() for x in ("h", "c", "place"))) for key, g in groups], columns=["doc", "own", "h", "c", "place"])
    contexts = pd.concat(sd._contexts(iter([first.merge(docs, on=["doc", "own"])]))).sort_values("h", kind="stable")
    windows = plain(sd._sharded(iter([contexts])))
    assert windows
    for n in (1, 3, 50):
        assert plain(sd._repeated(iter(cut(found, n)))) == plain([states])
        for shard in (300, sd.SHARD):
            monkeypatch.setattr(sd, "SHARD", shard)
            assert plain(sd._sharded(iter(cut(contexts, n)))) == windows
