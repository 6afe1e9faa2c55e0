"""Near-duplicate classes against brute force over all pairs, alignment against a plain one, and edge cases."""

import random
from collections import defaultdict
from math import comb

import numpy as np
from tests.llm.conftest import EDGES, SCHEMA

from wakelog.llm import near_dedup as nd


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment():
    rnd = random.Random(1)
    for _ in range(300):
        a = np.array(rnd.choices(range(4), k=rnd.randint(0, 25)), np.uint64)
        b = np.array(rnd.choices(range(4), k=rnd.randint(0, 25)), np.uint64)
        d = plain_distance(a.tolist(), b.tolist())
        for band in (0, 2, 8, 30):
            assert nd._edit_distance(a, b, band) == min(d, band + 1)
    for _ in range(100):
        a = np.array([rnd.randrange(1000) for _ in range(120)], np.uint64)
        b = a.copy()
        for _ in range(rnd.randint(0, 12)):
            b = np.insert(np.delete(b, rnd.randrange(len(b))), rnd.randrange(len(b)), np.uint64(rnd.randrange(1000)))
        d = plain_distance(a.tolist(), b.tolist())
        assert d <= nd._anchored_cost(a, b, 10**6)
        assert (nd.edit_similarity(a, b, 0.8) > 0) == (1 - d / max(len(a), len(b)) >= 0.8)


def texts(n, seed):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(3000)}"
    shared = [word() for _ in range(60)]
    out = []
    for _ in range(n):
        kind = rnd.random()
        if out and kind < 0.5:
            w = rnd.choice(out).split()
            for _ in range(rnd.randint(0, 6)):
                at = rnd.randrange(len(w))
                w[at : at + rnd.randint(0, 1)] = [word()] * rnd.randint(0, 1)
        else:
            w = [word() for _ in range(rnd.randint(5, 150))]
            if kind > 0.8:
                w[3:3] = shared
        out.append(" ".join(w))
    return out


def brute(rows):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    words = [nd.word_hashes(t or "") for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or (len(words[i]) and len(words[j]) and nd.similar(words[i], words[j])):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted(sorted(map(str, g)) for g in groups.values())


def test_classes(documents, spark):
    rows = [(i, t) for i, t in enumerate(texts(260, 2))] + [(1000 + i, e[1]) for i, e in enumerate(EDGES)]
    got = nd.near_duplicates(documents(rows)).collect()
    groups, keepers = defaultdict(list), defaultdict(int)
    for r in got:
        groups[r["class_id"]].append(str(r["doc_id"]))
        keepers[r["class_id"]] += r["keeper"]
        assert r["class_id"] <= r["doc_id"] and (not r["keeper"] or r["class_id"] == r["doc_id"])
    assert sorted(map(sorted, groups.values())) == brute(rows)
    assert set(keepers.values()) == {1}


def test_edges(documents, spark):
    got = nd.near_duplicates(documents(EDGES)).collect()
    assert len(got) == len(EDGES) and sum(r["keeper"] for r in got) == len({e[1] or "" for e in EDGES})
    assert not nd.near_duplicates(spark.createDataFrame([], SCHEMA)).collect()


def test_large_group(documents):
    rnd = random.Random(7)
    base = [f"w{rnd.randrange(9000)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(2):
            w[rnd.randrange(120)] = f"x{rnd.randrange(9000)}"
        rows.append((i, " ".join(w)))
    got = nd.near_duplicates(documents(rows)).collect()
    want = brute(rows)
    groups = defaultdict(list)
    for r in got:
        groups[r["class_id"]].append(str(r["doc_id"]))
    assert sorted(map(sorted, groups.values())) == want


def test_repeated_lines(documents):
    """Templates: copies with one word of a line changed in some or all of its many repeats."""
    rnd = random.Random(5)
    rows = []
    for base in range(14):
        own = [f"b{base}w{rnd.randrange(9000)}" for _ in range(150)]
        line = [f"l{base}w{i}" for i in range(10)]
        n = rnd.choice([20, 40])
        for changed in (0, n, n // 2):
            other = [*line[:4], f"c{changed}", *line[5:]]
            rows.append((len(rows), " ".join([*own, *line * (n - changed), *other * changed])))
    assert len(brute(rows)) == 14
    got = defaultdict(list)
    for r in nd.near_duplicates(documents(rows)).collect():
        got[r["class_id"]].append(str(r["doc_id"]))
    assert sorted(map(sorted, got.values())) == brute(rows)


def test_bounds():
    for least in (0.3, 0.5, 0.8, 0.9, 1.0):
        bands, each, marks = nd.bounds(least)
        p = (1 - least) * 15 / 16
        assert (1 - least**each) ** bands < 5.01e-6
        assert sum(comb(128, k) * p**k * (1 - p) ** (128 - k) for k in range(marks + 1, 129)) < 5.01e-6


def set_likeness(a, b):
    """Shared five-word runs, by plain sets."""
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_links_by_both_rules(documents):
    """Each rule on its own: shingles alone would link moved parts, which the alignment keeps apart."""
    rnd = random.Random(9)
    w = [f"w{i}" for i in range(200)]
    new = [f"n{i}" for i in range(200)]
    rows = [(0, w), (1, w[100:] + w[:100]), (2, w[30:130] + w[:30] + w[130:]), (3, w[:50] + new[:3] + w[53:])]
    rows += [(10 + i, [new[k] if rnd.random() < 0.01 * i else x for k, x in enumerate(w)]) for i in range(6)]
    rows = [(i, " ".join(t)) for i, t in rows]
    likes = {i: set_likeness(rows[0][1], t) for i, t in rows}
    assert min(likes[1], likes[2], likes[3]) > 0.9
    linked = lambda x, y: set_likeness(x, y) >= 0.8 and plain_distance(x.split(), y.split()) <= 0.2 * max(len(x.split()), len(y.split()))
    groups = {i: {i} for i, _ in rows}
    for i, x in rows:
        for j, y in rows:
            if linked(x, y) and groups[i] is not groups[j]:
                groups[i] |= groups[j]
                for k in groups[i]:
                    groups[k] = groups[i]
    assert 1 not in groups[0] and 2 not in groups[0] and 3 in groups[0]
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(documents(rows)).collect()}
    assert got == {i: min(g) for i, g in groups.items()}
