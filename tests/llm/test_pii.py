"""Fixed forms against a plain search, and contexts that lead to unseen identifiers."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F
from tests.llm.conftest import EDGES, SCHEMA

from wakelog.llm import pii


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def brute(text):
    n = lambda m: sum(c.isdigit() for c in m)
    forms = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= n(m) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= n(m) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(forms) for m in re.finditer(p, text or "") if ok(m[0])]


def number(rnd, size=16):
    d = "".join(rnd.choice("0123456789") for _ in range(size - 1))
    return next(d + c for c in "0123456789" if luhn(d + c))


def base_of(row):
    return [tuple(s) for s in row["base"]]


def test_fixed_forms(documents, spark):
    rnd = random.Random(5)
    bits = ["a", "Z", "1", "2", "55", ".", "@", "-", " ", "+", "(", ")", "_", "é", "😀", "\n", "host.com", "4111 1111 1111 1111", "1.2.3.4", "+1 (555) 010-9999", "x@y.z"]
    rows = [(i, "".join(rnd.choices(bits, k=rnd.randint(0, 60)))) for i in range(400)]
    rows += [(1000 + i, f"é {number(rnd, 16 + i % 4)} {number(rnd)[:-1]}x") for i in range(20)]
    rows += [(2000, "a@b.c_d@e.f.g@h"), (2001, "1.2.3.4.5.6.7.8.999.1.1.1"), (2002, "9" * 50_000), (2003, "a" * 50_000), (2004, "1 " * 30_000), (2005, "+" * 1000 + "+1 234 567 8")]
    got = pii.personal_data(documents([*EDGES, *rows])).collect()
    texts = dict(rows)
    assert len(got) == len(EDGES) + len(rows)
    for r in got:
        if r["doc_id"] in texts and r["doc_id"] >= 9:
            assert base_of(r) == brute(texts[r["doc_id"]]), texts[r["doc_id"]][:80]
        assert {*base_of(r)} <= {tuple(s) for s in r["spans"]}
    assert not pii.personal_data(spark.createDataFrame([], SCHEMA)).collect()


def test_long_texts_are_linear(documents):
    """Very many matches, long tokens of signs and of dots: each took minutes where work grows with the square."""
    rows = [(1, " ".join(f"u{i}@example{i % 7}.com" for i in range(20_000))), (2, "#" * 60_000 + "1" * 7 + "#" * 60_000), (3, "1." * 40_000 + "x"), (4, "1 2" * 30_000), (5, ":a" * 30_000 + " a at b" * 5_000)]
    began = time.time()
    got = {r["doc_id"]: r for r in pii.personal_data(documents(rows)).collect()}
    assert time.time() - began < 120
    assert base_of(got[1]) == brute(rows[0][1]) and base_of(got[3]) == brute(rows[2][1])


def test_secrets_and_other_cases(documents):
    rnd = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    say = lambda: " ".join(rnd.choices(words, k=6))
    key = lambda: hashlib.sha1(rnd.randbytes(8)).hexdigest()
    rows = [(i, f'{say()} token = "{key()}" {say()}') for i in range(12)]
    rows += [(20 + i, f'{say()} TOKEN = "{key().upper()}"!! {say()}') for i in range(3)] + [(30, f'{say()} {key().upper()} {say()}')]
    rows += [(40 + i, f"call my phone: +1 555 010 {1000 + i} {say()}") for i in range(6)] + [(50, f"call my phone: 555 010 7777 {say()}"), (51, f"{say()} 555 010 7777 {say()}")]
    rows += [(60 + i, f"please write to mail{i}@example.com {say()}") for i in range(6)] + [(70, f"please write to jo at example dot com {say()}")]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.personal_data(documents(rows)).collect()}
    texts = dict(rows)
    said = lambda i: [(pii.KINDS[k], texts[i][a:b]) for k, a, b in got[i]]
    for i in (*range(12), *range(20, 23)):
        assert said(i) == [("secret", texts[i].split('"')[1])]
    assert not got[30] and not got[51]
    assert said(50) == [("phone", "555 010 7777")] and said(70) == [("email", "jo at example dot com")]


def test_hidden_seeds_are_found_again(documents):
    """A third of the seeds is taken for candidates: their contexts bring them back, chance contexts bring nothing."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(50)]
    say = lambda k: " ".join(rnd.choices(words, k=k))
    rows = [(i, f"{say(9)} my card is {number(rnd)} {say(9)}") for i in range(60)] + [(100 + i, f"{say(9)} {number(rnd)} {say(9)}") for i in range(60)]
    marked = pii.with_patterns(pii.placed(pii.stored(pii.mentions(documents(rows)), "test")))
    hidden = F.pmod(F.xxhash64("value"), F.lit(3)) == 0
    kinds = {r["value"]: r["kind"] for r in marked.collect()}
    masked = marked.withColumn("kind", F.when(hidden, pii.CANDIDATE).otherwise(F.col("kind")))
    lost = {r["value"] for r in masked.where(hidden).collect()}
    back = pii.discovered(masked).join(marked.select("rid", "start", "value").distinct(), ["rid", "start"])
    again = {(r["value"], r["kind"]) for r in back.collect()}
    told = {v for v in lost if any(v in t for i, t in rows if i < 100)}
    assert len(told) > 8 and {v for v, _ in again} == told and all(kinds[v] == k for v, k in again)


def test_bootstrapping(documents):
    rnd = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    say = lambda: " ".join(rnd.choices(words, k=6))
    rows = [(i, f"{say()} my phone: +1 555 010 {1000 + i} {say()}") for i in range(12)]
    rows += [(50, f"{say()} my phone: 555-010-7777 {say()}"), (51, f"{say()} order 20240199 {say()}"), (52, f"{say()} my phone: broken {say()}")]
    got = {r["doc_id"]: r for r in pii.personal_data(documents(rows)).collect()}
    at = rows[12][1].index("555-010")
    assert [tuple(s) for s in got[50]["spans"]] == [(3, at, at + 12)] and not got[50]["base"]
    assert not got[51]["spans"] and not got[52]["spans"]
    assert all(len(got[i]["spans"]) == 1 for i in range(12))
