"""Each stage of the pipeline on its own input, and the whole."""

import hashlib
import math
import re
from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm.conftest import EDGES, SCHEMA  # noqa: E402
from tests.llm.test_first_five import brute_lines, some_texts  # noqa: E402

from wakelog.llm.pieces import Decoder  # noqa: E402
from wakelog.llm.quality import Features, fit_quality, graded  # noqa: E402
from wakelog.llm.queries import piece_vocabulary  # noqa: E402

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture
def sf_dir(spark, tmp_path):
    rows = [(i, t, "en", s, len(t)) for i, t, s in some_texts(120)]
    spark.createDataFrame([*rows, *EDGES], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 3)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rated = pipeline.reject_poor(spark, docs, sf_dir)
    assert rated.columns == docs.columns
    lines = pipeline.drop_lines(spark, docs, sf_dir)
    want = Counter((i, t) for i, _, _, t in brute_lines([tuple(r) for r in docs.collect()]).elements())
    assert Counter((r["doc_id"], r["text"] or "") for r in lines.collect()) == want and lines.columns == docs.columns
    copies = pipeline.drop_copies(spark, docs, sf_dir)
    got = [r["text"] or "" for r in copies.collect()]
    assert len(got) == len(set(got)) and {*got} <= {r["text"] or "" for r in docs.collect()} and copies.columns == docs.columns
    mixed = pipeline.mix(spark, docs, sf_dir)
    assert mixed.columns == docs.columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 4
    encoded = pipeline.encode(spark, docs, sf_dir).collect()
    assert len(encoded) == docs.count() and all(r["n_tokens"] == len(r["token_ids"]) for r in encoded)


def test_stages_against_brute_force(spark, sf_dir):
    """Near dedup against all pairs, mixing against plain sums, encoding against decoding, rating against the model's rule."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    kept = pipeline.drop_copies(spark, docs, sf_dir).collect()
    groups = brute_groups([(r["doc_id"], r["text"]) for r in rows])
    assert Counter(r["text"] or "" for r in kept).keys() <= {r["text"] or "" for r in rows}
    assert len(kept) == len(groups) and all(sum((k["text"] or "") in g for k in kept) == 1 for g in groups)
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in pipeline.mix(spark, docs, sf_dir).collect()) == brute_mix(rows, grades(spark, docs, sf_dir))
    decoder = Decoder(piece_vocabulary())
    back = Counter((r["doc_id"], decoder.decode(r["token_ids"])) for r in pipeline.encode(spark, docs, sf_dir).collect())
    assert back == Counter((r["doc_id"], r["text"] or "") for r in rows)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), graded(), 3)
    chance = lambda t: 1 / (1 + math.exp(float(model.thresholds[1]) - model.score(*Features().of(t or ""))))
    rated = {(r["doc_id"], r["text"]): chance(r["text"]) for r in rows}
    good = {(r["doc_id"], r["text"]) for r in pipeline.reject_poor(spark, docs, sf_dir).collect()}
    assert good == {k for k, p in rated.items() if p >= 0.5}


def grades(spark, docs, sf_dir):
    """Grades by id and text, summed in plain Python from the model's score of each text."""
    model = fit_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), graded(), 3)
    extract = Features()
    score = {t: model.score(*extract.of(t or "")) for t in {r["text"] for r in docs.collect()}}
    return {t: sum(1 / (1 + math.exp(float(k) - x)) for k in model.thresholds) for t, x in score.items()}


def brute_mix(rows, grade):
    """Copies of documents by the rule itself: targets reshared until none is above, keys in order, words counted off."""
    words = lambda t: [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    size = {s: sum(len(words(r["text"])) for r in by_source[s]) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(size.values()), set(names), {}
    while over := {s for s in open_ if left / sum(weight[x] for x in open_) * weight[s] > 2 * size[s]}:
        target |= {s: 2 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        open_ -= over
    target |= {s: left / sum(weight[x] for x in open_) * weight[s] for s in open_}
    out = Counter()
    for s in names:
        unit = lambda r: (int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        epochs = int(target[s] // size[s]) if size[s] else 0
        budget = math.floor(target[s] - epochs * size[s])
        for r in sorted(by_source[s], key=lambda r: -math.log(unit(r)) / max(0.05, grade[r["text"]] / 2)):
            ends = words(r["text"])
            more = min(len(ends), budget)
            budget -= more
            whole = epochs + (more == len(ends))
            if ends and whole:
                out[r["doc_id"], r["text"], r["n_chars"]] += whole
            if 0 < more < len(ends):
                out[r["doc_id"], r["text"][: ends[more - 1]], ends[more - 1]] += 1
    return out


def brute_groups(rows):
    """Sets of texts that belong together, from all pairs of distinct texts, by plain shingle sets and plain edit distance."""
    words = {t: (t or "").lower().split() for t in {t or "" for _, t in rows}}
    group = {t: {t} for t in words}
    for a, x in words.items():
        for b, y in words.items():
            if a < b and group[a] is not group[b] and x and y and linked(x, y):
                group[a] |= group[b]
                for t in group[b]:
                    group[t] = group[a]
    return {id(g): g for g in group.values()}.values()


def linked(x, y):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (x, y)]
    if len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1]):
        return False
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        new = [i]
        for j, b in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1] <= 0.2 * max(len(x), len(y))


def test_run(spark, sf_dir):
    rows = pipeline.run(spark, sf_dir).collect()
    assert rows and all(r["n_tokens"] > 0 for r in rows)
    assert [re.sub(r"\W+", " ", name) for name, _ in pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "mix sources", "encode pieces"]
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        assert not stage(spark, empty, sf_dir).collect()
