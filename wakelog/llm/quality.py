"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text features.

P(grade > k | text) = sigmoid(w · x - t_k): one weight vector, shared by all grades, and ordered thresholds t_k. It gives
the expected grade and the tail probabilities, by which documents are selected.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, stored, text_or_empty

#: Labelled documents that are fitted at most, and bytes of their features: those with the smallest hash of their id.
FIT_ROWS, FIT_BYTES = 10_000, 96_000_000
#: Places that features hash to. A model keeps those with a weight only, so many places cost nothing.
WIDTH = 1 << 24
#: Words whose places a worker remembers, of some 300 bytes each.
REMEMBERED = 100_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SHAPES = [(re.compile(r"[^\W\d_]*[a-zß-ÿ][^\W\d_]*"), "a"), (re.compile(r"[^\W\d_]+"), "A"), (re.compile(r"\d+"), "0")]


def _shape(word: str) -> str:
    """What kind of characters a word has, in order: a for letters, A for capitals only, 0 for digits, signs as they are."""
    for form, to in _SHAPES:
        word = form.sub(to, word)
    return word[:8]


class Features:
    """The distinct hashed features of a text: its words, their shapes, and how varied and how long they are."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def _places(self, word: str) -> tuple[int, int]:
        core = word.lower().strip(".,;:!?\"'()")
        found = zlib.crc32(core.encode("utf-8", "surrogatepass")) % WIDTH, zlib.crc32(b"\0shape" + _shape(word).encode("utf-8", "surrogatepass")) % WIDTH
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = found
        return found

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(places, values), places ascending. A word counts once; a shape by its share of the words."""
        words = _WORD.findall(text)
        n = max(1, len(words))
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        got: dict[int, float] = {}
        shares: dict[int, int] = {}
        for w, c in counts.items():
            a, b = self.known.get(w) or self._places(w)
            got[a] = 1.0
            shares[b] = shares.get(b, 0) + c
        for b, c in shares.items():
            got[b] = got.get(b, 0.0) + 3.0 * c / n
        for name, level in (("varied", int(10 * len(counts) / n)), ("long", len(words).bit_length()), ("often", int(10 * max(counts.values(), default=0) / n))):
            got[zlib.crc32(f"\0{name}{level}".encode()) % WIDTH] = 1.0
        places = np.fromiter(got.keys(), np.int64, len(got))
        values = np.fromiter(got.values(), np.float64, len(got))
        order = np.argsort(places)
        return places[order], values[order]


@dataclass
class OrdinalModel:
    """places: ascending, those with a weight; weights: theirs; thresholds: ascending, one less than there are grades;
    fitted: whether there were rows to fit."""

    places: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    fitted: bool = True

    def score(self, places: np.ndarray, values: np.ndarray) -> float:
        """w · x of one text."""
        if not len(self.places):
            return 0.0
        at = np.minimum(np.searchsorted(self.places, places), len(self.places) - 1)
        return float(np.where(self.places[at] == places, self.weights[at] * values, 0.0).sum())

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and k; it falls with k, as the thresholds ascend."""
        return 1.0 / (1.0 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -40, 40)))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, rounds: int = 400, step: float = 0.3, lasso: float = 5e-4, least: int = 3) -> OrdinalModel:
    """Fit by adaptive gradient steps over all rows, with soft thresholding, so that chance words get no weight.

    Features of fewer than ``least`` documents are left out. The thresholds are the first one and positive gaps, so they
    stay ordered. Rare grades count more, by the square root. Without rows the model is neutral.
    """
    if not len(rows):
        return OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.arange(n_grades - 1) - (n_grades - 2) / 2, False)
    flat = np.concatenate([p for p, _ in rows]), np.concatenate([v for _, v in rows]), np.array([len(p) for p, _ in rows])
    return _fit_flat(*flat, grades, n_grades, rounds, step, lasso, least)


#: Features that a step of the fit looks at together.
TOGETHER = 1 << 19


def _fit_flat(at: np.ndarray, value: np.ndarray, lengths: np.ndarray, grades: np.ndarray, n_grades: int, rounds: int = 400, step: float = 0.3, lasso: float = 5e-4, least: int = 3) -> OrdinalModel:
    """fit_ordinal of rows that lie one after the other. Beyond at and value it holds as much again, and TOGETHER features."""
    none, n = np.zeros(0, np.int64), len(lengths)
    used, seen = np.unique(at, return_counts=True)
    used = used[seen >= least]
    # Whole rows of about TOGETHER features each: first row, places among used, values, and how many each row has.
    blocks, ends = [], np.cumsum(lengths)
    lo = 0
    while lo < n:
        start = ends[lo] - lengths[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, start + TOGETHER, "right")))
        part, row = at[start : ends[hi - 1]], np.repeat(np.arange(hi - lo, dtype=np.int32), lengths[lo:hi])
        place = np.minimum(np.searchsorted(used, part), max(0, len(used) - 1)).astype(np.int32)
        keep = used[place] == part if len(used) else np.zeros(len(part), bool)
        blocks.append((lo, hi, place[keep], value[start : ends[hi - 1]][keep], np.bincount(row[keep], minlength=hi - lo)))
        lo = hi
    above = grades[:, None] > np.arange(n_grades - 1)[None, :]
    share = np.clip(above.mean(0), 0.01, 0.99)
    odds = -np.log(share / (1 - share))
    first, gaps = odds[0], np.log(np.expm1(np.maximum(np.diff(odds), 0.05)))
    w, memory, memory_t = np.zeros(len(used)), np.full(len(used), 1e-8), np.full(n_grades - 1, 1e-8)
    counts = np.bincount(grades, minlength=n_grades)
    weight = 1 / np.sqrt(np.maximum(counts, 1))[grades]
    weight /= weight.mean()
    thresholds = odds
    for _ in range(rounds):
        thresholds = np.concatenate([[first], first + np.cumsum(np.log1p(np.exp(gaps)))])
        scores = np.concatenate([np.bincount(np.repeat(np.arange(hi - lo), size), weights=v * w[place], minlength=hi - lo) for lo, hi, place, v, size in blocks])
        error = (OrdinalModel(none, w, thresholds).tails(scores) - above) * weight[:, None]
        slope, of_row = np.zeros(len(used)), error.sum(1)
        for lo, hi, place, v, size in blocks:
            slope += np.bincount(place, weights=v * np.repeat(of_row[lo:hi], size), minlength=len(used))
        slope /= n
        memory += slope**2
        rate = step / np.sqrt(memory)
        w -= rate * slope
        w = np.sign(w) * np.maximum(np.abs(w) - rate * lasso, 0.0)
        by_threshold = -error.mean(0)
        down = np.concatenate([[by_threshold.sum()], np.cumsum(by_threshold[::-1])[::-1][1:] / (1 + np.exp(-gaps))])
        memory_t += down**2
        move = step * down / np.sqrt(memory_t)
        first, gaps = first - move[0], gaps - move[1:]
    return OrdinalModel(used[w != 0].astype(np.int64), w[w != 0], thresholds)


def fit_quality(docs: DataFrame, labels: DataFrame, grade: Column, n_grades: int, doc_id: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> OrdinalModel:
    """Fit on the fit_rows labelled documents with the smallest hash of their id, or on the first of them whose features
    take fit_bytes: both are bounds, so that the driver can fit them.

    grade is a column over labels, 0 to n_grades - 1; rows where it is null are left out. Of several labels for one id
    the smallest grade counts. Null texts are empty. Rows that share an id are all fitted, within the bounds, in the order
    of the hashes of their texts; so reruns agree. Other columns of either table are not read. ValueError if fit_bytes is
    too small for the first document's features, as a model of no row would keep every document.
    """
    marks = labels.select(F.col(doc_id).alias("_id"), grade.cast("int").alias("_grade")).where("_id is not null and _grade is not null").groupBy("_id").agg(F.min("_grade").alias("_grade"))
    # The labels that are fitted are chosen before any text moves; the join reads the texts of those only.
    chosen = marks.orderBy(F.xxhash64(F.col("_id")), "_id").limit(fit_rows)
    texts = docs.select(F.col(doc_id).alias("_id"), text_or_empty(text).alias("_text"))
    sample = texts.join(F.broadcast(chosen), "_id").select("_id", "_grade", "_text", F.xxhash64("_text").alias("_tie"))
    # The rows within the first bound are known by the last of them; equal rows are one.
    place = F.struct(F.xxhash64("_id").alias("h"), "_id", "_tie")
    upto = lambda row: place <= F.struct(F.lit(row["h"]).alias("h"), F.lit(row["_id"]).alias("_id"), F.lit(row["_tie"]).alias("_tie"))
    last = sample.select(place.alias("p")).distinct().orderBy("p").limit(fit_rows).agg(F.max("p").alias("m")).head()["m"]
    if last is None:
        return fit_ordinal([], np.zeros(0, np.int64), n_grades)
    kind = labels.schema[doc_id].dataType.simpleString()
    once = sample.where(upto(last)).dropDuplicates(["_id", "_tie"])
    found = stored(once.mapInPandas(_extracted, f"_id {kind}, _tie long, _grade int, places binary, values binary"), "features")
    # Only features come to the driver, and no more of them than the second bound.
    so_far = W.orderBy(place).rowsBetween(W.unboundedPreceding, 0)
    sizes = found.select(place.alias("p"), F.sum(F.octet_length("places") + F.octet_length("values")).over(so_far).alias("sum"))
    last = sizes.where(F.col("sum") <= fit_bytes).agg(F.max("p").alias("m")).head()["m"]
    if last is None:
        raise ValueError(f"there are labelled documents, but fit_bytes={fit_bytes} holds the features of none of them")
    # Places are below WIDTH and values come in single precision, so both are held in four bytes as they arrive.
    rows = [(str(r["_id"]), r["_tie"], r["_grade"], np.frombuffer(r["places"], np.int64).astype(np.int32), np.frombuffer(r["values"], np.float32).copy()) for r in found.where(upto(last)).toLocalIterator()]
    rows.sort(key=lambda r: r[:3])
    grades, lengths = np.array([r[2] for r in rows], np.int64), np.array([len(r[3]) for r in rows], np.int64)
    at, value = np.concatenate([r[3] for r in rows]), np.concatenate([r[4] for r in rows])
    rows.clear()
    return _fit_flat(at, value, lengths, grades, n_grades)


def _extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    extract = Features()
    for pdf in batches:
        got = [extract.of(t) for t in pdf["_text"]]
        yield pdf[["_id", "_tie", "_grade"]].assign(places=[p.tobytes() for p, _ in got], values=[v.astype(np.float32).tobytes() for _, v in got])


def score_quality(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """docs with expected_grade (double) and tails (array of P(grade > k), k from 0) added, from the whole text.

    Null and empty texts are scored as texts without words. Equal texts get equal scores, repeated rows repeat them. An
    empty table gives an empty one. Other columns pass through; ValueError if one bears the name of an added column.
    """
    fresh(docs, "expected_grade", "tails", "_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted, extract = shared.value, Features()
        for texts in batches:
            out = np.empty(len(texts))
            for i, t in enumerate(texts):
                out[i] = fitted.score(*extract.of(t))
            yield pd.Series(out)

    score = docs.withColumn("_score", scored(text_or_empty(text)))
    tails = F.array(*[1 / (1 + F.exp(F.lit(float(t)) - F.col("_score"))) for t in model.thresholds])
    with_tails = score.withColumn("tails", tails).drop("_score")
    return with_tails.withColumn("expected_grade", F.aggregate("tails", F.lit(0.0), lambda s, p: s + p))


def graded(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Three grades from two marks: 0 poor, 1 well written but toxic, 2 good; null if a mark is missing."""
    return F.when(F.col(quality).isNull() | F.col(toxic).isNull(), None).when(F.col(quality) == 0, 0).when(F.col(toxic) == 1, 1).otherwise(2)


def rate_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """docs with expected_grade, p_above_0, p_above_1 and keep added: keep if the good grade has a chance of ``least``.

    Without labelled documents nothing is known of any: the chances are those of the neutral model, and all are kept. Null
    and empty texts are rated as texts without words, long ones whole; equal texts get equal ratings, repeated rows repeat
    them. An empty table gives an empty one. Other columns pass through; ValueError if one bears the name of an added one.
    """
    fresh(docs, "p_above_0", "p_above_1", "keep")
    model = fit_quality(docs, labels, graded(), 3)
    rated = score_quality(docs, model)
    good = F.get("tails", F.lit(1)) >= least if model.fitted else F.lit(True)
    return rated.withColumns({"p_above_0": F.get("tails", F.lit(0)), "p_above_1": F.get("tails", F.lit(1)), "keep": good}).drop("tails")
