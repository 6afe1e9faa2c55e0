"""Ranked lexical search with bag deduplication.

Documents are restricted to the words of the items. Documents with the same term counts and the same length factor score
alike for every item, so they form one class: grouped by a hash and verified by the bytes of the vector. Each class is scored
once for all items; the best classes are expanded to their members by ascending id. An item's k best documents lie in
its k best classes (by score, then smallest member), and of a class only the k smallest ids can be among them, so no
step needs more than k of either.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: Bytes of a term as they count: digits, a-z, A-Z lower-cased, and all of multi-byte characters; others part terms.
_FORM = bytes(b if b >= 128 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Pairs of item and term that one block of items has about, and (class, item) pairs that a task adds up at once.
BLOCK_PAIRS, CELLS = 400_000, 2_000_000


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return text.translate(_FORM).split()


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [t or b"" for t in batch[name].cast(pa.binary()).to_pylist()]


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, term): the distinct terms of each item; rows that share an id are one item."""
    kind = items.schema[item_id].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [(i, t) for i, x in zip(b["item_id"].to_pylist(), _texts(b, "text"), strict=True) for t in set(terms(x))]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], b.schema.field("item_id").type), pa.array([p[1] for p in pairs], pa.binary())], ["item_id", "term"])

    return items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).mapInArrow(split, f"item_id {kind}, term binary").distinct()


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, vector): number of terms, and (term, count) of those in the vocabulary as int32 pairs by term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            sizes, vectors = [], []
            for text in _texts(b, "text"):
                found = terms(text)
                sizes.append(len(found))
                tf = Counter(i for t in found if (i := known.get(t)) is not None)
                vectors.append(np.array(sorted(tf.items()), np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(sizes, pa.int64()), pa.array(vectors, pa.binary())], ["doc_id", "n", "vector"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, "doc_id long, n long, vector binary")


def _unpacked(vectors: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of all pairs of several vectors."""
    pairs = np.frombuffer(b"".join(vectors), np.int32).reshape(-1, 2)
    return np.repeat(np.arange(len(vectors)), [len(v) // 8 for v in vectors]), pairs[:, 0], pairs[:, 1]


def document_frequencies(vectors: DataFrame, size: int) -> DataFrame:
    """(term, df): documents that hold each term; a task sends one row a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(_unpacked(b["vector"].to_pylist())[1], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["term", "df"])

    return vectors.select("vector").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Scorer:
    """The items of a block as lists by term, and the weights of the terms."""

    def __init__(self, pairs: list[tuple[int, int]], weights: np.ndarray, items: int):
        order = np.array(sorted((t, i) for i, t in pairs), np.int64).reshape(-1, 2)
        self.holders, self.weights, self.items = order[:, 1], weights, items
        self.first = np.searchsorted(order[:, 0], np.arange(len(weights) + 1))

    def scores(self, m: np.ndarray, vectors: list[bytes]) -> np.ndarray:
        """Scores of classes (rows) for the items. Sums stay under 2**53, so doubles hold them exactly."""
        row, term, tf = _unpacked(vectors)
        tf = tf.astype(np.int64)
        part = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
        times = self.first[term + 1] - self.first[term]
        total = np.zeros(len(m) * self.items)
        # Long documents have many pairs: they are added up in parts.
        cuts = np.unique([0, *np.searchsorted(np.cumsum(times), np.arange(CELLS, times.sum(), CELLS)), len(times)])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            n = times[a:b]
            at = np.repeat(self.first[term[a:b]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            total += np.bincount(np.repeat(row[a:b], n) * self.items + self.holders[at], np.repeat(part[a:b], n), len(total))
        return total.astype(np.int64).reshape(len(m), self.items)


class Best:
    """The k best classes of each item so far, by score and then smallest member."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.rows = np.zeros((0, 4), np.int64)

    def add(self, scores: np.ndarray, first: np.ndarray, classes: np.ndarray) -> None:
        c, item = np.nonzero(scores >= self.floor)
        self.rows = np.concatenate([self.rows, np.stack([item, scores[c, item], first[c], classes[c]], axis=1)])
        if len(self.rows) > 4 * self.k * len(self.floor):
            self.cut()

    def cut(self) -> np.ndarray:
        rows = self.rows[np.lexsort((self.rows[:, 2], -self.rows[:, 1], self.rows[:, 0]))]
        place = np.arange(len(rows)) - np.searchsorted(rows[:, 0], rows[:, 0])
        last = rows[place == self.k - 1]
        self.floor[last[:, 0]] = last[:, 1]
        self.rows = rows[place < self.k]
        return self.rows


def best_classes(classes: DataFrame, scorer: Scorer, k: int) -> DataFrame:
    """(item, score, first, class): at most k rows of each item from each task."""
    shared = classes.sparkSession.sparkContext.broadcast(scorer)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        best, step = Best(s.items, k), max(1, CELLS // s.items)
        for b in batches:
            for at in range(0, len(b), step):
                part = b.slice(at, step)
                m, first, number = (part[c].to_numpy(zero_copy_only=False) for c in ("m", "first", "class"))
                best.add(s.scores(m, part["vector"].to_pylist()), first, number)
        rows = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(4)], ["item", "score", "first", "class"])

    return classes.select("m", F.coalesce("first", F.lit(2**63 - 1)).alias("first"), "class", "vector").mapInArrow(rank, "item long, score long, first long, class long")


def _first(rows: DataFrame, k: int, by: list[str], *order) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def _search_block(docs: DataFrame, pairs: list, k: int, doc_id: str, text: str, id_type: str) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    ids = list(dict.fromkeys(p["item_id"] for p in pairs))
    number = {x: i for i, x in enumerate(ids)}
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(p["term"]) for p in pairs}))}
    vectors = stored(term_vectors(docs, vocabulary, doc_id, text), "term-vectors")
    total = vectors.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("words")).head()
    n, words = total["docs"], total["words"] or 1
    weights = np.zeros(len(vocabulary), np.int64)
    # A row a term of the block.
    for r in document_frequencies(vectors, len(vocabulary)).collect():
        weights[r["term"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1)))
    m = F.lit(50) + F.expr(f"(50 * n * {n}L) div {words}L")
    held = vectors.where(F.octet_length("vector") > 0).select("doc_id", m.alias("m"), "vector").withColumn("h", F.xxhash64("m", "vector"))
    # Equal hashes are verified: rows are one class only if m and all bytes of the vector agree.
    kinds = held.groupBy("h", "m", "vector").agg(F.min("doc_id").alias("first"))
    classes = stored(kinds.withColumn("class", F.monotonically_increasing_id()), "bag-classes")
    scorer = Scorer([(number[p["item_id"]], vocabulary[bytes(p["term"])]) for p in pairs], weights, len(ids))
    winners = stored(_first(best_classes(classes, scorer, k), k, ["item"], F.desc("score"), "first").select("item", "score", "class"), "best-classes")
    won = classes.join(winners.select("class").distinct(), "class", "left_semi")
    # At most k classes an item, so the hashes are bounded by the block; they keep other documents out of the shuffle.
    near = held.join(F.broadcast(won.select("h").distinct()), "h", "left_semi")
    members = _first(near, k, ["h", "m", "vector"], F.asc_nulls_last("doc_id")).drop("place").join(won.select("class", "h", "m", "vector"), ["h", "m", "vector"])
    ranked = _first(members.select("class", "doc_id").join(winners, "class"), k, ["item"], F.desc("score"), F.asc_nulls_last("doc_id"))
    names = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {id_type}")
    return ranked.join(names, "item").select("item_id", F.col("place").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, those above 0 only.

    Terms are runs of letters and digits (ASCII, A-Z lower-cased) and of all characters beyond ASCII. A term's weight is
    w = floor(1000 ln((2 N + 2) / (2 df + 1))), a document's m is 50 + (50 n N) div L, and its score for an item sums
    w ((10^9 tf) div (1000 tf + 20 m)) over the item's distinct terms; N documents have terms, L terms in all, n of them
    in this one. Equal scores go by ascending id, null ids last.

    Items come in blocks of about block_pairs (item, term) pairs, which is what the driver holds and tasks get as a
    broadcast; each block reads the documents once. Texts are read whole. Null and empty texts have no terms, so such items
    have no rows. Items that share an id are one; documents that share one each have their row. Ids of documents
    are whole numbers. An empty table of either gives an empty result. Columns beyond those named are not read.
    """
    wanted = stored(item_terms(items, item_id, text), "item-terms")
    blocks = -(-wanted.count() // block_pairs)
    id_type = items.schema[item_id].dataType.simpleString()
    dealt = F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks)))
    found = []
    for i in range(blocks):
        if pairs := wanted.where(dealt == i).collect():
            found.append(_search_block(docs, pairs, k, doc_id, text, id_type))
    empty = docs.sparkSession.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found) if found else empty
