"""Line dedup over levelled sorted runs of line hashes, in DataFrame functions only.

A *run* is a table of line keys, sorted by key hash, with the number of documents and the largest document id seen so
far. Documents arrive in batches. Each batch is aggregated, anti-joined with the keys that are already settled (frequent
enough, their keeper known), and added as a run of level 0. When a level holds ``fanout`` runs they are merged into one
run of the next level, so a key is rewritten once a level. Batches go from large document ids to small ones: the first
batch with a key has its keeper, and a settled key never has to be written again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, fresh, stored, text_or_empty

#: Upper and lower case of the ASCII letters.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def _hashes(key: Column) -> list[Column]:
    """128 bits of a key as two longs."""
    return [F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), F.reverse(key), key).alias("k2")]


def line_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20) -> DataFrame:
    """(doc, own, pos, k1, k2): one row per line whose key has at least min_chars code points; own is a hash of the text."""
    lines = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text_or_empty(text)).alias("own"), F.posexplode(F.split(text_or_empty(text), "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc", "own", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc", "own", "pos", *_hashes(F.col("key")))


class LineRuns:
    """Levelled runs (k1, k2, n_docs, keeper); see the module's text.

    A document must come in one batch only, and batches in descending ranges of ids; ``add`` does not check this.
    """

    def __init__(self, spark: SparkSession, min_docs: int = 3, fanout: int = 4):
        self.spark, self.min_docs, self.fanout, self.levels = spark, min_docs, fanout, [[]]

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        rows = reduce(DataFrame.unionByName, runs)
        return rows.groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def all(self) -> DataFrame | None:
        """Every key with its totals; None before the first batch."""
        runs = [r for level in self.levels for r in level]
        return self._merged(runs) if runs else None

    def settled(self) -> DataFrame | None:
        """The keys found in min_docs documents or more; each has one row."""
        found = self.all()
        return None if found is None else found.where(F.col("n_docs") >= self.min_docs)

    def add(self, index: DataFrame) -> None:
        """Take in the rows (doc, k1, k2) of the next batch."""
        own = index.select("doc", "k1", "k2").distinct().groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper"))
        if (settled := self.settled()) is not None:
            own = own.join(settled.select("k1", "k2"), ["k1", "k2"], "left_anti")
        self.levels[0].append(self._run(own))
        for at, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].append(self._run(self._merged(level)))
                level.clear()

    def _run(self, rows: DataFrame) -> DataFrame:
        return stored(rows.sortWithinPartitions("k1", "k2"), "line-run")


def batch_bounds(docs: DataFrame, doc_id: str, batches: int) -> list:
    """Ids that cut the documents into about equal batches; batches - 1 numbers at most."""
    shares = [i / batches for i in range(1, batches)]
    found = docs.agg(F.percentile_approx(F.col(doc_id), F.array(*map(F.lit, shares)), F.lit(1000)).alias("b")).head()["b"]
    return sorted(set(found or []), reverse=True)


def in_batches(index: DataFrame, bounds: list) -> list[DataFrame]:
    """The index cut at descending bounds, largest ids first; null ids come with the smallest."""
    doc, parts, rest = F.col("doc"), [], index
    for bound in bounds:
        parts.append(rest.where(doc > bound))
        rest = rest.where((doc <= bound) | doc.isNull())
    return [*parts, rest]


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """docs with the columns n_lines, n_dropped (long) and kept_text (string) added.

    A key (see line_key) of at least min_chars code points, found in at least min_docs documents, loses all its lines but
    those in the document with the largest id that holds it. Other lines stay, in order, joined by a line feed.

    Null and empty texts are one empty line and stay. Lines repeated inside a document count once. Rows that share an id
    are one document to the counts, and each row is rewritten by the same rule. A document with a null id is never a keeper
    and counts as one document with all others of null id; it loses the frequent lines. An empty table gives an empty
    one. Other columns pass through; ValueError if one bears the name of an added column.
    """
    fresh(docs, "n_lines", "n_dropped", "kept_text", "_drop", "_doc", "_own")
    # One scan makes the index, with an occurrence per key and row; all batches read that small table.
    index = stored(line_index(docs, doc_id, text, min_chars), "line-index")
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    for part in in_batches(index, batch_bounds(docs, doc_id, batches)):
        runs.add(part)
    frequent = runs.settled().select("k1", "k2", "keeper")
    lost = index.join(frequent, ["k1", "k2"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    drops = lost.groupBy(F.col("doc").alias("_doc"), F.col("own").alias("_own")).agg(F.collect_set("pos").alias("_drop"))
    same = docs[doc_id].eqNullSafe(F.col("_doc")) & (F.xxhash64(text_or_empty(text)) == F.col("_own"))
    out = docs.join(drops, same, "left").drop("_doc", "_own")
    lines = F.split(text_or_empty(text), "\n", -1)
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    kept = F.when(F.col("_drop").isNull(), places).otherwise(F.array_except(places, F.col("_drop")))
    text_kept = F.when(F.col("_drop").isNull(), text_or_empty(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return out.withColumns({"n_lines": F.size(lines).cast("long"), "n_dropped": (F.size(lines) - F.size(kept)).cast("long"), "kept_text": text_kept}).drop("_drop")
