"""A corpus pipeline: rate, drop repeated lines, drop near duplicates, mix sources, encode.

In every stage null and empty texts count as empty, texts are read whole whatever their length, equal texts fare alike, an
empty table gives an empty one, and all columns of documents but the changed ones pass through; ValueError if one bears the
name of a column that the stage's operator adds. Null ids and sources are values of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakelog.llm.common import stored, table
from wakelog.llm.line_dedup import dedup_lines
from wakelog.llm.mixing import first_words, mix_sources
from wakelog.llm.near_dedup import drop_near_duplicates
from wakelog.llm.pieces import encode_pieces
from wakelog.llm.quality import fit_quality, graded, rate_documents, score_quality
from wakelog.llm.queries import piece_vocabulary


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the good grade is under one half go; none go if no document is labelled.

    Empty texts are rated as texts without words; rows that repeat go or stay together.
    """
    return rate_documents(docs, table(spark, sf_dir, "labels")).where("keep").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines stay in one document; n_chars follows. Documents stay, even if no line is left.

    Rows that share an id are one document to the counts; the largest id with a line keeps it.
    """
    out = dedup_lines(docs)
    changed = out.withColumn("text", F.when(out["n_dropped"] > 0, out["kept_text"]).otherwise(out["text"]))
    return changed.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: a row with the smallest id of the class, ids before null ones.

    Null and empty texts are equal to each other, so one of them stays; of repeated rows one stays.
    """
    return drop_near_duplicates(docs).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: a row for each copy. Texts without words are never taken.

    The weight of a document in the draw is its grade, by the model that the labels and their documents give, as in the
    first stage. A document at its source's edge has a copy of its first words, n_chars long; without labels all grades
    are alike. Ties of one key go by the hash of the text; null sources are one source.
    """
    model = fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), graded(), 3)
    mixed = mix_sources(score_quality(docs, model), quality=F.col("expected_grade") / 2).where("taken > 0")
    more = F.when(F.col("part") > 0, 1).otherwise(0)
    each = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), (F.col("copies") + more).cast("int"))))
    in_part = F.col("_copy") > F.col("copies")
    each = each.withColumn("text", F.when(in_part, first_words(F.col("text"), F.col("part"))).otherwise(F.col("text")))
    return each.withColumn("n_chars", F.when(in_part, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, and the piece ids of the text with their number; an empty text has none. Repeated rows repeat them."""
    out = encode_pieces(docs, piece_vocabulary(), keep=["doc_id", "source"])
    return out.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [("quality classifier", reject_poor), ("line dedup", drop_lines), ("near dedup", drop_copies), ("mix sources", mix), ("encode pieces", encode)]

#: The classifier and the aligned near duplicates have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
