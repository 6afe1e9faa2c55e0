"""The queries of this folder's operators, over the whole given tables, and the SQL that some of them match."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact_dedup import exact_duplicates
from .fingerprints import fingerprint_edits
from .line_dedup import dedup_lines
from .media import read_png, store_as_png
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .periodic_runs import periodic_runs, with_period
from .pieces import Vocabulary, round_trips
from .pii import BASE, KINDS, listed, personal_data
from .quality import rate_documents
from .ranked_search import search
from .suffix_dedup import remove_repeats
from .token_counts import count_tokens


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rate_documents(docs, table(spark, sf_dir, "labels")).drop("text")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return read_png(store_as_png(docs)).select("doc_id", "n_bytes", "read.*")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "keeper")


@functools.cache
def piece_vocabulary(name: str = "piece_bpe_32k.model") -> Vocabulary:
    import public_tokenizers

    return Vocabulary.read(public_tokenizers.path(name))


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"), piece_vocabulary(), keep=["doc_id"])


@functools.cache
def vocabulary(name: str) -> str:
    """The content of one of the public tokenizer files; the driver reads it, and tasks get it as a broadcast."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, vocabulary("word_bpe_49k.json")).drop("text")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(table(spark, sf_dir, "documents"))
    n = lambda spans, i: (F.size(spans) - F.size(F.array_remove(F.col(f"{spans}.kind"), i))).cast("long")
    counts = [n("base", i).alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE])]
    added = [n("spans", KINDS.index("secret")).alias("n_secret"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"), F.size("spans").cast("long").alias("n_spans")]
    return out.select("doc_id", *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), *added)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), prepare=with_period)


def queries() -> dict:
    return {f.__name__: f for f in (op1_document_fingerprints, op2_quality_classifier, op3_suffix_dedup, op4_media_columns, op5_minhash_near_dedup, op6_sentence_pieces, op7_token_counts, op8_line_dedup, op9_mix_sources, op10_personal_data, op11_exact_dedup, op12_ranked_search, op13_periodic_runs)}


#: DuckDB strings for the characters that count as blanks.
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP8_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM docs),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
w AS (
  SELECT doc_id, source, size, md5(text) AS tie,
    greatest(0.05::DOUBLE, 1.0::DOUBLE - (length(text) - length(translate(text, '#$%&*|!<>{}[]=_~^\', '')))::DOUBLE / greatest(length(text), 1)::DOUBLE) AS quality,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM d),
s AS (
  SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM w GROUP BY source),
c AS (
  SELECT *, CASE n % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
o AS (SELECT *, level * weight >= cap AS full_up FROM l),
t AS (
  SELECT source, source_size, CASE WHEN full_up THEN cap ELSE (SELECT arg_min(level, cap / weight) FROM o WHERE NOT full_up) * weight END AS target FROM o),
k AS (
  SELECT w.doc_id, w.size, t.source_size, t.target,
    coalesce(sum(w.size) OVER (PARTITION BY w.source ORDER BY -ln(u) / quality, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM w JOIN t ON w.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
  (size * epochs + greatest(0, least(size, floor(target - epochs * source_size) - before)))::BIGINT AS taken
FROM k
"""


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS flat FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(flat) AS text_sha256
FROM d WINDOW g AS (PARTITION BY flat)
"""

OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM documents),
wanted AS (
  SELECT DISTINCT item_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM sizes),
lengths AS (SELECT doc_id, 50 + ((50 * n * docs) // words)::BIGINT AS m FROM sizes, whole),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM wanted) GROUP BY 1, 2),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, whole GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM wanted JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id) GROUP BY 1, 2)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_line_dedup": OP8_SQL, "op9_mix_sources": OP9_SQL, "op11_exact_dedup": OP11_SQL, "op12_ranked_search": OP12_SQL}
