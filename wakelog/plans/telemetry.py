"""Telemetry derived from the given tables: events as sorties with channels, lineitem as profiles, part as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators.episodes import extract_episodes

#: Event types in the order of their codes.
KINDS = ["click", "error", "purchase", "signup", "view"]
#: A day: events are sparse, so look-back, tail and gaps count in days.
DAY = 86_400.0


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    # Independent of the session's time zone, as the column has none.
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts AS TIMESTAMP_NTZ))") / F.lit(1e6)
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("event_type")) - 1
    return e.select(F.col("user_id").cast("string").alias("sortie"), F.lit("events").alias("source"), t.alias("t"), F.col("event_id").alias("ord"), (F.col("event_type") == "error").cast("double").alias("err"), kind.cast("double").alias("kind"), "value", "event_type")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.to_long(raw(spark, sf_dir), ["sortie", "source", "t", "ord"], ["err", "kind", "value"])


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    cols = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    day = F.expr("datediff(cast(l_shipdate AS DATE), DATE '1970-01-01')").cast("double")
    ids = li.select(F.col("l_suppkey").cast("string").alias("sortie"), F.lit("lineitem").alias("source"), day.alias("t"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), *cols)
    return ev.to_long(ids, ["sortie", "source", "t", "ord"], cols)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions of the two small channels; their class is known, so the samples are read once."""
    s = samples(spark, sf_dir).where(F.col("signal") != "value")
    return ev.transitions(s, mode="all")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_episodes(found(spark, sf_dir), "err", 0.0, 1.0, DAY)


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).where(F.col("signal") == "kind")
    return ev.mode_transitions(found(spark, sf_dir), ev.first_samples(s), {"kind": "lat"})


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = load(spark, sf_dir, "part")
    nodes = p.select(F.col("p_partkey").cast("string").alias("key"), F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("blockName"), F.col("p_type").alias("blockType"), F.col("p_brand").alias("model"), (F.col("p_size") % 3 == 0).alias("isTestPoint"), F.lit(None).cast("string").alias("testPointName"))
    edges = p.where("p_partkey > 0").select(F.col("p_partkey").cast("string").alias("srcKey"), F.expr("p_partkey div 2").cast("string").alias("dstKey"))
    return nodes, edges
