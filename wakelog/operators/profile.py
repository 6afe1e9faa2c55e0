"""Channel statistics and classes, recording extents, sample and context rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ENUM_MAX = 64
KEYS = ["sortie", "source", "signal"]


def channel_stats(samples: DataFrame, enum_max: int = ENUM_MAX) -> DataFrame:
    """One row a channel: n, total, least, most, the first time of the most, whether all are 0/1 or whole, distinct values.

    n_distinct is exact for channels of whole numbers and null for others, whose class does not depend on it (AGG-1).
    Samples are read once: they are added up by channel and whole value, all others of a channel being one such group, and
    then by channel. Rows that share value and ord are taken as the later in time for t_max_v.
    """
    whole = F.when(F.col("v") == F.floor("v"), F.col("v"))
    top = F.max(F.struct("v", -F.col("ord"), "t")).alias("top")
    parts = samples.withColumn("_whole", whole).groupBy(*KEYS, "_whole").agg(
        F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("min_v"), F.max("v").alias("max_v"), top,
        F.count(F.when(F.col("v") == 1, 1)).alias("n_active"), F.max((~F.col("v").isin(0.0, 1.0)).cast("int")).alias("has_non_bool"),
    )
    out = parts.groupBy(*KEYS).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("min_v").alias("min_v"), F.max("max_v").alias("max_v"), F.max("top").alias("top"),
        F.sum("n_active").alias("n_active"), F.max("has_non_bool").alias("has_non_bool"), F.min(F.col("_whole").isNotNull().cast("int")).alias("all_integer"), F.count("_whole").alias("_values"),
    )
    n_distinct = F.when(F.col("all_integer") == 1, F.col("_values")).alias("n_distinct")
    return out.select(*KEYS, "n", "total", "min_v", "max_v", F.col("top.t").alias("t_max_v"), "n_active", "has_non_bool", "all_integer", n_distinct, F.lit(enum_max).alias("enum_max"))


def classify_channels(stats: DataFrame) -> DataFrame:
    """bool, enum (whole numbers, few of them) or num; channels without samples have no row (AGG-2)."""
    kind = F.when(F.col("has_non_bool") == 0, "bool").when((F.col("all_integer") == 1) & (F.col("n_distinct") <= F.col("enum_max")), "enum").otherwise("num")
    return stats.withColumn("class", kind)


def channel_summary(samples: DataFrame, enum_max: int = ENUM_MAX) -> DataFrame:
    """Per channel: class, active share of bools, sorted values of enums, least, most and mean of the rest (AGG-3)."""
    c = classify_channels(channel_stats(samples, enum_max))
    few = c.where(F.col("class") == "enum").select(*KEYS)
    values = samples.join(few, KEYS, "left_semi").select(*KEYS, F.col("v").cast("long").alias("v")).distinct().groupBy(*KEYS).agg(F.array_sort(F.collect_list("v")).alias("values"))
    is_num, is_bool = F.col("class") == "num", F.col("class") == "bool"
    return c.join(values, KEYS, "left").select(
        *KEYS, "class", "n", F.when(is_bool, F.col("n_active")).alias("n_active"), F.when(is_bool, F.round(100.0 * F.col("n_active") / F.col("n"), 1)).alias("active_pct"), "values",
        *[F.when(is_num, F.round(e, 4)).alias(a) for a, e in (("min", F.col("min_v")), ("max", F.col("max_v")), ("mean", F.col("total") / F.col("n")))],
    )


def recording_extent(raw: DataFrame) -> DataFrame:
    """Rows, first and last time and duration of each sortie and source (AGG-4)."""
    return raw.groupBy("sortie", "source").agg(F.count("*").alias("total_rows"), F.round(F.min("t"), 3).alias("t_min"), F.round(F.max("t"), 3).alias("t_max"), F.round(F.max("t") - F.min("t"), 2).alias("duration_s"))


def merged_extent(extents: DataFrame) -> DataFrame:
    return extents.groupBy("sortie").agg(F.sum("total_rows").alias("total_rows"), F.min("t_min").alias("rec_start_s"), F.round(F.max("t_max") - F.min("t_min"), 2).alias("duration_s"))


def sample_rows(raw: DataFrame, head: int = 10, tail: int = 12) -> DataFrame:
    """The first and last rows of each source (AGG-5)."""
    w = W.partitionBy("sortie", "source")
    up, down = F.row_number().over(w.orderBy("ord")), F.row_number().over(w.orderBy(F.desc("ord")))
    return raw.withColumns({"_up": up, "_down": down}).where((F.col("_up") <= head) | (F.col("_down") <= tail)).withColumn("part", F.when(F.col("_up") <= head, "head").otherwise("tail")).drop("_up", "_down")


def context_rows(raw: DataFrame, transitions: DataFrame, before: int = 0, after: int = 5) -> DataFrame:
    """Rows around the first transition of each source, by place in the file (AGG-6)."""
    placed = raw.withColumn("place", F.row_number().over(W.partitionBy("sortie", "source").orderBy("ord")))
    first = transitions.groupBy("sortie", "source").agg(F.min("ord").alias("first_ord"))
    at = placed.join(first, ["sortie", "source"]).where(F.col("ord") == F.col("first_ord")).select("sortie", "source", F.col("place").alias("at"))
    return placed.join(at, ["sortie", "source"]).where(F.col("place").between(F.col("at") - before, F.col("at") + after)).drop("at", "place")
