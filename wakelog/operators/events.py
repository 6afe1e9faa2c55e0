"""Transitions, data gaps, mode and signal histories, and the set operations that merge sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import suffix
from .profile import ENUM_MAX, KEYS, channel_stats, classify_channels

#: The suffixes of mode channels, and the axis that each belongs to.
MODE_SUFFIXES = {"latActive": "lat", "vertActive": "vert", "atActive": "at", "latActiveEnum": "lat", "vertActiveEnum": "vert", "atActiveEnum": "at"}


def to_long(raw: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """Wide to long, with the header position as col_ord; one generator, whatever the number of columns (PRJ-1)."""
    cells = F.array(*[F.struct(F.lit(i).alias("col_ord"), F.lit(c).alias("signal"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)])
    return raw.select(*ids, F.explode(cells).alias("x")).select(*ids, "x.*").where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))


def trim_leading(raw: DataFrame, t: str = "t") -> DataFrame:
    """Without the rows of each source before the first with a time (PRJ-10)."""
    first = F.min(F.when(F.col(t).isNotNull(), F.col("ord"))).over(W.partitionBy("sortie", "source"))
    return raw.withColumn("_first", first).where(F.col("ord") >= F.col("_first")).drop("_first")


def transitions(samples: DataFrame, channels: DataFrame | None = None, enum_max: int = ENUM_MAX, mode: str = "global") -> DataFrame:
    """Value changes of bool and enum channels against the last finite value (WIN-1).

    mode global: by the class of the whole channel. mode prefix: by what the channel has shown up to each row. mode all:
    every channel counts, as their classes are known to be such; nothing is joined.
    """
    by = W.partitionBy(*KEYS).orderBy("ord")
    if mode == "prefix":
        so_far = by.rowsBetween(W.unboundedPreceding, 0)
        new = samples.withColumn("_new", (F.row_number().over(W.partitionBy(*KEYS, "v").orderBy("ord")) == 1).cast("int"))
        few = (F.min((F.col("v") == F.floor("v")).cast("int")).over(so_far) == 1) & (F.sum("_new").over(so_far) <= enum_max)
        rows = new.withColumn("_ok", few | (F.max((~F.col("v").isin(0.0, 1.0)).cast("int")).over(so_far) == 0))
    elif mode == "all":
        rows = samples.withColumn("_ok", F.lit(True))
    else:
        known = channels if channels is not None else classify_channels(channel_stats(samples, enum_max))
        rows = samples.join(known.where(F.col("class").isin("bool", "enum")).select(*KEYS), KEYS, "left_semi").withColumn("_ok", F.lit(True))
    changed = rows.withColumn("from_v", F.lag("v").over(by)).where(F.col("_ok") & (F.col("from_v") != F.col("v")))
    return changed.select(*KEYS, "t", "from_v", F.col("v").alias("to_v"), "ord")


def data_gaps(raw: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Neighbouring times of a source that are over threshold apart (WIN-2)."""
    times = raw.where(F.col("t").isNotNull()).withColumn("_before", F.lag("t").over(W.partitionBy("sortie", "source").orderBy("ord")))
    d = F.col("t") - F.col("_before")
    return times.where(d > threshold).select("sortie", "source", F.round("_before", 3).alias("t_start"), F.round("t", 3).alias("t_end"), F.round(d, 3).alias("duration_s"))


def mode_transitions(found: DataFrame, firsts: DataFrame, suffixes: dict[str, str] | None = None) -> DataFrame:
    """Transitions of mode channels with an anchor: the value at the start, from = to (WIN-6).

    firsts: (sortie, source, signal, t, v, ord), the first sample of each channel.
    """
    axis = F.create_map(*[F.lit(x) for kv in (suffixes or MODE_SUFFIXES).items() for x in kv])
    of = lambda df: df.withColumn("axis", F.try_element_at(axis, suffix(F.col("signal")))).where("axis is not null")
    changes = of(found).select("sortie", "signal", "axis", "t", "from_v", "to_v", F.lit(False).alias("is_anchor"), "ord")
    anchors = of(firsts).select("sortie", "signal", "axis", "t", F.col("v").alias("from_v"), F.col("v").alias("to_v"), F.lit(True).alias("is_anchor"), "ord")
    return changes.unionByName(anchors)


def first_samples(samples: DataFrame) -> DataFrame:
    first = samples.groupBy(*KEYS).agg(F.min(F.struct("ord", "t", "v")).alias("f"))
    return first.select(*KEYS, "f.t", "f.v", "f.ord")


def signal_history(found: DataFrame, pattern: str = "sysnotengage") -> DataFrame:
    """Transitions of signals whose suffix matches, in any case (WIN-7)."""
    return found.where(suffix(F.col("signal")).rlike(f"(?i){pattern}"))


def first_wins(rows: DataFrame, keys: list[str], rank: list[Column]) -> DataFrame:
    """One row a key: the first by rank (SET-1, SET-2). Deterministic, unlike dropDuplicates."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*rank))).where("_n = 1").drop("_n")


def merge_transitions(rows: DataFrame, source_rank: Column) -> DataFrame:
    """Transitions of all sources, one for each signal and time: that of the first source (SET-1).

    Few share a key, so they are moved before they are sorted: sorted on both sides, a task would hold them twice. The
    time is left out of the move, as the window takes it in another form and would move the rows again.
    """
    return first_wins(rows.repartition("sortie", "signal"), ["sortie", "signal", "t"], [source_rank, F.col("ord")])


def merge_gaps(gaps: DataFrame, dedupe: bool = False) -> DataFrame:
    """Gaps of all sources; with dedupe their union as intervals (SET-4)."""
    if not dedupe:
        return gaps
    by = W.partitionBy("sortie").orderBy("t_start", "t_end")
    reach = F.max("t_end").over(by.rowsBetween(W.unboundedPreceding, -1))
    island = gaps.withColumn("_new", F.coalesce((F.col("t_start") > reach).cast("int"), F.lit(1))).withColumn("_island", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy("sortie", "_island").agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end")).select("sortie", "t_start", "t_end", F.round(F.col("t_end") - F.col("t_start"), 3).alias("duration_s"))


def gap_summary(gaps: DataFrame) -> DataFrame:
    """Number and seconds of gaps by sortie and source, with subtotals (AGG-20)."""
    return gaps.rollup("sortie", "source").agg(F.count("*").alias("n_gaps"), F.round(F.sum("duration_s"), 2).alias("gap_s"))
