"""Fleet correlation, peaks, distributions, status and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import dt_samples, exclude_signals, suffix, with_signal_parts
from .modes import modes_at
from .store import stored

#: Signals left out of the ranking.
EXCLUDED = ["enforceStandby", "*Capable", "*ActiveEnum*", "atActCmdMode", "afcsEngage*", "afcsEngOrCws", "fgAndAp", "*Engaged*", "*Arm*Enum*", "ydEnabled", "atCmdEng", "apOr", "limitMinusMargin", "apNoMonitorTrip", "atNoMonitorTrip"]


def correlate(episodes: DataFrame, found: DataFrame, key: str = "signal", pre: float = 5.0, post: float = 1.0, min_freq: float = 0.05, top: int | None = 100, hz: float = 40.0, exclude: list[str] | None = None) -> DataFrame:
    """Signals that change near episode starts, ranked (AGG-8): score = frequency e^(-|mean|/2) e^(-deviation/2).

    found: (sortie, episode, key, dt, from_v, to_v, ord). Seconds have 3 places and samples come from those; the share of
    episodes is filtered after rounding to 4. exclude: wildcards over the last part of the key.
    """
    near = found.where((F.col("dt") >= -pre) & (F.col("dt") <= post))
    if exclude:
        near = exclude_signals(near, exclude, key)
    # Written once; counts and times are different groupings of the same rows.
    near = stored(near.select(key, "sortie", "episode", "dt"), "near")
    total = episodes.select("sortie", "episode").distinct().agg(F.count("*").alias("all_episodes"))
    # Episodes are counted from pre-aggregated pairs; the deviation from the values, so that nothing cancels.
    counts = near.groupBy(key, "sortie", "episode").agg(F.lit(1)).groupBy(key).agg(F.count("*").alias("n_episodes"), F.count_distinct("sortie").alias("n_sorties"))
    times = near.groupBy(key).agg(F.avg("dt").alias("_mean"), F.stddev_pop("dt").alias("_std"))
    scored = counts.join(times, key).crossJoin(F.broadcast(total)).withColumn("_f", F.col("n_episodes") / F.col("all_episodes"))
    out = scored.select(
        key, F.round(F.col("_f") * F.exp(-F.abs("_mean") / 2) * F.exp(-F.col("_std") / 2), 4).alias("score"), F.round("_f", 4).alias("frequency"), "n_episodes", "n_sorties",
        F.round("_mean", 3).alias("mean_dt_s"), F.round("_std", 3).alias("std_dt_s"),
    ).where(F.col("frequency") >= min_freq).withColumns({"mean_dt_samples": dt_samples(F.col("mean_dt_s"), hz), "std_dt_samples": dt_samples(F.col("std_dt_s"), hz)})
    return out if top is None else out.orderBy(F.desc("score"), key).limit(top)


def fleet_correlation(episodes: DataFrame, found: DataFrame, key_mode: str = "suffix", pre: float = 5.0, post: float = 1.0, min_freq: float = 0.05, top: int | None = 100, hz: float = 40.0, exclude: list[str] | None = None) -> DataFrame:
    """Correlation as a report has it: rank, signal, model and key beside the figures, and the common direction.

    found has full signal names; key_mode is with_signal_parts's. exclude: EXCLUDED if none is given, [] for nothing.
    """
    keyed = with_signal_parts(found, "signal", key_mode)
    scored = correlate(episodes, keyed, "norm_key", pre, post, min_freq, top, hz, EXCLUDED if exclude is None else exclude)
    whole = scored.join(common_direction(keyed, "norm_key", pre=pre, post=post), "norm_key", "left")
    rank = F.row_number().over(W.orderBy(F.desc("score"), "norm_key"))
    signal, model = F.regexp_extract("norm_key", r"^([^.]*\.)?(.*)$", 2), F.regexp_extract("norm_key", r"^([^.]*)\.", 1)
    return whole.select(rank.alias("place"), signal.alias("signal"), model.alias("model"), F.col("norm_key").alias("key"), *[c for c in whole.columns if c != "norm_key"])


def common_direction(found: DataFrame, key: str = "signal", first: int = 200, pre: float | None = None, post: float | None = None) -> DataFrame:
    """The commonest from and to over the first occurrences of each key; of equals the one seen first (AGG-9).

    pre and post bound the seconds around the trigger in which occurrences count, as in correlate.
    """
    order = ["sortie", "episode", "ord"]
    near = found if pre is None else found.where((F.col("dt") >= -pre) & (F.col("dt") <= post))
    rows = near.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_n") <= first)

    def mode(side: str) -> DataFrame:
        counts = rows.where(F.col(side).isNotNull()).groupBy(key, side).agg(F.count("*").alias("c"), F.min("_n").alias("m"))
        return counts.groupBy(key).agg(F.max_by(side, F.struct(F.col("c"), -F.col("m"))).alias(f"common_{side.removesuffix('_v')}"))

    return mode("from_v").join(mode("to_v"), key, "full")


def peak_values(samples: DataFrame, pick: Column, modes: DataFrame | None = None) -> DataFrame:
    """(sortie, signal, peak, peak_time[, modes]): the largest value, its first time, the modes then (AGG-7)."""
    peaks = samples.where(pick).groupBy("sortie", "signal").agg(F.max_by(F.struct("v", "t", "ord"), F.struct(F.col("v"), -F.col("t"), -F.col("ord"))).alias("p")).select("sortie", "signal", F.round("p.v", 2).alias("peak"), F.col("p.t").alias("t"), F.col("p.ord").alias("ord"))
    out = peaks.select("sortie", "signal", "peak", F.round("t", 3).alias("peak_time"))
    if modes is None:
        return out
    at = modes_at(peaks.select("sortie", "t", "ord", F.col("signal").alias("probe")), modes).groupBy("sortie", "probe").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("axis", "mode")))).alias("modes"))
    return out.join(at.withColumnRenamed("probe", "signal"), ["sortie", "signal"], "left")


def peak_torque(samples: DataFrame, modes: DataFrame | None = None) -> DataFrame:
    s = F.lower(suffix(F.col("signal")))
    return peak_values(samples, s.contains("torq") & ~s.contains("lim"), modes)


def overtorque(peaks: DataFrame, limits: DataFrame) -> DataFrame:
    """Peaks over their limit, with the use in percent; limits: (signal, limit) (AGG-18)."""
    used = peaks.join(limits, "signal").withColumn("used_pct", F.round(100 * F.col("peak") / F.col("limit"), 1))
    return used.where(F.col("peak") > F.col("limit"))


def fault_distribution(classified: DataFrame) -> DataFrame:
    """Episodes, share and sorties of each category (AGG-10)."""
    g = classified.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("sortie").alias("n_sorties"))
    return g.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 1))


def fault_mode_matrix(classified: DataFrame, modes: DataFrame) -> DataFrame:
    """Counts by category, axis and mode in force, with subtotals (AGG-17)."""
    at = modes_at(classified.select("sortie", F.col("start_t").alias("t"), F.lit(2**62).alias("ord"), F.struct("episode", "category").alias("probe")), modes)
    return at.select(F.col("probe.category").alias("category"), "axis", "mode").cube("category", "axis", "mode").agg(F.count("*").alias("n"))


def run_profile(manifest: DataFrame) -> DataFrame:
    """Median, longest and banded run times (AGG-12)."""
    t = F.col("elapsed_s")
    band = lambda c: F.count(F.when(c, 1))
    return manifest.agg(F.count("*").alias("n"), F.round(F.percentile(t, 0.5), 4).alias("median_s"), F.max(t).alias("max_s"), band(t <= 100).alias("n_short"), band((t > 100) & (t <= 300)).alias("n_medium"), band(t > 300).alias("n_long"))


def batch_status(files: DataFrame, episodes: DataFrame) -> DataFrame:
    """Done, pending and done without episodes, with the share done; files: (sortie, done) (AGG-13)."""
    with_any = episodes.select("sortie").distinct().withColumn("_has", F.lit(1))
    j = files.join(with_any, "sortie", "left")
    n = lambda c: F.count(F.when(c, 1))
    return j.agg(F.count("*").alias("n"), n(F.col("done")).alias("n_done"), n(~F.col("done")).alias("n_pending"), n(F.col("done") & F.col("_has").isNull()).alias("n_quiet"), F.round(100.0 * n(F.col("done")) / F.count("*"), 1).alias("done_pct"))


def fleet_summary(recordings: DataFrame, episodes: DataFrame, phases: DataFrame, gaps: DataFrame, auto_landings: DataFrame | None = None) -> DataFrame:
    """(measure, n): totals of the fleet, also of auto-landings if they are given (AGG-14)."""
    one = lambda df, name, e: df.agg(e.alias("n")).select(F.lit(name).alias("measure"), "n")
    parts = [one(recordings, "sorties", F.count_distinct("sortie")), one(episodes, "faults", F.count("*")), one(episodes, "sorties_affected", F.count_distinct("sortie")), one(gaps, "gaps", F.count("*"))]
    parts += [] if auto_landings is None else [one(auto_landings, "auto_landings", F.count("*"))]
    out = reduce(DataFrame.unionByName, parts)
    return out.unionByName(phases.groupBy(F.concat(F.lit("phase_"), "phase").alias("measure")).agg(F.count("*").alias("n")))


def exposure(episodes: DataFrame, recordings: DataFrame) -> DataFrame:
    """(n_episodes, n_sorties, pct): how many sorties had how many episodes (AGG-15)."""
    per = recordings.select("sortie").distinct().join(episodes.groupBy("sortie").agg(F.count("*").alias("c")), "sortie", "left").select(F.coalesce("c", F.lit(0)).alias("n_episodes"))
    g = per.groupBy("n_episodes").agg(F.count("*").alias("n_sorties"))
    return g.withColumn("pct", F.round(100.0 * F.col("n_sorties") / F.sum("n_sorties").over(W.partitionBy()), 1))


def ops_per_sortie(phases: DataFrame, gaps: DataFrame, names: list[str]) -> DataFrame:
    """A column for each phase with how often a sortie had it, and its gaps (AGG-16)."""
    p = phases.groupBy("sortie").pivot("phase", names).agg(F.count(F.lit(1))).fillna(0, names)
    return p.join(gaps.groupBy("sortie").agg(F.count("*").alias("gaps")), "sortie", "full").fillna(0, [*names, "gaps"])


def concurrent(found: DataFrame, most: int = 10) -> DataFrame:
    """The transitions nearest in time to the trigger of each episode, the trigger left out (JN-5, TOP-2)."""
    by = W.partitionBy("sortie", "episode").orderBy(F.abs("dt"), "ord", "signal")
    return found.where("role <> 'trigger'").withColumn("place", F.row_number().over(by)).where(F.col("place") <= most)


def gaps_before(episodes: DataFrame, gaps: DataFrame, pre: float = 5.0, width: float | None = None) -> DataFrame:
    """Episodes whose look-back meets a gap, with the number and seconds of those gaps (JN-12).

    Both meet in bins of time, width wide (the look-back, if not given, but a minute at least), so no sortie is paired whole.
    """
    w = max(60.0, pre) if width is None else width
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / w), F.floor(hi / w)))
    # A second on either side, as a difference may round otherwise than a sum.
    e = episodes.select("sortie", "episode", "start_t").withColumn("_bin", bins(F.col("start_t") - pre - 1, F.col("start_t") + 1))
    g = gaps.select("sortie", "t_start", "t_end", "duration_s", bins(F.col("t_start"), F.col("t_end")).alias("_bin"))
    meet = (F.col("t_start") <= F.col("start_t")) & (F.col("start_t") - F.col("t_end") <= pre)
    # Of the bins that a pair shares the first gives it.
    first = F.greatest(F.floor((F.col("start_t") - pre - 1) / w), F.floor(F.col("t_start") / w)) == F.col("_bin")
    hit = e.join(g, ["sortie", "_bin"]).where(meet & first)
    return hit.groupBy("sortie", "episode").agg(F.count("*").alias("n_gaps"), F.round(F.sum("duration_s"), 3).alias("gap_s"))


def lane_listing(found: DataFrame) -> DataFrame:
    """Transitions of an episode numbered within each lane, flight-control lanes first (JN-13); needs the column lane."""
    rank = F.coalesce(F.when(F.col("lane") == "FCC1A", 0).when(F.col("lane") == "FCC1B", 1), F.lit(2))
    return found.withColumn("lane_rank", rank).withColumn("place", F.row_number().over(W.partitionBy("sortie", "episode", "lane").orderBy("t", "ord", "signal")))
