"""Fault episodes around a trigger signal, their transitions, the fallback trigger, and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import signal_matches
from .chains import greedy_chain
from .events import first_wins
from .store import stored


def extract_episodes(found: DataFrame, signal: str, from_v: float = 1.0, to_v: float = 0.0, tail: float = 3.0) -> DataFrame:
    """(sortie, episode, trigger_signal, start_t, start_ord, end_t, end_ord, duration_s), numbered by time (WIN-3).

    A trigger edge opens an episode; the first opposite edge of the same full signal ends it. Edges inside an open episode
    or up to ``tail`` seconds after its end are swallowed. Without a return the end is null and the scan ends. Of edges at
    one time the smaller ord, then signal, comes first. No edge gives no row.

    Each trigger edge finds its return in one window; which edges open an episode is a greedy chain over them, by pointers
    (see greedy_chain), so no sortie's edges are gathered.
    """
    fits = signal_matches(F.col("signal"), signal)
    opens, closes = (F.col("from_v") == from_v) & (F.col("to_v") == to_v), (F.col("from_v") == to_v) & (F.col("to_v") == from_v)
    edges = found.where(fits & (opens | closes)).select("sortie", "signal", "t", "ord", opens.alias("opens"))
    # Backwards in time, so that the frame runs along: the last return seen is the next one.
    later = W.partitionBy("sortie", "signal").orderBy(F.desc("t"), F.desc("ord")).rowsBetween(W.unboundedPreceding, -1)
    back = F.last(F.when(~F.col("opens"), F.struct("t", "ord")), ignorenulls=True).over(later)
    starts = edges.withColumn("back", back).where("opens").select("sortie", "signal", "t", "ord", F.col("back.t").alias("reach"), F.col("back.ord").alias("end_ord"))
    kept = greedy_chain(starts, ["sortie"], ["ord", "signal"], tail)
    number = F.row_number().over(W.partitionBy("sortie").orderBy("t", "ord"))
    return kept.select("sortie", number.alias("episode"), F.col("signal").alias("trigger_signal"), F.col("t").alias("start_t"), F.col("ord").alias("start_ord"), F.col("reach").alias("end_t"), "end_ord", F.round(F.col("reach") - F.col("t"), 2).alias("duration_s"))


def episode_transitions(episodes: DataFrame, found: DataFrame, pre: float = 5.0, tail: float = 3.0) -> DataFrame:
    """The transitions of each episode with dt and role: pre, trigger, during or tail (WIN-4)."""
    e = episodes.select("sortie", "episode", "trigger_signal", "start_t", "start_ord", "end_t", "end_ord")
    # Closed episodes and transitions meet in bins of time; a sortie has one open episode at most.
    width = 4 * (pre + tail) + 1
    closed = e.where("end_t is not null").withColumn("bin", F.explode(F.sequence(F.floor((F.col("start_t") - pre) / width), F.floor((F.col("end_t") + tail) / width))))
    binned = found.withColumn("bin", F.floor(F.col("t") / width)).join(closed, ["sortie", "bin"]).drop("bin")
    both = binned.unionByName(found.join(e.where("end_t is null"), "sortie"))
    order = lambda t, o: F.struct(F.col(t), F.col(o))
    at = F.struct(F.col("t"), F.col("ord"))
    is_trigger = (F.col("ord") == F.col("start_ord")) & (F.col("signal") == F.col("trigger_signal"))
    before = (at < order("start_t", "start_ord")) & (F.col("start_t") - F.col("t") <= pre)
    until = F.col("end_t").isNull() | (at <= order("end_t", "end_ord"))
    role = F.when(is_trigger, "trigger").when(before, "pre").when((at >= order("start_t", "start_ord")) & until, "during").when((at > order("end_t", "end_ord")) & (F.col("t") - F.col("end_t") <= tail), "tail")
    return both.withColumn("role", role).where("role is not null").select("sortie", "episode", "signal", "t", (F.col("t") - F.col("start_t")).alias("dt"), "from_v", "to_v", "role", "ord")


def with_fallback(episodes: DataFrame, found: DataFrame, fallback_signal: str = "sysNotEngage", tail: float = 3.0) -> DataFrame:
    """episodes with is_fallback; sorties without any get those of the fallback signal's 0 to 1 edges (WIN-5)."""
    rest = found.join(episodes.select("sortie").distinct(), "sortie", "left_anti")
    more = extract_episodes(rest, fallback_signal, 0.0, 1.0, tail)
    return episodes.withColumn("is_fallback", F.lit(False)).unionByName(more.withColumn("is_fallback", F.lit(True)))


def _within(rows: DataFrame, of: DataFrame, tolerance: float, how: str) -> DataFrame:
    """rows (sortie, start_t, ...) joined with those of another table (sortie, m_start_t, ...) whose starts differ by less than tolerance."""
    spread = of.withColumn("_bin", F.explode(F.sequence(*[(F.floor(F.col("m_start_t") / tolerance) + i) for i in (-1, 1)]))).withColumnRenamed("sortie", "m_sortie")
    binned = rows.withColumn("_at", F.floor(F.col("start_t") / tolerance))
    near = (F.col("sortie") == F.col("m_sortie")) & (F.col("_at") == F.col("_bin")) & (F.abs(F.col("start_t") - F.col("m_start_t")) < tolerance)
    return binned.join(spread, near, how).drop("_at", "_bin", "m_sortie")


def merge_groups(episodes: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """episodes (sortie, rank, episode, start_t, ...) of several result sets with m_rank, m_episode: the kept one each belongs to (JN-6).

    rank is the place of the result set in the list, and a set's episodes are in time. The earliest listed is kept and takes
    all that start less than tolerance from it, then the next one that is left, and so on; so A and C may be kept apart
    though B, between them, is near to both. Episodes without a start stay by themselves. (sortie, rank, episode) is a key.

    Sets are gone through one after the other (there are few); inside a set the kept ones are a greedy chain, by pointers.
    """
    timed = stored(episodes.where("start_t is not null"), "listed")
    kept = None
    for (rank,) in timed.select("rank").distinct().orderBy("rank").collect():
        own = timed.where(F.col("rank") == rank).select("sortie", "rank", "episode", "start_t")
        free = own if kept is None else _within(own, kept.select("sortie", F.col("start_t").alias("m_start_t")), tolerance, "left_anti")
        new = greedy_chain(free.withColumns({"t": F.col("start_t"), "reach": F.col("start_t")}), ["sortie"], ["episode"], tolerance, False).drop("t", "reach")
        kept = new if kept is None else kept.unionByName(new)
    alone = episodes.where("start_t is null").withColumns({"m_rank": F.col("rank"), "m_episode": F.col("episode")})
    if kept is None:
        return alone
    heads = stored(kept, "kept").select("sortie", F.struct(F.col("rank"), F.col("start_t"), F.col("episode")).alias("m"), F.col("start_t").alias("m_start_t"))
    first = _within(timed.select("sortie", "rank", "episode", "start_t"), heads, tolerance, "inner").groupBy("sortie", "rank", "episode").agg(F.min("m").alias("m"))
    grouped = timed.join(first, ["sortie", "rank", "episode"]).withColumns({"m_rank": F.col("m.rank"), "m_episode": F.col("m.episode")}).drop("m")
    return grouped.unionByName(alone)


def merge_episodes(groups: DataFrame) -> DataFrame:
    """The kept episodes of merge_groups as they were, with n_merged: how many episodes each stands for, itself included."""
    size = groups.groupBy("sortie", "m_rank", "m_episode").agg(F.count("*").alias("n_merged"))
    heads = groups.where((F.col("rank") == F.col("m_rank")) & (F.col("episode") == F.col("m_episode")))
    return heads.join(size, ["sortie", "m_rank", "m_episode"]).drop("m_rank", "m_episode")


def merge_members(groups: DataFrame, rows: DataFrame, once: list[str]) -> DataFrame:
    """rows (sortie, rank, episode, ...) of all members under the kept episode's rank and episode; of equal ``once`` columns the first listed stays.

    For transitions, once is signal and t; for plots it is the signal, of which a member gives all its points: then rows
    hold one a signal, with the points nested. The member that a row came from is in from_rank and from_episode.
    """
    of = groups.select("sortie", "rank", "episode", "start_t", "m_rank", "m_episode")
    both = rows.join(of, ["sortie", "rank", "episode"]).withColumnsRenamed({"rank": "from_rank", "episode": "from_episode"}).withColumnsRenamed({"m_rank": "rank", "m_episode": "episode"})
    # The kept one comes before its members, even those of its own set.
    head = (F.col("from_rank") == F.col("rank")) & (F.col("from_episode") == F.col("episode"))
    tie = [F.col("ord")] if "ord" in rows.columns else []
    return first_wins(both, ["sortie", "rank", "episode", *once], [F.desc(head), F.col("from_rank"), F.col("start_t"), F.col("from_episode"), *tie]).drop("start_t")
