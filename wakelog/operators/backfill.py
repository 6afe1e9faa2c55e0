"""Back-fill and upsert: what is missing, where it belongs, and how it is added without doubling."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .events import first_wins
from .store import stored


def missing_pairs(wanted: DataFrame, sorties: DataFrame, have: DataFrame) -> DataFrame:
    """(sortie, signal) that are wanted and not there yet (UPS-1, UPS-6). wanted is a short list of names."""
    return sorties.select("sortie").distinct().crossJoin(wanted.select("signal").distinct()).join(have.select("sortie", "signal").distinct(), ["sortie", "signal"], "left_anti")


#: Recordings that one task compares with each other.
COMPARED = 50_000


def uncovered(recordings: DataFrame) -> DataFrame:
    """(sortie, t_min, t_max): recordings without those within another one's time whose sortie is not larger.

    Such a one never shares more time with anything than the other does, and loses the tie. Tasks leave out what they see
    among at most COMPARED random rows, in rounds, as long as a round leaves out half: so some may stay, none goes wrongly.
    """

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task's recordings without those that lie within one of a smaller or equal sortie."""
        for pdf in [pd.concat(list(batches) or [pd.DataFrame({"sortie": [], "t_min": [], "t_max": []})])]:
            rows = pdf.sort_values(["t_min", "t_max", "sortie"], ascending=[True, False, True])
            # Of the rows so far those that none covers: by end, downwards, their sorties fall.
            ends, names, keep = [], [], []
            for sortie, end in zip(rows["sortie"], rows["t_max"], strict=True):
                # The last one that ends as late has the smallest sortie of all that do.
                at = bisect.bisect_right(ends, -end)
                keep.append(at == 0 or names[at - 1] > sortie)
                if keep[-1]:
                    to = at
                    while to < len(ends) and names[to] >= sortie:
                        to += 1
                    if at and ends[at - 1] == -end:
                        at -= 1
                    ends[at:to], names[at:to] = [-end], [sortie]
            yield rows[keep]

    rows = recordings.select("sortie", "t_min", "t_max")
    plain = F.col("sortie").isNotNull() & (F.col("t_min") <= F.col("t_max")) & ~F.isnan("t_max")
    odd = rows.where(~F.coalesce(plain, F.lit(False)))
    left = stored(rows.where(plain), "recordings")
    n = left.count()
    while n > 1:
        parts = -(-n // COMPARED)
        left = stored(left.repartition(parts).mapInPandas(alone, left.schema), "uncovered")
        before, n = n, left.count()
        if parts == 1 or 2 * n > before:
            break
    return left.unionByName(odd)


def best_overlap(patches: DataFrame, recordings: DataFrame) -> DataFrame:
    """(patch, sortie, overlap_s): the recording that each patch shares most time with; it may be 0, not below -1 (JN-7).

    Both sides have a row for each recording; ties go to the smaller sortie. Recordings that cannot be the best one for any
    patch are left out first (see uncovered), so recordings of one and the same time do not meet in all pairs. Those that
    overlap and none of which lies within another still do.
    """
    recordings = uncovered(recordings)
    # Both meet in bins of the mean recording's length; one second on either side lets near misses meet, too.
    mean = recordings.agg(F.avg(F.col("t_max") - F.col("t_min"))).head()[0] or 0.0
    width = max(1.0, float(mean))
    bins = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - 1) / width), F.floor((F.col(hi) + 1) / width))).alias("bin")
    p = patches.select("patch", F.col("t_min").alias("p_lo"), F.col("t_max").alias("p_hi")).select("*", bins("p_lo", "p_hi"))
    r = recordings.select("sortie", "t_min", "t_max", bins("t_min", "t_max"))
    shared = F.least("p_hi", "t_max") - F.greatest("p_lo", "t_min")
    # Of the bins that a pair shares, the first gives it.
    first = F.greatest(F.floor((F.col("p_lo") - 1) / width), F.floor((F.col("t_min") - 1) / width))
    pairs = p.join(r, "bin").where((shared > -1.0) & (F.col("bin") == first))
    best = pairs.withColumn("o", F.least("p_hi", "t_max") - F.greatest("p_lo", "t_min")).groupBy("patch").agg(F.max(F.col("o")).alias("overlap_s"), F.min_by("sortie", F.struct(-F.col("o"), F.col("sortie"))).alias("sortie"))
    return best.select("patch", "sortie", F.round(F.greatest("overlap_s", F.lit(0.0)), 3).alias("overlap_s"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """old with the rows of new whose keys it lacks; with force the new ones take the place of the old.

    For whole runs over stored tables see wakelog.sources.patches.
    """
    if force:
        return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def rebuild_history(flat: DataFrame, in_episodes: DataFrame) -> DataFrame:
    """Transitions from the flat list and from the episodes, one for each signal and time (SET-5, UPS-3)."""
    cols = ["sortie", "signal", "t", "from_v", "to_v", "ord"]
    both = flat.select(*cols, F.lit(0).alias("_rank")).unionByName(in_episodes.select(*cols, F.lit(1).alias("_rank")))
    return first_wins(both, ["sortie", "signal", "t"], [F.col("_rank"), F.col("ord")]).drop("_rank")
