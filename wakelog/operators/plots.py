"""Cut windows out of signals and thin them: uniform and min-max down-sampling, episode, flight and takeoff plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import suffix
from .modes import APPROACH_LANDING, TAKEOFF, phase_window

#: Positions, of which zero means that there is none.
GNSS = ("GNSS_Latitude", "GNSS_Latitude_Fine", "GNSS_Longitude", "GNSS_Longitude_Fine")


def _indexed(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points with their place k in the series and its length n, from one sort. Rows that share t and ord go by value."""
    by = W.partitionBy(*keys).orderBy("t", "ord", "v")
    return points.withColumns({"k": F.row_number().over(by) - 1, "n": F.count("*").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))})


def downsample_uniform(points: DataFrame, keys: list[str], max_pts: int = 500) -> DataFrame:
    """Points int(i * n / max_pts) of each series with more than max_pts points (WIN-10).

    Point k is chosen if some whole i has k <= i * n / max_pts < k + 1: decided per row, without a join.
    """
    i = F.ceil(F.col("k") * max_pts / F.col("n"))
    chosen = (i < max_pts) & (F.floor(i * F.col("n") / max_pts) == F.col("k"))
    return _indexed(points, keys).where((F.col("n") <= max_pts) | chosen).drop("k", "n")


def downsample_minmax(points: DataFrame, keys: list[str], max_pts: int = 2000) -> DataFrame:
    """The least and the largest point of each of max_pts // 2 equal buckets of series with more points (WIN-11).

    At equal values the earlier point stands for its bucket; where both are one point it is given once.
    """
    b = max(1, max_pts // 2)
    step = F.col("n") / F.lit(b)
    guess = F.floor(F.col("k") / step)
    bucket = F.when(F.floor((guess + 1) * step) <= F.col("k"), guess + 1).when(F.floor(guess * step) > F.col("k"), guess - 1).otherwise(guess)
    # Short series have a bucket for each point, so that one pass serves both.
    many = F.col("n") > max_pts
    placed = _indexed(points, keys).withColumn("bucket", F.when(many, bucket).otherwise(F.col("k"))).where(~many | (F.col("bucket") < b))
    point = F.struct("t", "v", "ord")
    ends = placed.groupBy(*keys, "bucket").agg(F.min_by(point, F.struct("v", "k")).alias("lo"), F.max_by(point, F.struct(F.col("v"), -F.col("k"))).alias("hi"))
    return ends.select(*keys, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("p")).select(*keys, "p.*")


def merge_points(sources: list[DataFrame]) -> DataFrame:
    """Points of several sources as one series a signal, with their place in time; of equal times the smaller source's first (SET-3)."""
    every = sources[0]
    for more in sources[1:]:
        every = every.unionByName(more)
    return every.withColumn("place", F.row_number().over(W.partitionBy("sortie", "signal").orderBy("t", "source", "ord")))


def episode_plots(episodes: DataFrame, samples: DataFrame, margin: float = 30.0, max_pts: int | None = 500) -> DataFrame:
    """(sortie, episode, signal, t, v, ord): samples within margin of each episode, thinned (JN-2).

    Episodes and samples meet in bins of time, so a long sortie is not paired whole with each of its episodes.
    """
    width = 2 * margin + 1
    e = episodes.select("sortie", "episode", (F.col("start_t") - margin).alias("lo"), (F.coalesce("end_t", "start_t") + margin).alias("hi"))
    binned = e.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    hit = samples.withColumn("bin", F.floor(F.col("t") / width)).join(binned, ["sortie", "bin"]).where(F.col("t").between(F.col("lo"), F.col("hi")))
    points = hit.select("sortie", "episode", "signal", "t", "v", "ord")
    return points if max_pts is None else downsample_uniform(points, ["sortie", "episode", "signal"], max_pts)


def _windowed(samples: DataFrame, window: DataFrame, before: float, after: float, whole: bool) -> DataFrame:
    w = window.select("sortie", (F.col("t_lo") - before).alias("lo"), (F.col("t_hi") + after).alias("hi"))
    inside = F.col("t").between(F.col("lo"), F.col("hi"))
    samples = samples.where(~(suffix(F.col("signal")).isin(*GNSS) & (F.col("v") == 0)))
    return samples.join(w, "sortie", "left" if whole else "inner").where((F.col("lo").isNull() | inside) if whole else inside).drop("lo", "hi")


def flight_plots(samples: DataFrame, modes: DataFrame, names: list[str] | None = None, before: float = 10.0, after: float = 5.0, max_pts: int | None = 2000) -> DataFrame:
    """Samples from before the first to after the last of the named modes; the whole flight if there is none (JN-3)."""
    points = _windowed(samples, phase_window(modes, names or APPROACH_LANDING), before, after, True).select("sortie", "signal", "t", "v", "ord")
    return points if max_pts is None else downsample_minmax(points, ["sortie", "signal"], max_pts)


def takeoff_plots(samples: DataFrame, modes: DataFrame, names: list[str] | None = None, before: float = 10.0, after: float = 30.0, max_pts: int | None = 2000) -> DataFrame:
    """As flight_plots for the takeoff modes, but nothing where they never were on."""
    points = _windowed(samples, phase_window(modes, names or TAKEOFF), before, after, False).select("sortie", "signal", "t", "v", "ord")
    return points if max_pts is None else downsample_minmax(points, ["sortie", "signal"], max_pts)


def elapsed(points: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds since the first point of each series (WIN-13)."""
    return points.withColumn("elapsed_s", F.col("t") - F.min("t").over(W.partitionBy(*keys)))
