"""Mode names, modes at a time, phase windows and intervals, flat segments, phase statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import signal_matches

#: Mode names of each axis by code.
MODE_NAMES = {
    "lat": ["standby", "heading", "nav", "navAppr", "takeoff", "align", "track"],
    "vert": ["standby", "pitch", "verticalSpeed", "altitudeHold", "altitudeSelect", "glidePath", "vnav", "takeoff", "flare", "vgp", "flc"],
    "at": ["standby", "takeOff", "speed", "retard", "lim", "thrust"],
}
APPROACH_LANDING = ["navAppr", "glidePath", "align", "flare", "retard"]
TAKEOFF = ["takeoff", "takeOff"]


def mode_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, float(i), n) for a, names in MODE_NAMES.items() for i, n in enumerate(names)], "axis string, code double, name string")


def decode_modes(modes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """from_name and to_name by axis; an unknown code is its own text (PRJ-9). The table of names has some dozen rows."""
    names = mode_names(modes.sparkSession) if names is None else names
    for side in ("from", "to"):
        n = F.broadcast(names.select("axis", F.col("code").alias(f"{side}_v"), F.col("name").alias(f"{side}_name")))
        modes = modes.join(n, ["axis", f"{side}_v"], "left").withColumn(f"{side}_name", F.coalesce(f"{side}_name", F.col(f"{side}_v").cast("string")))
    return modes


def modes_at(probes: DataFrame, modes: DataFrame) -> DataFrame:
    """probes (sortie, t, ord, probe) with the mode of each axis at their time: the latest change not after it (JN-1).

    Both sides are united and filled forward in one window; no pair of rows is ever formed beyond the result. At equal
    times a change comes before the probe, and the later of two changes counts.
    """
    axes = modes.select("sortie", "axis").distinct()
    p = probes.join(axes, "sortie").select("sortie", "axis", "t", F.lit(1).alias("side"), "ord", "probe", F.lit(None).cast("double").alias("mode"))
    m = modes.select("sortie", "axis", "t", F.lit(0).alias("side"), "ord", F.lit(None).cast(probes.schema["probe"].dataType).alias("probe"), F.col("to_v").alias("mode"))
    filled = p.unionByName(m).withColumn("mode", F.last("mode", ignorenulls=True).over(W.partitionBy("sortie", "axis").orderBy("t", "side", "ord").rowsBetween(W.unboundedPreceding, 0)))
    return filled.where("side = 1 and mode is not null").select("sortie", "probe", "axis", "t", "mode")


def phase_window(modes: DataFrame, names: list[str]) -> DataFrame:
    """From the first activation of any named mode to its last activation or end (WIN-8)."""
    on, off = F.col("to_name").isin(names), F.col("from_name").isin(names)
    w = modes.groupBy("sortie").agg(F.min(F.when(on, F.col("t"))).alias("t_lo"), F.max(F.when(on | off, F.col("t"))).alias("t_hi"))
    return w.where("t_lo is not null")


def mode_intervals(modes: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(sortie, signal, axis, name, t_lo, t_hi): how long each mode held; the last to the recording's end, if given."""
    until = F.lead("t").over(W.partitionBy("sortie", "signal").orderBy("t", "ord"))
    held = modes.select("sortie", "signal", "axis", F.col("to_name").alias("name"), F.col("t").alias("t_lo"), until.alias("t_hi"))
    if ends is not None:
        held = held.join(ends.select("sortie", F.col("t_max").alias("_end")), "sortie", "left").withColumn("t_hi", F.coalesce("t_hi", "_end")).drop("_end")
    return held


def phases(intervals: DataFrame, classes: dict[str, list[str]], join_gap: float = 0.0) -> DataFrame:
    """(sortie, phase, t_lo, t_hi): islands of the intervals of each class of modes, neighbours merged (WIN-9)."""
    phase = F.coalesce(*[F.when(F.col("name").isin(names), F.lit(p)) for p, names in classes.items()])
    rows = intervals.withColumn("phase", phase).where("phase is not null and t_hi is not null")
    by = W.partitionBy("sortie", "phase").orderBy("t_lo", "t_hi")
    reach = F.max("t_hi").over(by.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.coalesce((F.col("t_lo") - reach > join_gap).cast("int"), F.lit(1))).withColumn("_n", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("sortie", "phase", "_n").agg(F.min("t_lo").alias("t_lo"), F.max("t_hi").alias("t_hi")).drop("_n")


def flat_segments(samples: DataFrame, min_s: float = 5.0) -> DataFrame:
    """(sortie, signal, v, t_lo, t_hi, n): runs of equal values that last min_s at least (WIN-12)."""
    by = W.partitionBy("sortie", "signal").orderBy("ord")
    run = samples.withColumn("_new", F.coalesce((F.lag("v").over(by) != F.col("v")).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    seg = run.groupBy("sortie", "signal", "_run").agg(F.min("v").alias("v"), F.min("t").alias("t_lo"), F.max("t").alias("t_hi"), F.count("*").alias("n"))
    return seg.where((F.col("t_hi") - F.col("t_lo") >= min_s) & (F.col("n") > 1)).drop("_run")


def flat_together(segments: DataFrame, signals: int, min_s: float = 5.0) -> DataFrame:
    """(sortie, t_lo, t_hi): times at which that many signals are flat at once, by a sweep over starts and ends."""
    edges = segments.select("sortie", F.explode(F.array(F.struct(F.col("t_lo").alias("t"), F.lit(1).alias("d")), F.struct(F.col("t_hi").alias("t"), F.lit(-1).alias("d")))).alias("e")).groupBy("sortie", "e.t").agg(F.sum("e.d").alias("d"))
    by = W.partitionBy("sortie").orderBy("t")
    level = edges.withColumn("level", F.sum("d").over(by.rowsBetween(W.unboundedPreceding, 0))).withColumn("t_hi", F.lead("t").over(by))
    return level.where((F.col("level") >= signals) & (F.col("t_hi") - F.col("t") >= min_s)).select("sortie", F.col("t").alias("t_lo"), "t_hi")


def _in_bins(points: DataFrame, t: str, found: DataFrame, width: float, how: str = "inner") -> DataFrame:
    """points with the phases that hold at their time: both meet in bins of time, so no sortie is paired whole."""
    p = found.select("sortie", "phase", "t_lo", "t_hi", F.explode(F.sequence(F.floor(F.col("t_lo") / width), F.floor(F.col("t_hi") / width))).alias("bin"))
    x, y = points.withColumn("bin", F.floor(F.col(t) / width)).alias("x"), p.alias("y")
    meet = (F.col("x.sortie") == F.col("y.sortie")) & (F.col("x.bin") == F.col("y.bin")) & F.col(f"x.{t}").between(F.col("y.t_lo"), F.col("y.t_hi"))
    return x.join(y, meet, how).select("x.*", "y.phase", "y.t_lo", "y.t_hi").drop("bin")


def phase_stats(found: DataFrame, samples: DataFrame, width: float = 60.0) -> DataFrame:
    """Per phase and signal: value at entry and exit, largest absolute value, root mean square (AGG-19)."""
    inside = _in_bins(samples, "t", found, width)
    return inside.groupBy("sortie", "phase", "t_lo", "t_hi", "signal").agg(F.min_by("v", F.struct("t", "ord")).alias("entry_v"), F.max_by("v", F.struct("t", "ord")).alias("exit_v"), F.max(F.abs("v")).alias("max_abs"), F.round(F.sqrt(F.avg(F.col("v") * F.col("v"))), 4).alias("rms"))


def phase_at(faults: DataFrame, found: DataFrame, priority: list[str], width: float = 60.0) -> DataFrame:
    """faults (sortie, episode, start_t) with the phase in force, by priority, or null (JN-4)."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("phase"))
    hit = _in_bins(faults, "start_t", found, width, "left")
    return hit.groupBy("sortie", "episode", "start_t").agg(F.min_by("phase", F.when(rank > 0, rank).otherwise(99)).alias("phase"))


def _islands(rows: DataFrame, keys: list[str], join_gap: float) -> DataFrame:
    """rows with _n: the number of their island, of intervals that overlap, touch, or are join_gap apart at most."""
    by = W.partitionBy(*keys).orderBy("t_lo", "t_hi")
    reach = F.max("t_hi").over(by.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.coalesce((F.col("t_lo") - reach > join_gap).cast("int"), F.lit(1)))
    return marked.withColumn("_n", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def phase_cards(found: DataFrame, first: str = "approach", second: str = "landing", join_gap: float = 0.0) -> DataFrame:
    """(sortie, phase, t_lo, t_hi, second_t): phases, with an approach and the landing that follows it as one card (WIN-9).

    Islands run across both classes: intervals that overlap, hold one another, touch, or are join_gap apart at most. An
    island in which a second starts no earlier than its earliest first is one card, named first_second, and second_t is when
    the second began. In other islands, as a landing before a new approach, the phases stay by themselves, as do other
    classes. Equal intervals fall into one island; intervals without an end are left out.
    """
    known = found.where("t_hi is not null")
    both = _islands(known.where(F.col("phase").isin(first, second)), ["sortie"], join_gap)
    is_first, is_second = F.col("phase") == first, F.col("phase") == second
    size = both.groupBy("sortie", "_n").agg(
        F.min("t_lo").alias("t_lo"), F.max("t_hi").alias("t_hi"), F.min(F.when(is_first, F.col("t_lo"))).alias("_first"),
        F.max(F.when(is_second, F.col("t_lo"))).alias("_last"),
    )
    whole = size.where(F.col("_last") >= F.col("_first"))
    begun = both.where(is_second).join(whole.select("sortie", "_n", "_first"), ["sortie", "_n"]).where(F.col("t_lo") >= F.col("_first")).groupBy("sortie", "_n").agg(F.min("t_lo").alias("second_t"))
    cards = whole.join(begun, ["sortie", "_n"]).select("sortie", F.lit(f"{first}_{second}").alias("phase"), "t_lo", "t_hi", "second_t")
    none = F.lit(None).cast("double").alias("second_t")
    alone = both.join(whole.select("sortie", "_n"), ["sortie", "_n"], "left_anti").select("sortie", "phase", "t_lo", "t_hi", none)
    rest = known.where(~F.col("phase").isin(first, second)).select("sortie", "phase", "t_lo", "t_hi", none)
    return cards.unionByName(alone).unionByName(rest)


def with_modes_held(cards: DataFrame, intervals: DataFrame, names: list[str], width: float = 60.0) -> DataFrame:
    """cards with held: whether one of the named modes was on for some of their time, as flare or align tell an auto-landing (AGG-14)."""
    bins = lambda df, lo, hi: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    on = intervals.where(F.col("name").isin(names) & F.col("t_hi").isNotNull()).select("sortie", F.col("t_lo").alias("m_lo"), F.col("t_hi").alias("m_hi"))
    meet = bins(cards, "t_lo", "t_hi").join(bins(on, "m_lo", "m_hi"), ["sortie", "_bin"]).where((F.col("m_lo") <= F.col("t_hi")) & (F.col("m_hi") >= F.col("t_lo")))
    hit = meet.select(*cards.columns).distinct().withColumn("held", F.lit(True))
    keys = ["sortie", "phase", "t_lo", "t_hi"]
    return cards.join(hit.select(*keys, "held"), keys, "left").withColumn("held", F.coalesce("held", F.lit(False)))


def flat_in_phases(segments: DataFrame, found: DataFrame, signals: int, min_s: float = 5.0, width: float = 60.0) -> DataFrame:
    """(sortie, phase, t_lo, t_hi, most): stretches of at least min_s inside a phase in which that many signals are flat at once (WIN-12).

    segments: those of flat_segments, so a signal's own never overlap. Each is cut to the phases it meets, in bins of time;
    a sweep over starts and ends gives how many hold at each moment, and neighbouring pieces with enough signals are one
    stretch; most is the largest number in it. Pieces that only touch a phase have no length and do not count.
    """
    bins = lambda df: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("t_lo") / width), F.floor(F.col("t_hi") / width))))
    p = bins(found.where("t_hi is not null").select("sortie", "phase", "t_lo", "t_hi")).withColumnsRenamed({"t_lo": "p_lo", "t_hi": "p_hi"})
    lo, hi = F.greatest("t_lo", "p_lo"), F.least("t_hi", "p_hi")
    # Of the bins that a pair shares the one with the start of what they share gives it.
    cut = bins(segments.select("sortie", "signal", "t_lo", "t_hi")).join(p, ["sortie", "_bin"]).where((hi > lo) & (F.col("_bin") == F.floor(lo / width)))
    edge = lambda t, d: F.struct(t.alias("t"), F.lit(d).alias("d"))
    keys = ["sortie", "phase", "p_lo", "p_hi"]
    edges = cut.select(*keys, F.explode(F.array(edge(lo, 1), edge(hi, -1))).alias("e")).groupBy(*keys, "e.t").agg(F.sum("e.d").alias("d"))
    by = W.partitionBy(*keys).orderBy("t")
    upto = by.rowsBetween(W.unboundedPreceding, 0)
    level = edges.withColumns({"level": F.sum("d").over(upto), "t_hi": F.lead("t").over(by)}).withColumn("_in", F.col("level") >= signals)
    marked = level.withColumn("_n", F.sum((~F.col("_in")).cast("int")).over(upto)).where("_in")
    whole = marked.groupBy(*keys, "_n").agg(F.min("t").alias("t_lo"), F.max("t_hi").alias("t_hi"), F.max("level").alias("most"))
    return whole.where(F.col("t_hi") - F.col("t_lo") >= min_s).select("sortie", "phase", "t_lo", "t_hi", "most")


def tracking_errors(samples: DataFrame, actual: str, command: str, tolerance: float = 1.0) -> DataFrame:
    """(sortie, t, ord, actual, command, error): each actual sample less the latest command not after it (AGG-19).

    Both are united and filled forward by time; at equal times the command comes first, and of several the later one
    counts. A command older than tolerance does not, and such samples are left out. Names are whole or suffixes.
    """
    is_actual, is_command = signal_matches(F.col("signal"), actual), signal_matches(F.col("signal"), command)
    rows = samples.where(is_actual | is_command).select("sortie", "t", "ord", "v", is_actual.cast("int").alias("side"))
    by = W.partitionBy("sortie").orderBy("t", "side", "ord").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("side") == 0, F.struct("t", "v")), ignorenulls=True).over(by)
    met = rows.withColumn("c", last).where((F.col("side") == 1) & (F.col("t") - F.col("c.t") <= tolerance))
    return met.select("sortie", "t", "ord", F.col("v").alias("actual"), F.col("c.v").alias("command"), (F.col("v") - F.col("c.v")).alias("error"))


def phase_tracking(found: DataFrame, errors: DataFrame, width: float = 60.0) -> DataFrame:
    """(sortie, phase, t_lo, t_hi, n, max_abs, rms) of the tracking errors, or of deviations, inside each phase (AGG-19)."""
    inside = _in_bins(errors, "t", found, width)
    return inside.groupBy("sortie", "phase", "t_lo", "t_hi").agg(F.count("*").alias("n"), F.max(F.abs("error")).alias("max_abs"), F.round(F.sqrt(F.avg(F.col("error") * F.col("error"))), 4).alias("rms"))


def touchdowns(found: DataFrame, transitions: DataFrame, samples: DataFrame, ground: str, positions: dict[str, str], width: float = 60.0) -> DataFrame:
    """(sortie, phase, t_lo, t_hi, touchdown_t, and a column for each position): the last air-to-ground edge of each phase (AGG-19).

    ground is the signal that goes from 0 to 1 on the ground; positions names a column for each signal, whose value is the
    latest at the touchdown, null before its first. Phases without an edge are left out; of edges at one time one counts.
    """
    edges = transitions.where(signal_matches(F.col("signal"), ground) & (F.col("from_v") == 0) & (F.col("to_v") == 1)).select("sortie", "t")
    keys = ["sortie", "phase", "t_lo", "t_hi"]
    last = _in_bins(edges, "t", found, width).groupBy(*keys).agg(F.max("t").alias("touchdown_t"))
    probes = last.select("sortie", F.col("touchdown_t").alias("t"), F.lit(1).alias("side"), F.lit(0).cast("long").alias("ord"), F.struct(*keys).alias("of"))
    names = {c: signal_matches(F.col("signal"), s) for s, c in positions.items()}
    own = samples.where(reduce(lambda a, b: a | b, names.values())).select("sortie", "t", F.lit(0).alias("side"), "ord", F.lit(None).cast(probes.schema["of"].dataType).alias("of"), *[F.when(fit, F.col("v")).alias(c) for c, fit in names.items()])
    by = W.partitionBy("sortie").orderBy("t", "side", "ord").rowsBetween(W.unboundedPreceding, 0)
    filled = own.unionByName(probes, allowMissingColumns=True).withColumns({c: F.last(c, ignorenulls=True).over(by) for c in names})
    return filled.where("side = 1").select("of.*", F.col("t").alias("touchdown_t"), *names)
