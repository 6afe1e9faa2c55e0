"""Back-fill of stored results: plots from sources, histories from exports, statistics and hi-res points from documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import suffix, time_seconds
from ..operators import backfill, modes as md, plots
from ..operators.events import MODE_SUFFIXES, first_wins
from ..operators.store import stored
from . import telemetry as src
from .generations import next_run, read_generations, write_generation

POINTS = "scope string, episode int, t double, v double, ord long, sortie string, signal string"
#: Which suffixes are torques, which of those are limits, and the mode signals told beside a peak.
TORQUE, LIMIT, PEAK_MODES = "(?i)torq", "(?i)lim", ("vertActiveEnum", "latActiveEnum", "atActiveEnum")


def stored_points(spark: SparkSession, out: str) -> DataFrame:
    """The plot points that back-fill has written to out: scope is flight, takeoff or episode."""
    return read_generations(spark, out, POINTS, ["sortie", "signal"])


def plot_points(samples: DataFrame, modes: DataFrame, episodes: DataFrame, max_pts: int | None = 2000, episode_pts: int | None = 500, margin: float = 30.0) -> DataFrame:
    """Flight, takeoff and episode points of samples as one table of POINTS. modes are decoded."""
    none = F.lit(None).cast("int").alias("episode")
    parts = [
        plots.flight_plots(samples, modes, max_pts=max_pts).select(F.lit("flight").alias("scope"), none, "t", "v", "ord", "sortie", "signal"),
        plots.takeoff_plots(samples, modes, max_pts=max_pts).select(F.lit("takeoff").alias("scope"), none, "t", "v", "ord", "sortie", "signal"),
        plots.episode_plots(episodes, samples, margin, episode_pts).select(F.lit("episode").alias("scope"), F.col("episode").cast("int").alias("episode"), "t", "v", "ord", "sortie", "signal"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def locate_signals(index: DataFrame, missing: DataFrame, sortie_of: Column | DataFrame) -> DataFrame:
    """(sortie, signal, path, header): where each missing signal is: the sortie's first file by name that has it, its first column.

    index is a header_index; a column fits by its whole name or its suffix. Signals that no file has are left out.
    sortie_of: a column over a file's path, or (path, sortie) rows of files that hold many sorties.
    """
    owned = index.join(sortie_of, "path") if isinstance(sortie_of, DataFrame) else index.withColumn("sortie", sortie_of)
    named = owned.withColumn("name", F.explode(F.array_distinct(F.array("signal", suffix(F.col("signal"))))))
    hit = named.select("sortie", "path", "name", F.col("signal").alias("header"), "col_ord").join(missing.select("sortie", F.col("signal").alias("name")), ["sortie", "name"])
    return hit.groupBy("sortie", F.col("name").alias("signal")).agg(F.min(F.struct("path", "col_ord", "header")).alias("x")).select("sortie", "signal", "x.path", "x.header")


def backfill_plots(spark: SparkSession, out: str, sources: str, sortie_of: Column | str, wanted: list[str], modes: DataFrame, episodes: DataFrame, sorties: DataFrame, force: bool = False, **points) -> DataFrame:
    """Add the wanted signals to the plot points stored in out, from CSV sources; gives what was located (UPS-1).

    A signal that a sortie's flight already has is left alone, with force it is made anew. Headers tell which files are
    opened, and only the columns that are wanted are read. Found signals replace their (sortie, signal) part, also
    where nothing is left of it; signals that no file of the sortie has stay missing. sortie_of is a column over a
    file's path, where a file is of one sortie, or the name of the CSV column that tells a row's sortie, where files
    are shared: the driver lists and opens files one by one. modes are decoded; points go to plot_points.
    """
    have = stored_points(spark, out).where("scope = 'flight'")
    names = spark.createDataFrame([(w,) for w in dict.fromkeys(wanted)], "signal string")
    missing = backfill.missing_pairs(names, sorties, have.limit(0) if force else have)
    shared = isinstance(sortie_of, str)
    holds = src.read_telemetry_csv(spark, sources).select("path", F.col(f"`{sortie_of}`").alias("sortie")).distinct() if shared else sortie_of
    located = stored(locate_signals(src.header_index(spark, sources), missing, holds), "located")
    # A row a file that is opened, and the names of the columns that are read.
    paths = [r["path"] for r in located.select("path").distinct().orderBy("path").collect()]
    if not paths:
        return located
    headers = [r["header"] for r in located.select("header").distinct().collect()]
    ids = (sortie_of,) if shared else ()
    own = [F.col(f"`{c}`").alias("sortie") for c in ids]
    long = src.csv_to_long(src.read_telemetry_csv(spark, paths), headers, ids)
    samples = long.select("path", F.col("signal").alias("header"), *own, "t", "v", "ord").join(located, ["path", "header", *(["sortie"] if shared else [])])
    number = next_run(spark, out, "sortie string, signal string")
    # Written once: each kind of plot reads them, and would read the files again.
    samples = stored(samples.select("sortie", "signal", "t", "v", "ord"), "found")
    rows = plot_points(samples, modes, episodes, **points)
    write_generation(rows, located, out, number, ["sortie", "signal"])
    return located


def documents(spark: SparkSession, out: str) -> DataFrame:
    """(document, sortie) as they are now."""
    return read_generations(spark, out, "document string, sortie string", ["sortie"])


def _parsed(docs: DataFrame, *more: str) -> DataFrame:
    """docs with d: the whole document, as one value. more: further fields with their types."""
    return docs.withColumn("d", F.from_json("document", ", ".join([src.DOCUMENT, *more])))


def _text(d: str = "d") -> Column:
    """A document as text; fields that it lacks stay out, nulls inside its lists are kept as nothing."""
    return F.to_json(d)


def patch_histories(spark: SparkSession, out: str, exports: DataFrame, extents: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Put exported transitions of one signal into the stored documents they overlap most (UPS-2); gives (sortie, patch) written.

    exports: (patch, signal, t, from_v, to_v, ord); extents: (patch, t_min, t_max). The recording with the largest overlap
    takes a patch (see best_overlap). A document whose key has entries is left as it is, unless force. The signals are
    registered among the bool channels. Only documents that change are written; so a second run changes nothing. Of several
    patches for one document the first by name counts.
    """
    name = suffix(F.lit(key))
    field = key.split(".")[-1]
    docs = _parsed(documents(spark, out), *([] if f" {field} " in f" {src.DOCUMENT} " else [f"`{field}` {src._TR}"]))
    recordings = docs.where("d.rec_start_s is not null and d.duration_s is not null").select("sortie", F.col("d.rec_start_s").alias("t_min"), (F.col("d.rec_start_s") + F.col("d.duration_s")).alias("t_max"))
    best = backfill.best_overlap(extents, recordings)
    chosen = first_wins(best, ["sortie"], [F.col("patch")]).select("patch", "sortie")
    move = F.struct("signal", F.col("t").cast("string").alias("time"), F.col("from_v").alias("from"), F.col("to_v").alias("to"), F.col("ord").alias("row_idx"))
    lists = exports.where((F.col("signal") == key) | (suffix(F.col("signal")) == name)).groupBy("patch").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("t", "ord", move.alias("x")))), lambda e: e["x"]).alias("moves"), F.array_sort(F.collect_set("signal")).alias("names")
    )
    old = F.coalesce(F.size(f"d.`{field}`"), F.lit(0))
    todo = docs.join(chosen.join(lists, "patch"), "sortie")
    todo = todo if force else todo.where(old <= 0)
    bools = F.coalesce("d.bool_channels", F.array().cast(src.BOOLS))
    new = F.array_except("names", F.transform(bools, lambda b: b["name"]))
    unknown = [F.lit(None).cast(kind).alias(f) for f, kind in (("active_count", "bigint"), ("total_count", "bigint"), ("active_pct", "double"))]
    listed = F.concat(bools, F.transform(new, lambda n: F.struct(n.alias("name"), *unknown)))
    changed = todo.withColumn("d", F.col("d").withField(f"`{field}`", F.col("moves").cast(src._TR)).withField("bool_channels", listed))
    written = stored(changed.select("sortie", "patch", _text().alias("document")), "patched")
    if not written.isEmpty():
        write_generation(written.select("document", "sortie"), written, out, next_run(spark, out, "sortie string"), ["sortie"])
    return written.select("sortie", "patch")


def _peaks(points: Column, moves: Column) -> Column:
    """The peak of each torque signal of a map of [t, v] lists, the first of equal ones, with the modes at its time."""
    wanted = lambda k, v: suffix(k).rlike(TORQUE) & ~suffix(k).rlike(LIMIT) & (F.size(v) > 0)
    peak = lambda p: F.array_max(F.transform(p, lambda x, i: F.struct(x[1].alias("v"), (-i).alias("i"), x[0].alias("t"))))
    # Of the changes up to the peak the latest counts, of equal times the one listed last.
    upto = lambda name, t: F.filter(F.transform(moves, lambda m, i: F.struct(time_seconds(m["time"]).alias("t"), i.alias("i"), m["to"].alias("v"), suffix(m["signal"]).alias("s"))), lambda m: (m["s"] == name) & (m["t"] <= t))
    modes = lambda t: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("k"), F.array_max(upto(n, t))["v"].alias("v")) for n in PEAK_MODES]), lambda e: e["v"].isNotNull()))
    found = F.transform(F.map_entries(F.map_filter(F.coalesce(points, F.create_map().cast("map<string,array<array<double>>>")), wanted)), lambda e: F.struct(e["key"].alias("signal"), peak(e["value"]).alias("p")))
    return F.transform(F.filter(found, lambda e: e["p"]["v"].isNotNull()), lambda e: F.struct(e["signal"].alias("signal"), e["p"]["v"].alias("peak"), e["p"]["t"].alias("peak_time"), modes(e["p"]["t"]).alias("modes")))


def torque_from_documents(docs: DataFrame, hires: DataFrame) -> DataFrame:
    """(sortie, signal, peak, peak_time, modes): torque peaks from stored points and the stored mode history (UPS-4).

    docs and hires: (sortie, document). Of flight and takeoff the higher peak counts, the flight's if they are equal. All
    of it happens inside a document's row, by higher-order functions: no point leaves it.
    """
    both = _parsed(docs).select("sortie", F.col("d.mode_transitions").alias("moves")).join(hires.select("sortie", F.from_json("document", src.HIRES).alias("h")), "sortie")
    moves = F.coalesce("moves", F.array().cast(src._TR))
    ranked = lambda rank, name: F.transform(_peaks(F.col(f"h.{name}"), moves), lambda e: F.struct(F.lit(rank).alias("rank"), e.alias("e")))
    each = both.select("sortie", F.explode(F.concat(ranked(1, "flight_plots"), ranked(0, "takeoff_plots"))).alias("x"))
    best = each.groupBy("sortie", "x.e.signal").agg(F.max_by("x.e", F.struct("x.e.peak", "x.rank")).alias("e"))
    return best.select("sortie", "signal", F.round("e.peak", 2).alias("peak"), F.round("e.peak_time", 3).alias("peak_time"), "e.modes")


def backfill_torque(spark: SparkSession, out: str, hires: DataFrame, force: bool = False) -> DataFrame:
    """Write torque statistics into the stored documents that have none, or with force into all; gives the sorties written."""
    docs = documents(spark, out)
    todo = _parsed(docs)
    todo = todo if force else todo.where("coalesce(size(d.torque_stats), 0) <= 0")
    stats = torque_from_documents(todo.select("sortie", "document"), hires)
    listed = stats.groupBy("sortie").agg(F.array_sort(F.collect_list(F.struct("signal", "peak", "peak_time", "modes")), lambda a, b: F.when(a["signal"] < b["signal"], -1).when(a["signal"] > b["signal"], 1).otherwise(0)).alias("stats"))
    changed = todo.join(listed, "sortie").withColumn("d", F.col("d").withField("torque_stats", F.col("stats")))
    written = stored(changed.select(_text().alias("document"), "sortie"), "torque")
    if not written.isEmpty():
        write_generation(written, written, out, next_run(spark, out, "sortie string"), ["sortie"])
    return written.select("sortie")


def stored_modes(docs: DataFrame, suffixes: dict[str, str] | None = None) -> DataFrame:
    """The mode history that documents hold, as mode_transitions gives it: an anchor is a row whose value does not change."""
    axis = F.create_map(*[F.lit(x) for kv in (suffixes or MODE_SUFFIXES).items() for x in kv])
    moves = _parsed(docs).select("sortie", F.inline("d.mode_transitions"))
    named = moves.select("sortie", "signal", F.try_element_at(axis, suffix(F.col("signal"))).alias("axis"), time_seconds(F.col("time")).alias("t"), F.col("from").alias("from_v"), F.col("to").alias("to_v"), (F.col("from") == F.col("to")).alias("is_anchor"), F.col("row_idx").alias("ord"))
    return named.where("axis is not null and t is not null")


def hires_points(samples: DataFrame, docs: DataFrame, max_pts: int | None = 8000) -> tuple[DataFrame, DataFrame]:
    """(flight, takeoff): points of samples in the windows that the documents' stored mode history tells (UPS-5).

    Sorties without a document are left out; a flight without the modes is taken whole, a takeoff without them not at all.
    """
    modes = md.decode_modes(stored_modes(docs))
    own = samples.join(docs.select("sortie").distinct(), "sortie", "left_semi")
    return plots.flight_plots(own, modes, max_pts=max_pts), plots.takeoff_plots(own, modes, max_pts=max_pts)
