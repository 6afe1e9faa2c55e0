"""Writers: analysis and hi-res documents by sortie, reports with their parameters, and the manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _gathered(rows: DataFrame, name: str, order: list[str], /, **fields: Column) -> DataFrame:
    """(sortie, name): the rows of each sortie as an array of structs, sorted by the columns of order."""
    entry = F.struct(F.struct(*order).alias("o"), F.struct(*[c.alias(k) for k, c in fields.items()]).alias("x"))
    # Only what orders is compared, as a field may be a map.
    by_order = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
    return rows.groupBy("sortie").agg(F.transform(F.array_sort(F.collect_list(entry), by_order), lambda e: e["x"]).alias(name))


def _moves(rows: DataFrame) -> dict[str, Column]:
    """A transition as documents have it: the time is a text, from and to are names of fields."""
    return {"signal": F.col("signal"), "time": F.col("t").cast("string"), "from": F.col("from_v"), "to": F.col("to_v"), "row_idx": F.col("ord")}


def analysis_documents(recordings: DataFrame, episodes: DataFrame, found: DataFrame, gaps: DataFrame, modes: DataFrame | None = None, peaks: DataFrame | None = None, channels: DataFrame | None = None, flight: DataFrame | None = None, takeoff: DataFrame | None = None, trigger: tuple | None = None, sampled: DataFrame | None = None, context: DataFrame | None = None, elapsed: DataFrame | None = None) -> DataFrame:
    """(sortie, document): everything known of each recorded sortie as one JSON text (SNK-1).

    recordings: (sortie, source, total_rows, t_min, duration_s); found: transitions of episodes, with episode; channels: as
    channel_summary gives them; flight and takeoff: points; trigger: (signal, from, to); sampled: rows of sample_rows and
    context of context_rows, each with ord, part (sampled only) and a map cells; elapsed: (sortie, elapsed_s), how long the
    analysis took. Columns tail, trace_graph and time_col of recordings go along if they are there. Parts that are not given are left
    out; a sortie without rows of a part has an empty list. A document holds a sortie whole, as its readers want it, so a
    row is as large as one sortie's result.
    """
    e = ["sortie", "episode"]
    listed = found.groupBy(*e).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "ord", F.struct(*[c.alias(k) for k, c in _moves(found).items()]).alias("x")))), lambda m: m["x"]).alias("transitions"))
    whole = episodes.join(listed, e, "left")
    parts = [
        _gathered(whole, "episodes", ["episode"], episode=F.col("episode"), start_time=F.col("start_t").cast("string"), end_time=F.col("end_t").cast("string"), duration_s=F.col("duration_s"), transitions=F.coalesce("transitions", F.array())),
        _gathered(gaps, "data_gaps", ["t_start"], t_start=F.col("t_start"), t_end=F.col("t_end"), duration_s=F.col("duration_s")),
    ]
    if modes is not None:
        parts.append(_gathered(modes, "mode_transitions", ["t", "ord"], **_moves(modes)))
    if peaks is not None:
        parts.append(_gathered(peaks, "torque_stats", ["signal"], signal=F.col("signal"), peak=F.col("peak"), peak_time=F.col("peak_time"), modes=F.col("modes")))
    if channels is not None:
        of = lambda kind: channels.where(F.col("class") == kind)
        parts.append(_gathered(of("bool"), "bool_channels", ["signal"], name=F.col("signal"), active_count=F.col("n_active"), total_count=F.col("n"), active_pct=F.col("active_pct")))
        parts.append(_gathered(of("enum"), "enum_channels", ["signal"], name=F.col("signal"), values=F.col("values")))
        parts.append(_gathered(of("num"), "num_channels", ["signal"], name=F.col("signal"), min=F.col("min"), max=F.col("max"), mean=F.col("mean")))
    if sampled is not None:
        parts.append(_gathered(sampled, "sample_rows", ["ord"], row_idx=F.col("ord"), part=F.col("part"), cells=F.col("cells")))
    if context is not None:
        parts.append(_gathered(context, "context_rows", ["ord"], row_idx=F.col("ord"), cells=F.col("cells")))
    for name, points in (("flight_plots", flight), ("takeoff_plots", takeoff)):
        if points is not None:
            parts.append(_series(points).withColumnRenamed("plots", name))
    doc = recordings if elapsed is None else recordings.join(elapsed.select("sortie", F.col("elapsed_s").alias("processing_time_s")), "sortie", "left")
    for p in parts:
        doc = doc.join(p, "sortie", "left")
    names = [p.columns[1] for p in parts]
    empty = [F.coalesce(n, F.from_json(F.lit("{}" if n.endswith("_plots") else "[]"), dict(doc.dtypes)[n])).alias(n) for n in names]
    given = [] if trigger is None else [F.struct(F.lit(trigger[0]).alias("signal"), F.lit(float(trigger[1])).alias("from"), F.lit(float(trigger[2])).alias("to")).alias("trigger")]
    more = [F.col(a).alias(b) for a, b in (("tail", "tail_number"), ("trace_graph", "trace_graph"), ("time_col", "time_col"), ("processing_time_s", "processing_time_s")) if a in doc.columns]
    own = [F.col("source").alias("filename"), "total_rows", "duration_s", F.col("t_min").alias("rec_start_s"), *more]
    return doc.select("sortie", F.to_json(F.struct(*own, *given, *empty), {"ignoreNullFields": "false"}).alias("document"))


def write_analysis(documents: DataFrame, path: str, packed: bool = False) -> None:
    """One JSON document a sortie, nulls kept, in folders by sortie; packed: many to a file, for fleets of many sorties."""
    _write_texts(documents, path, packed)


def _write_texts(documents: DataFrame, path: str, packed: bool) -> None:
    """(sortie, document) as files. packed: a line each, the sortie as a JSON list, a tab and the document.

    A JSON text has neither tabs nor line breaks outside of its escapes. A folder for each sortie costs the driver a
    few calls each to commit and to list.
    """
    if packed:
        documents.select(F.concat_ws("\t", F.to_json(F.array("sortie")), "document").alias("value")).write.mode("overwrite").text(path)
    else:
        documents.select("sortie", F.col("document").alias("value")).write.mode("overwrite").partitionBy("sortie").text(path)


def _series(points: DataFrame) -> DataFrame:
    """(sortie, plots): [t, v] pairs by signal."""
    pairs = points.groupBy("sortie", "signal").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "ord", "v"))), lambda p: F.array(p["t"], p["v"])).alias("pairs"))
    return pairs.groupBy("sortie").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("signal", "pairs")))).alias("plots"))


def write_hires(points: DataFrame, path: str, takeoff: DataFrame | None = None, packed: bool = False) -> None:
    """One JSON document a sortie with [t, v] pairs by signal, for the flight and, if given, the takeoff (SNK-2); packed as in write_analysis."""
    doc, names = _series(points).withColumnRenamed("plots", "flight_plots"), ["flight_plots"]
    if takeoff is not None:
        doc, names = doc.join(_series(takeoff).withColumnRenamed("plots", "takeoff_plots"), "sortie", "full"), [*names, "takeoff_plots"]
    _write_texts(doc.select("sortie", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("document")), path, packed)


def write_report(rows: DataFrame, params: dict, name: str, path: str, order: list[Column] | None = None) -> None:
    """One JSON document: the run's parameters and the rows in their ranking (SNK-3, SNK-4). The rows are a top list, so few.

    order ranks them; without it a column place does, else the order in which a sorted table has them. An empty list is
    written as one.
    """
    ranked = rows
    if order is not None:
        ranked = rows.withColumn("place", F.row_number().over(W.orderBy(*order)))
    elif "place" not in rows.columns:
        ranked = rows.withColumn("place", F.monotonically_increasing_id())
    columns = [c for c in ranked.columns if c != "place"]
    listed = ranked.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct(*columns).alias("row")))), lambda x: x["row"]).alias(name))
    listed.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in params.items()], name), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_manifest(rows: DataFrame, path: str, run: int = 0) -> None:
    """Append (sortie, status, elapsed_s) rows of a run (SNK-5)."""
    rows.select("sortie", "status", F.col("elapsed_s").cast("double").alias("elapsed_s")).withColumn("run", F.lit(run).cast("long")).write.mode("append").parquet(path)


def requeue_corrupt(corrupt: DataFrame, sortie_of: Column, path: str, run: int) -> None:
    """Sorties whose documents cannot be read go into the manifest as corrupt, so that they are pending again (UPS-7)."""
    rows = corrupt.select(sortie_of.alias("sortie")).distinct()
    write_manifest(rows.select("sortie", F.lit("corrupt").alias("status"), F.lit(None).cast("double").alias("elapsed_s")), path, run)
