"""Column expressions for cells, times, signal names and sortie labels. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Header names that are a time column, and the affixes that make one.
TIME_NAMES = ("t", "time", "timestamp", "time_s", "time_sec", "timesec", "rel_time", "reltime", "irig", "irig_time", "elapsed", "elapsed_s", "elapsed_time", "run_time", "runtime", "mission_time", "missiontime", "test_time", "testtime", "t_sec", "tsec")
TIME_SUFFIXES, TIME_PREFIXES = ("_t", "_time", "_sec", "_irig"), ("time_", "irig_")
LANES = ("FCC1A", "FCC1B", "RDC1", "RDC2", "IRS1", "IRS2")
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_WHOLE = r"^\s*[+-]?[0-9]+\s*$"


def finite(cell: Column) -> Column:
    """A text cell as a finite double; null for anything else (PRJ-2)."""
    return F.when(cell.rlike(_NUMBER), bounded(cell.try_cast("double")))


def bounded(value: Column) -> Column:
    """A double that is neither NaN nor infinite, else null (PRJ-11)."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def sanitize(df: DataFrame) -> DataFrame:
    """Every double column with non-finite values as null."""
    return df.withColumns({c: bounded(F.col(c)) for c, kind in df.dtypes if kind == "double"})


def time_seconds(cell: Column) -> Column:
    """Seconds from a number, HH:MM:SS[.s] or DDD:HH:MM:SS[.s]; else null (PRJ-3). All parts but the last are whole."""
    part = F.split(F.trim(cell), ":")
    last = lambda i: finite(F.get(part, F.lit(i)))
    at = lambda i: F.when(F.get(part, F.lit(i)).rlike(_WHOLE), last(i))
    three = at(0) * 3600 + at(1) * 60 + last(2)
    four = at(0) * 86400 + at(1) * 3600 + at(2) * 60 + last(3)
    return F.coalesce(finite(cell), F.when(F.size(part) == 3, three), F.when(F.size(part) == 4, four))


def time_column(columns: list[str], rule: str = "strict") -> str:
    """The first header that names time; ValueError if none does (SRC-1a)."""
    import re

    for c in columns:
        name = c.strip().lower()
        if re.match(r"^(time|irig|t)\b", name) if rule == "loose" else name in TIME_NAMES or name.endswith(TIME_SUFFIXES) or name.startswith(TIME_PREFIXES):
            return c
    raise ValueError("no column of the header is a time column")


def suffix(signal: Column) -> Column:
    return F.substring_index(signal, ".", -1)


def with_signal_parts(df: DataFrame, signal: str = "signal", key_mode: str = "suffix") -> DataFrame:
    """suffix, lane, model and a key without the lane (PRJ-6); key_mode: suffix or model_suffix.

    The model is the second part of a name if g_ is in front of it, without that and _mdlrefdw, _mdlref or _mdl behind.
    """
    s = F.col(signal)
    part = F.split(s, r"\.")
    lane = F.nullif(F.regexp_extract(s, rf"^({'|'.join(LANES)})\.", 1), F.lit(""))
    model = F.nullif(F.regexp_extract(F.get(part, F.lit(1)), r"^g_(.+?)(?:_mdlrefdw|_mdlref|_mdl)?$", 1), F.lit(""))
    key = suffix(s) if key_mode == "suffix" else F.concat_ws(".", model, suffix(s))
    return df.withColumns({"suffix": suffix(s), "lane": lane, "model": model, "norm_key": key})


def signal_matches(signal: Column, pattern: str) -> Column:
    """The whole name or its suffix equals the pattern (PRJ-7)."""
    return (signal == pattern) | (suffix(signal) == pattern)


#: A sortie (S) or ground run (G) with its number, then a tail and a leg; parts may lack.
_TAG = r"(?i)(?<![A-Za-z])([SG]\d{2,5})"
TAG_FORMS = {"leg": _TAG + r"([A-Z][A-Z0-9]*)_(\d+)", "bare": _TAG + r"(?!\d)", "tail": _TAG + r"([A-Z][A-Z0-9]+)(?:_\d+)?\.zip", "label": _TAG + r"([A-Z][A-Z0-9]+)", "leg_label": _TAG + r"([A-Z][A-Z0-9]+)_(\d+)"}


def with_sortie_tags(df: DataFrame, source: str = "source") -> DataFrame:
    """sortie (S102_1, or S119 without a leg), tail (N208B) and directory label (S102_1_N208B) from a path (PRJ-5).

    Letters come in upper case. A name without a tail has no label; one without a tag has nothing.
    """
    name = F.element_at(F.split(F.col(source), "/"), -1)
    part = lambda form, i, of=name: F.upper(F.nullif(F.regexp_extract(of, TAG_FORMS[form], i), F.lit("")))
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    sortie = F.coalesce(F.concat(part("leg", 1), F.lit("_"), part("leg", 3)), part("bare", 1))
    # A name with a leg somewhere is taken by that place, though another may come first.
    leg, whole = (lambda i: part("leg_label", i, stem)), (lambda i: part("label", i, stem))
    label = F.coalesce(F.concat(leg(1), F.lit("_"), leg(3), F.lit("_"), leg(2)), F.concat(whole(1), F.lit("_"), whole(2)))
    return df.withColumns({"sortie": sortie, "tail": part("tail", 2), "label": label})


def glob_regex(globs: list[str]) -> str:
    import re

    return "^(?:" + "|".join(re.escape(g).replace(r"\*", ".*").replace(r"\?", ".") for g in globs) + ")$"


def exclude_signals(df: DataFrame, globs: list[str], signal: str = "signal") -> DataFrame:
    """Rows whose suffix matches none of the wildcards, case-sensitive (PRJ-13)."""
    return df.where(~suffix(F.col(signal)).rlike(glob_regex(globs))) if globs else df


def exclude_sources(df: DataFrame, patterns: list[str], source: str = "source") -> DataFrame:
    """Rows whose source contains none of the substrings (SRC-4)."""
    for p in patterns:
        df = df.where(~F.contains(F.col(source), F.lit(p)))
    return df


def resolve_plot_signals(catalog: DataFrame, wanted: list[str]) -> DataFrame:
    """(source, wanted, signal): for each source the first header, by col_ord, that a wanted name matches (PRJ-8)."""
    w = F.explode(F.array(*map(F.lit, wanted)))
    hit = catalog.select("source", "signal", "col_ord", w.alias("wanted")).where((F.col("signal") == F.col("wanted")) | (suffix(F.col("signal")) == F.col("wanted")))
    first = hit.groupBy("source", "wanted").agg(F.min_by("signal", F.struct("col_ord", "signal")).alias("signal"))
    return first


def suggest_signals(catalog: DataFrame, wanted: DataFrame, most: int = 10) -> DataFrame:
    """(wanted, suggestion, place): for names not in the catalog, signals that contain them or their suffix (SRC-7)."""
    names = catalog.select("signal").distinct()
    missing = wanted.join(names.select(F.explode(F.array("signal", suffix(F.col("signal")))).alias("wanted")).distinct(), "wanted", "left_anti")
    near = names.join(missing, F.contains(F.lower("signal"), F.lower(suffix(F.col("wanted")))))
    ranked = near.withColumn("place", F.row_number().over(W.partitionBy("wanted").orderBy("signal")))
    return ranked.where(F.col("place") <= most).select("wanted", F.col("signal").alias("suggestion"), "place")


def with_trace_graph(df: DataFrame, by_tail: dict[str, str], default: str | None = None, explicit: str | None = None) -> DataFrame:
    """The model graph of a recording: the explicit one, else the tail's, else the default (PRJ-12)."""
    if explicit is not None:
        return df.withColumn("trace_graph", F.lit(explicit))
    known = F.create_map(*[F.lit(x) for kv in by_tail.items() for x in kv]) if by_tail else None
    found = F.coalesce(F.try_element_at(known, F.col("tail")), F.lit(default)) if known is not None else F.lit(default)
    return df.withColumn("trace_graph", found)


def with_named_graph(df: DataFrame, by_part: dict[str, str], default: str | None = None, name: str = "sortie") -> DataFrame:
    """The model graph of the first entry whose key is part of the name, else the default (PRJ-12). A null name has the default."""
    found = [F.when(F.contains(F.col(name), F.lit(k)), F.lit(v)) for k, v in by_part.items()]
    return df.withColumn("trace_graph", F.coalesce(*found, F.lit(default)))


def ranked_sources(files: DataFrame) -> DataFrame:
    """files (sortie, path, size) with rank from 0: a sortie's larger files first, equal ones by path (TOP-4)."""
    return files.withColumn("rank", F.row_number().over(W.partitionBy("sortie").orderBy(F.desc("size"), "path")) - 1)


def timing_cluster(mean_dt: Column) -> Column:
    """context below -1 s, precursor below -0.05 s, else near-simultaneous (PRJ-15)."""
    return F.when(mean_dt < -1.0, "context").when(mean_dt < -0.05, "precursor").otherwise("near-simultaneous")


def dt_samples(seconds: Column, hz: float = 40.0) -> Column:
    return F.round(seconds * hz, 1)


def bool_transitions(df: DataFrame) -> DataFrame:
    """Transitions between 0 and 1 only (PRJ-17)."""
    return df.where(F.col("from_v").isin(0.0, 1.0) & F.col("to_v").isin(0.0, 1.0))


def gnss_position(samples: DataFrame, coarse: str, fine: str, name: str) -> DataFrame:
    """Coarse plus fine samples of one position at the same time, zeros dropped (PRJ-14)."""
    pick = lambda s, v: samples.where(signal_matches(F.col("signal"), s) & (F.col("v") != 0)).select("sortie", "t", F.col("v").alias(v))
    return pick(coarse, "c").join(pick(fine, "f"), ["sortie", "t"]).select("sortie", "t", F.lit(name).alias("signal"), (F.col("c") + F.col("f")).alias("v"))


def register_functions(spark: SparkSession) -> None:
    """signal_suffix, timing_cluster and time_seconds as temporary SQL functions."""
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION signal_suffix(s STRING) RETURNS STRING RETURN element_at(split(s, '[.]'), -1)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION timing_cluster(d DOUBLE) RETURNS STRING RETURN CASE WHEN d < -1.0 THEN 'context' WHEN d < -0.05 THEN 'precursor' ELSE 'near-simultaneous' END")
    number = lambda x: f"CASE WHEN {x} RLIKE r'{_NUMBER}' AND abs(try_cast({x} AS DOUBLE)) < double('inf') THEN try_cast({x} AS DOUBLE) END"
    part = lambda i: f"get(split(trim(s), ':'), {i})"
    whole = lambda i: f"CASE WHEN {part(i)} RLIKE r'{_WHOLE}' THEN try_cast({part(i)} AS DOUBLE) END"
    # The last part is the seconds; minutes, hours and days count back from it.
    sizes = [(3, (3600, 60)), (4, (86400, 3600, 60))]
    cases = [f"CASE WHEN size(split(trim(s), ':')) = {n} THEN {' + '.join(f'({whole(i)}) * {k}' for i, k in enumerate(ks))} + ({number(part(n - 1))}) END" for n, ks in sizes]
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION time_seconds(s STRING) RETURNS DOUBLE RETURN coalesce({number('s')}, {', '.join(cases)})")
