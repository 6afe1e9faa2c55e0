"""Fault classes by ordered rules over the transitions near a trigger: one aggregation and one CASE, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import suffix
from .modes import modes_at

#: How long before the trigger is before, and how near is at, in seconds.
BEFORE, AT = -0.010, 0.05
#: Patterns over lower-cased suffixes.
DISCONNECT, QUICK, MONITOR = r"ap.?disc|disconnect|^toga$|apquickdisconnect", r"^toga$|apquickdisconnect", r"mon.?flag|monitorflag"
RESPONSE, COMMAND, TRIM, VALID, STANDBY, CAPABLE, DEBOUNCE, ENGAGED = "resp.?eng", "cmd.?eng", "mistrim|xcd", "valid|health", "enforcestandby", "capable", "debounce.*out$", "afcsengage"
#: What any rule looks at.
LOOKED_AT = "|".join((DISCONNECT, RESPONSE, COMMAND, MONITOR, TRIM, VALID, STANDBY, CAPABLE, DEBOUNCE, ENGAGED))
VALID_SOURCES = ("ads", "irs", "pfd", "fcp", "fcc")
#: Ours: the axis of a fault by the front of its evidence.
AXES = {"lat": "lateral", "roll": "lateral", "vert": "vertical", "pitch": "vertical", "at": "auto-throttle", "thr": "auto-throttle"}


def locate_trigger(found: DataFrame, signal: str, from_v: float, to_v: float, anchor: str = "first_match") -> DataFrame:
    """Episode transitions with role and dt by the first listed one of the trigger's name and values (CLS-14).

    anchor first_match: it may lie in the look-back; opening: only from the episode's start on (dt not below 0).

    The name is the whole one or what follows a dot, in any case. Episodes without such a row are left out. Of rows that share
    ord and signal the earliest counts; rows that are equal in these and t are all the trigger.
    """
    name = F.lower("signal")
    hit = ((name == signal.lower()) | name.endswith("." + signal.lower())) & (F.col("from_v") == from_v) & (F.col("to_v") == to_v)
    if anchor not in ("first_match", "opening"):
        raise ValueError(f"no anchor {anchor}")
    first = (found.where(hit) if anchor == "first_match" else found.where(hit & (F.col("dt") >= 0))).groupBy("sortie", "episode").agg(F.min(F.struct("ord", "signal", "t")).alias("_trigger"))
    at = found.drop("role", "dt").join(first, ["sortie", "episode"])
    is_it = (F.col("ord") == F.col("_trigger.ord")) & (F.col("signal") == F.col("_trigger.signal")) & (F.col("t") == F.col("_trigger.t"))
    return at.withColumns({"dt": F.col("t") - F.col("_trigger.t"), "role": F.when(is_it, "trigger").otherwise("other")}).drop("_trigger")


def _own_debounces(of: str, kind: str) -> Column:
    """Debounce outputs of a monitor's own axis, which is what stands before its kind in the name; those that name the kind first."""
    axis = F.regexp_extract(of, rf"^([a-z]+?){kind}", 1)
    own = lambda form: F.filter("debounces", lambda d: (axis != "") & F.rlike(d, F.concat(F.lit("^"), axis, F.lit(form))))
    return F.concat(own(f".*{kind}.*debounce.*out$"), own(".*debounce.*out$"))


def classify(found: DataFrame) -> DataFrame:
    """(sortie, episode, category, label, evidence, confidence, axis) of each episode with a trigger row (CLS-1 to 11).

    found: episode transitions with role; dt counts from the opening trigger. The first rule that fires gives the class.
    Rules look at changes between 0 and 1, the nearest to the trigger first; debounce outputs count with any values and at
    any time of the episode. Of several responses the first one whose axis has a debounce output is meant.
    """
    c, dt = F.col, F.col("dt")
    # Each pattern is looked at once a row, below the sums; rows without a name of a rule are not summed up.
    triggers = found.where("role = 'trigger'").select("sortie", "episode").distinct()
    rows = found.where("role <> 'trigger'").select("sortie", "episode", "dt", "from_v", "to_v", "ord", F.lower(suffix(c("signal"))).alias("s")).where(c("s").rlike(LOOKED_AT))
    change = c("from_v").isin(0.0, 1.0) & c("to_v").isin(0.0, 1.0)
    up, down, pre = c("to_v") == 1, c("to_v") == 0, change & (dt < BEFORE)
    around = pre | (change & (F.abs(dt) <= AT))
    like = lambda p: c("s").rlike(p)
    near = F.struct(F.abs(dt).alias("d"), c("ord").alias("o"), c("s").alias("n"))
    seen = {
        "cmd": pre & like(DISCONNECT) & (~like("^toga$") | up), "resp": around & down & like(RESPONSE), "cmdmon": around & down & like(COMMAND), "mon": around & up & like(MONITOR), "trim": around & up & like(TRIM),
        "valid": around & down & like(VALID), "sby": around & up & like(STANDBY), "cap": pre & down & like(CAPABLE), "debounce": like(DEBOUNCE), "disengaged": change & (c("from_v") == 1) & like(ENGAGED),
    }
    rows = rows.select("sortie", "episode", "dt", near.alias("near"), *[cond.alias(name) for name, cond in seen.items()])
    nearest = lambda of: F.min(F.when(c(of), c("near"))).alias(of)
    each = lambda of, name: F.transform(F.array_sort(F.collect_set(F.when(c(of), c("near")))), lambda x: x["n"]).alias(name)
    # Every column rests on its own sums only, so those that nobody reads are not made.
    g = rows.groupBy("sortie", "episode").agg(
        F.max("disengaged").alias("disengaged"), *map(nearest, ("cmd", "resp", "cmdmon", "mon", "trim", "sby", "cap")),
        F.min(F.when(c("valid"), F.struct("dt", "near"))).alias("valid"), each("resp", "responses"), each("debounce", "debounces"),
    )
    g = triggers.join(g, ["sortie", "episode"], "left")
    quick = c("cmd.n").rlike(QUICK)
    fires = {
        "PILOT_CMD": c("cmd").isNotNull() & c("mon").isNull() & (~quick | F.coalesce("disengaged", F.lit(False))), "RESP_MONITOR": c("resp").isNotNull(), "CMD_MONITOR": c("cmdmon").isNotNull(), "MONITOR_FAULT": c("mon").isNotNull(),
        "MISTRIM": c("trim").isNotNull(), "VALIDITY_LOSS": c("valid").isNotNull(), "ENFORCE_SBY": c("sby").isNotNull(), "CAP_LOST": c("cap").isNotNull(),
    }
    g = g.withColumn("category", F.coalesce(*[F.when(cond, name) for name, cond in fires.items()], F.lit("UNKNOWN")))
    confirmed = F.filter("responses", lambda r: F.exists("debounces", lambda d: (F.regexp_extract(r, "^([a-z]+?)resp", 1) != "") & F.rlike(d, F.concat(F.lit("^"), F.regexp_extract(r, "^([a-z]+?)resp", 1), F.lit(".*debounce.*out$")))))
    g = g.withColumn("_resp", F.coalesce(F.get(confirmed, F.lit(0)), c("resp.n")))
    g = g.withColumns({"of_resp": F.get(_own_debounces("_resp", "resp"), F.lit(0)), "of_cmd": F.get(_own_debounces("cmdmon.n", "cmd"), F.lit(0)), "any": F.get("debounces", F.lit(0))})
    valid = c("valid.near.n")
    facts = {
        "PILOT_CMD": (F.when(quick, "Pilot Deactivation (TOGA/QD)").otherwise("Pilot-Commanded Disconnect"), c("cmd.n"), F.lit(None).cast("string")),
        "RESP_MONITOR": (F.lit("Response Monitor Trip"), F.coalesce("of_resp", "_resp"), c("of_resp")),
        "CMD_MONITOR": (F.lit("Command Monitor Trip"), F.coalesce("of_cmd", "cmdmon.n"), c("of_cmd")),
        "MONITOR_FAULT": (F.lit("Monitor Fault"), c("mon.n"), c("any")),
        "MISTRIM": (F.lit("Mistrim / Torque Limit"), c("trim.n"), c("any")),
        "VALIDITY_LOSS": (F.coalesce(*[F.when(valid.startswith(p), f"{p.upper()} Validity Loss") for p in VALID_SOURCES], F.lit("Sensor Validity Loss")), valid, valid),
        "ENFORCE_SBY": (F.lit("Forced Standby"), c("sby.n"), c("any")),
        "CAP_LOST": (F.lit("Upstream Capability Lost"), c("cap.n"), c("any")),
    }
    of = lambda i: F.coalesce(*[F.when(c("category") == name, x[i]) for name, x in facts.items()])
    out = g.select("sortie", "episode", "category", F.coalesce(of(0), F.lit("Unknown Exit")).alias("label"), of(1).alias("evidence"), of(2).alias("_sure"))
    sure = F.when(c("category").isin("PILOT_CMD", "UNKNOWN"), "n/a").when(c("_sure").isNotNull(), "confirmed").otherwise("unconfirmed")
    axis = F.coalesce(*[F.when(c("evidence").startswith(p), a) for p, a in AXES.items()])
    return out.withColumns({"confidence": sure, "axis": axis}).drop("_sure")


def hide_commanded(classified: DataFrame, found: DataFrame, signals: list[str]) -> DataFrame:
    """Without the pilot-commanded episodes that hold one of the signals (CLS-12)."""
    hit = found.where(suffix(F.col("signal")).isin(signals)).select("sortie", "episode").distinct()
    return classified.join(hit.withColumn("category", F.lit("PILOT_CMD")), ["sortie", "episode", "category"], "left_anti")


def dossiers(classified: DataFrame, found: DataFrame, upstream: DataFrame, correlations: DataFrame, episodes: DataFrame | None = None, modes: DataFrame | None = None, torque: DataFrame | None = None) -> DataFrame:
    """A nested row of evidence for each UNKNOWN episode (CLS-13): transitions with hop and score where known.

    With episodes (sortie, episode, start_t) and modes the modes in force at its start, by axis; with torque (sortie, signal,
    peak, peak_time) the sortie's peaks. Both are null where nothing is known.
    """
    unknown = classified.where("category = 'UNKNOWN'").select("sortie", "episode")
    rows = found.join(unknown, ["sortie", "episode"]).withColumn("key", suffix(F.col("signal")))
    rows = rows.join(upstream.select(F.col("signal").alias("key"), "hop"), "key", "left").join(correlations.select(F.col("signal").alias("key"), "score"), "key", "left")
    out = rows.groupBy("sortie", "episode").agg(F.array_sort(F.collect_list(F.struct("t", "ord", "signal", "dt", "from_v", "to_v", "hop", "score"))).alias("transitions"))
    if episodes is not None and modes is not None:
        starts = episodes.join(unknown, ["sortie", "episode"]).select("sortie", F.col("start_t").alias("t"), F.lit(2**62).alias("ord"), F.col("episode").alias("probe"))
        at = modes_at(starts, modes).groupBy("sortie", F.col("probe").alias("episode")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("axis", "mode")))).alias("modes"))
        out = out.join(at, ["sortie", "episode"], "left")
    if torque is not None:
        out = out.join(torque.groupBy("sortie").agg(F.array_sort(F.collect_list(F.struct("signal", "peak", "peak_time"))).alias("torque")), "sortie", "left")
    return out
