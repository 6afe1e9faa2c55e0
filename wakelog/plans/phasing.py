"""Queries of flight phases: cards, flat stretches inside phases, tracking errors, touchdowns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev, fleet, modes as md, profile
from . import telemetry as tel
from .registry import _phases, query
from .telemetry import DAY

#: Approaches from one channel and landings from the other, so that they touch, overlap and hold one another.
CARDS = """, ends AS (SELECT sortie, round(max(t), 3) AS t_max FROM raw GROUP BY 1),
lands AS (SELECT e.sortie, 'landing' AS phase, 'flare' AS name, e.t AS t_lo, coalesce(e.ret_t, x.t_max) AS t_hi FROM edges e JOIN ends x USING (sortie) WHERE to_v = 1
  UNION ALL SELECT sortie, 'landing', name, t_lo, t_hi FROM held WHERE name = 'nav'),
apart AS (SELECT sortie, phase, min(t_lo) AS t_lo, max(t_hi) AS t_hi FROM (
  SELECT *, sum(CASE WHEN reach IS NULL OR t_lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY sortie, phase ORDER BY t_lo, t_hi ROWS UNBOUNDED PRECEDING) AS n FROM (
    SELECT *, max(t_hi) OVER (PARTITION BY sortie, phase ORDER BY t_lo, t_hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (
      SELECT sortie, phase, t_lo, t_hi FROM lands UNION ALL SELECT sortie, phase, t_lo, t_hi FROM classed WHERE phase IS NOT NULL))) GROUP BY sortie, phase, n),
across AS (SELECT *, sum(CASE WHEN reach IS NULL OR t_lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY sortie ORDER BY t_lo, t_hi ROWS UNBOUNDED PRECEDING) AS n FROM (
  SELECT *, max(t_hi) OVER (PARTITION BY sortie ORDER BY t_lo, t_hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM apart WHERE phase <> 'takeoff')),
firsts_of AS (SELECT sortie, n, min(t_lo) FILTER (WHERE phase = 'approach') AS f FROM across GROUP BY 1, 2),
joined AS (SELECT a.sortie, a.n, min(a.t_lo) AS t_lo, max(a.t_hi) AS t_hi, min(a.t_lo) FILTER (WHERE a.phase = 'landing' AND a.t_lo >= f.f) AS second_t FROM across a JOIN firsts_of f ON f.sortie = a.sortie AND f.n = a.n GROUP BY 1, 2),
cards AS (
  SELECT sortie, 'approach_landing' AS phase, t_lo, t_hi, second_t FROM joined WHERE second_t IS NOT NULL
  UNION ALL SELECT a.sortie, a.phase, a.t_lo, a.t_hi, NULL FROM across a JOIN joined j ON j.sortie = a.sortie AND j.n = a.n WHERE j.second_t IS NULL
  UNION ALL SELECT sortie, phase, t_lo, t_hi, NULL FROM apart WHERE phase = 'takeoff')
"""


def _intervals(s, d):
    """Mode intervals of both channels: kind as the lateral mode, err as a flare."""
    extent = profile.recording_extent(tel.raw(s, d))
    vert = tel.found(s, d).where("signal = 'err'").withColumns({"axis": F.lit("vert"), "to_name": F.when(F.col("to_v") == 1, "flare").otherwise("standby")})
    return md.mode_intervals(md.decode_modes(tel.modes(s, d)), extent).unionByName(md.mode_intervals(vert, extent))


def _cards(s, d, intervals):
    return md.phase_cards(md.phases(intervals, {"approach": ["navAppr"], "landing": ["nav", "flare"], "takeoff": ["takeoff"]}))


@query(CARDS + "SELECT * FROM cards")
def phase_cards(s, d):
    return _cards(s, d, _intervals(s, d))


@query(CARDS + "SELECT c.sortie, c.phase, c.t_lo, c.t_hi, EXISTS (SELECT 1 FROM lands l WHERE l.sortie = c.sortie AND l.name = 'flare' AND l.t_lo <= c.t_hi AND l.t_hi >= c.t_lo) AS held FROM cards c WHERE c.phase IN ('approach_landing', 'landing')")
def auto_landings(s, d):
    """Landings with a flare (AGG-14)."""
    intervals = _intervals(s, d)
    return md.with_modes_held(_cards(s, d, intervals).where(F.col("phase").endswith("landing")), intervals, ["flare", "align"], DAY).select("sortie", "phase", "t_lo", "t_hi", "held")


@query("""SELECT sortie, phase, t_lo, t_hi, most FROM (
  SELECT sortie, phase, p_lo, n, min(t) AS t_lo, max(t_next) AS t_hi, max(level) AS most FROM (
    SELECT *, sum((level < 2)::INT) OVER (PARTITION BY sortie, phase, p_lo ORDER BY t) AS n FROM (
      SELECT sortie, phase, p_lo, t, sum(d) OVER (PARTITION BY sortie, phase, p_lo ORDER BY t) AS level, lead(t) OVER (PARTITION BY sortie, phase, p_lo ORDER BY t) AS t_next FROM (
        SELECT sortie, phase, p_lo, t, sum(d) AS d FROM (
          SELECT c.sortie, c.phase, c.p_lo, unnest([c.lo, c.hi]) AS t, unnest([1, -1]) AS d FROM (
            SELECT p.sortie, p.phase, p.t_lo AS p_lo, greatest(f.t_lo, p.t_lo) AS lo, least(f.t_hi, p.t_hi) AS hi FROM phases p JOIN (
              SELECT sortie, signal, min(t) AS t_lo, max(t) AS t_hi FROM (SELECT *, sum(CASE WHEN before IS NULL OR before <> v THEN 1 ELSE 0 END) OVER (PARTITION BY sortie, signal ORDER BY ord) AS run FROM lagged)
              GROUP BY sortie, signal, run HAVING max(t) - min(t) >= 3600 AND count(*) > 1) f ON f.sortie = p.sortie WHERE least(f.t_hi, p.t_hi) > greatest(f.t_lo, p.t_lo)) c) GROUP BY 1, 2, 3, 4)))
  WHERE level >= 2 GROUP BY sortie, phase, p_lo, n) WHERE t_hi - t_lo >= 3600""")
def flat_in_phases(s, d):
    return md.flat_in_phases(md.flat_segments(tel.samples(s, d).where("signal <> 'value'"), 3600.0), _phases(s, d), 2, 3600.0, DAY)


@query("""SELECT p.sortie, p.phase, p.t_lo, p.t_hi, count(*) AS n, max(abs(x.e)) AS max_abs, round(sqrt(avg(x.e * x.e)), 4) AS rms
FROM phases p JOIN (
  SELECT a.sortie, a.t, a.v - c.v AS e FROM (SELECT * FROM samples WHERE signal = 'value' AND ord % 2 = 1) a ASOF JOIN (SELECT * FROM samples WHERE signal = 'value' AND ord % 2 = 0) c ON c.sortie = a.sortie AND a.t >= c.t WHERE a.t - c.t <= 86400) x
ON x.sortie = p.sortie AND x.t BETWEEN p.t_lo AND p.t_hi GROUP BY 1, 2, 3, 4""")
def tracking_errors(s, d):
    """Every other value is the command that the next one is held against (AGG-19)."""
    rows = tel.samples(s, d).where("signal = 'value'").withColumn("signal", F.when(F.col("ord") % 2 == 0, "FCC1A.pitchCmd").otherwise("FCC1A.pitch"))
    return md.phase_tracking(_phases(s, d), md.tracking_errors(rows, "pitch", "pitchCmd", DAY), DAY)


@query("""SELECT x.sortie, x.phase, x.t_lo, x.t_hi, x.touchdown_t, a.v AS lat, b.v AS lon FROM (
  SELECT p.sortie, p.phase, p.t_lo, p.t_hi, max(x.t) AS touchdown_t FROM phases p JOIN trans x ON x.sortie = p.sortie AND x.signal = 'err' AND x.to_v = 1 AND x.t BETWEEN p.t_lo AND p.t_hi GROUP BY 1, 2, 3, 4) x
ASOF LEFT JOIN (SELECT sortie, t, v FROM samples WHERE signal = 'value') a ON a.sortie = x.sortie AND x.touchdown_t >= a.t
ASOF LEFT JOIN (SELECT sortie, t, v FROM samples WHERE signal = 'kind') b ON b.sortie = x.sortie AND x.touchdown_t >= b.t""")
def touchdowns(s, d):
    return md.touchdowns(_phases(s, d), tel.found(s, d), tel.samples(s, d), "err", {"value": "lat", "kind": "lon"}, DAY)


@query(CARDS + "SELECT 'auto_landings' AS measure, count(*) AS n FROM cards c WHERE c.phase IN ('approach_landing', 'landing') AND EXISTS (SELECT 1 FROM lands l WHERE l.sortie = c.sortie AND l.name = 'flare' AND l.t_lo <= c.t_hi AND l.t_hi >= c.t_lo) UNION ALL SELECT 'sorties', count(DISTINCT sortie) FROM raw UNION ALL SELECT 'faults', count(*) FROM eps UNION ALL SELECT 'sorties_affected', count(DISTINCT sortie) FROM eps UNION ALL SELECT 'gaps', count(*) FROM gaps UNION ALL SELECT 'phase_' || phase, count(*) FROM cards GROUP BY phase")
def fleet_totals(s, d):
    """fleet_summary over cards, with the auto-landings."""
    intervals = _intervals(s, d)
    cards = _cards(s, d, intervals)
    auto = md.with_modes_held(cards.where(F.col("phase").endswith("landing")), intervals, ["flare", "align"], DAY).where("held")
    return fleet.fleet_summary(tel.raw(s, d), tel.episodes(s, d), cards, ev.data_gaps(tel.raw(s, d), 2 * DAY), auto)
