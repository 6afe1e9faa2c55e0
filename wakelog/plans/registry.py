"""The registered queries of the telemetry operators and the DuckDB SQL that each must match."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as fn
from ..operators import backfill, classify, events as ev, fleet, graph, modes as md, plots, profile, store
from ..operators import episodes as ep
from . import telemetry as tel
from .telemetry import DAY, load

R = {}
SQL = {}

CTE = """
WITH RECURSIVE raw AS (
  SELECT user_id::VARCHAR AS sortie, 'events' AS source, epoch_us(ts) / 1e6::DOUBLE AS t, event_id AS ord, event_type, value,
    (event_type = 'error')::INT::DOUBLE AS err,
    (CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END)::DOUBLE AS kind FROM events),
samples AS (
  SELECT sortie, source, t, ord, 'err' AS signal, err AS v FROM raw UNION ALL SELECT sortie, source, t, ord, 'kind', kind FROM raw WHERE kind IS NOT NULL
  UNION ALL SELECT sortie, source, t, ord, 'value', value FROM raw WHERE value IS NOT NULL),
lagged AS (SELECT *, lag(v) OVER (PARTITION BY sortie, signal ORDER BY ord) AS before FROM samples WHERE signal <> 'value'),
trans AS (SELECT sortie, source, signal, t, before AS from_v, v AS to_v, ord FROM lagged WHERE before <> v),
edges AS (SELECT *, lead(t) OVER (PARTITION BY sortie ORDER BY ord) AS ret_t, lead(ord) OVER (PARTITION BY sortie ORDER BY ord) AS ret_ord FROM trans WHERE signal = 'err'),
opens AS (SELECT sortie, t, ord, ret_t, ret_ord FROM edges WHERE to_v = 1),
nexts AS (SELECT o.*, (SELECT min(p.ord) FROM opens p WHERE p.sortie = o.sortie AND p.t - o.ret_t > 86400.0::DOUBLE) AS next_ord FROM opens o),
chain AS (
  SELECT n.*, 1 AS episode FROM nexts n JOIN (SELECT sortie, min(ord) AS o FROM opens GROUP BY 1) f ON n.sortie = f.sortie AND n.ord = f.o
  UNION ALL SELECT n.*, c.episode + 1 FROM chain c JOIN nexts n ON n.sortie = c.sortie AND n.ord = c.next_ord),
eps AS (SELECT sortie, episode, t AS start_t, ord AS start_ord, ret_t AS end_t, ret_ord AS end_ord, round(ret_t - t, 2) AS duration_s FROM chain),
ept AS (
  SELECT e.sortie, e.episode, x.signal, x.t, x.t - e.start_t AS dt, x.from_v, x.to_v, x.ord,
    CASE WHEN x.ord = e.start_ord AND x.signal = 'err' THEN 'trigger' WHEN (x.t, x.ord) < (e.start_t, e.start_ord) AND e.start_t - x.t <= 86400 THEN 'pre'
      WHEN (x.t, x.ord) >= (e.start_t, e.start_ord) AND (e.end_t IS NULL OR (x.t, x.ord) <= (e.end_t, e.end_ord)) THEN 'during'
      WHEN (x.t, x.ord) > (e.end_t, e.end_ord) AND x.t - e.end_t <= 86400 THEN 'tail' END AS role
  FROM trans x JOIN eps e ON x.sortie = e.sortie),
firsts AS (SELECT sortie, min(t) AS t, arg_min(kind, ord) AS v, min(ord) AS ord FROM raw GROUP BY 1),
modes AS (
  SELECT sortie, signal, 'lat' AS axis, t, from_v, to_v, FALSE AS is_anchor, ord FROM trans WHERE signal = 'kind'
  UNION ALL SELECT sortie, 'kind', 'lat', t, v, v, TRUE, ord FROM firsts),
names(code, name) AS (VALUES (0.0, 'standby'), (1.0, 'heading'), (2.0, 'nav'), (3.0, 'navAppr'), (4.0, 'takeoff')),
named AS (SELECT m.*, f.name AS from_name, g.name AS to_name FROM modes m JOIN names f ON f.code = m.from_v JOIN names g ON g.code = m.to_v),
held AS (SELECT m.sortie, m.signal, m.axis, m.to_name AS name, m.t AS t_lo, coalesce(lead(m.t) OVER (PARTITION BY m.sortie ORDER BY m.t, m.ord), r.t_max) AS t_hi
  FROM named m JOIN (SELECT sortie, round(max(t), 3) AS t_max FROM raw GROUP BY 1) r ON r.sortie = m.sortie),
classed AS (SELECT *, CASE WHEN name = 'navAppr' THEN 'approach' WHEN name = 'takeoff' THEN 'takeoff' END AS phase FROM held),
islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR t_lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY sortie, phase ORDER BY t_lo, t_hi ROWS UNBOUNDED PRECEDING) AS n
  FROM (SELECT *, max(t_hi) OVER (PARTITION BY sortie, phase ORDER BY t_lo, t_hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM classed WHERE phase IS NOT NULL)),
phases AS (SELECT sortie, phase, min(t_lo) AS t_lo, max(t_hi) AS t_hi FROM islands GROUP BY sortie, phase, n),
gaps AS (SELECT sortie, source, round(b, 3) AS t_start, round(t, 3) AS t_end, round(t - b, 3) AS duration_s FROM (SELECT *, lag(t) OVER (PARTITION BY sortie ORDER BY ord) AS b FROM raw) WHERE t - b > 172800),
li AS (
  SELECT l_suppkey::VARCHAR AS sortie, 'lineitem' AS source, date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::DOUBLE AS t, l_orderkey * 8 + l_linenumber AS ord, u.signal, u.v
  FROM lineitem, LATERAL (VALUES ('l_linenumber', l_linenumber::DOUBLE), ('l_quantity', l_quantity), ('l_extendedprice', l_extendedprice), ('l_discount', l_discount), ('l_tax', l_tax)) u(signal, v)),
stats AS (
  SELECT sortie, source, signal, count(*) AS n, sum(v) AS total, min(v) AS min_v, max(v) AS max_v, max((v NOT IN (0, 1))::INT) AS has_non_bool, min((v = floor(v))::INT) AS all_integer, count(DISTINCT v) AS n_distinct,
    count(*) FILTER (WHERE v = 1) AS n_active FROM li GROUP BY 1, 2, 3),
classes AS (SELECT *, CASE WHEN has_non_bool = 0 THEN 'bool' WHEN all_integer = 1 AND n_distinct <= 64 THEN 'enum' ELSE 'num' END AS class FROM stats),
faults AS (
  SELECT e.sortie, e.episode, e.start_t,
    max((r.event_type = 'click')::INT) AS cmd, max((r.event_type = 'purchase')::INT) AS resp, max((r.event_type = 'signup')::INT) AS mon, max((r.event_type = 'view')::INT) AS valid
  FROM eps e LEFT JOIN raw r ON r.sortie = e.sortie AND r.t - e.start_t < -0.010::DOUBLE AND e.start_t - r.t <= 86400 GROUP BY 1, 2, 3),
classified AS (
  SELECT sortie, episode, start_t, CASE WHEN cmd = 1 AND coalesce(mon, 0) = 0 THEN 'PILOT_CMD' WHEN resp = 1 THEN 'RESP_MONITOR' WHEN mon = 1 THEN 'MONITOR_FAULT' WHEN valid = 1 THEN 'VALIDITY_LOSS' ELSE 'UNKNOWN' END AS category FROM faults),
corr AS (
  SELECT signal, round(f * exp(-abs(m) / 2) * exp(-d / 2), 4) AS score, round(f, 4) AS frequency, n_episodes, n_sorties, round(m, 3) AS mean_dt_s, round(d, 3) AS std_dt_s
  FROM (SELECT signal || ':' || to_v::INT AS signal, count(DISTINCT (sortie, episode)) AS n_episodes, count(DISTINCT sortie) AS n_sorties, avg(dt / 86400) AS m, stddev_pop(dt / 86400) AS d,
    count(DISTINCT (sortie, episode)) / (SELECT count(*) FROM eps)::DOUBLE AS f FROM ept WHERE dt / 86400 >= -1 AND dt / 86400 <= 0.5::DOUBLE AND role IS NOT NULL GROUP BY 1)),
up(k, hop) AS (SELECT 1::BIGINT, 0 UNION SELECT p.p_partkey, u.hop + 1 FROM up u JOIN part p ON p.p_partkey // 2 = u.k AND p.p_partkey > 0 WHERE u.hop < 15 AND p.p_partkey <> u.k),
upstream AS (SELECT p_name || '-' || p_partkey AS signal, p_brand AS model, hop, p_type AS "blockType" FROM up JOIN part ON p_partkey = k WHERE hop > 0 AND p_size % 3 = 0),
files AS (SELECT s_suppkey, 'AFCS_S' || lpad((s_suppkey % 1000)::VARCHAR, 3, '0') || 'N208B_' || (s_suppkey % 4) || '.zip' AS source FROM supplier)
"""


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with the SQL that follows the shared tables."""

    def add(f):
        R[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = CTE + sql
        return f

    return add


def _phases(s, d):
    named = md.decode_modes(tel.modes(s, d))
    held = md.mode_intervals(named, profile.recording_extent(tel.raw(s, d)))
    return md.phases(held, {"approach": ["navAppr"], "takeoff": ["takeoff"]})


def _gaps(s, d):
    return ev.data_gaps(tel.raw(s, d), 2 * DAY)


def _ept(s, d, eps=None):
    return ep.episode_transitions(tel.episodes(s, d) if eps is None else eps, tel.found(s, d), DAY, DAY)


def _corr(s, d):
    eps = store.stored(tel.episodes(s, d), "episodes")
    f = _ept(s, d, eps).withColumns({"signal": F.concat_ws(":", "signal", F.col("to_v").cast("int").cast("string")), "dt": F.col("dt") / DAY})
    return fleet.correlate(eps, f, pre=1.0, post=0.5)


def _up(s, d):
    nodes, edges = tel.graph(s, d)
    return graph.upstream(nodes, edges, nodes.where("key = '1'"))


#: What each type of event stands for as a transition near an error.
STANDS_FOR = {"click": ("apDisconnect", 0.0, 1.0), "purchase": ("rollRespEng", 1.0, 0.0), "signup": ("monFlag", 0.0, 1.0), "view": ("adsValid", 1.0, 0.0)}


def _classified(s, d):
    raw, eps = tel.raw(s, d), store.stored(tel.episodes(s, d), "episodes")
    as_ = lambda i: F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v[i])) for k, v in STANDS_FOR.items()])
    # Events and episodes meet in bins of a day, so no sortie is paired whole.
    bins = lambda t: F.floor(F.col(t) / DAY)
    binned = eps.select("sortie", "episode", "start_t", F.explode(F.array(bins("start_t"), bins("start_t") - 1, bins("start_t") - 2)).alias("_bin"))
    moves = raw.where("event_type <> 'error'").select("sortie", "t", "ord", as_(0).alias("signal"), as_(1).alias("from_v"), as_(2).alias("to_v"), bins("t").alias("_bin"))
    near = moves.join(binned, ["sortie", "_bin"]).where((F.col("start_t") - F.col("t") <= DAY) & (F.col("t") <= F.col("start_t")))
    rows = near.select("sortie", "episode", "signal", (F.col("t") - F.col("start_t")).alias("dt"), "from_v", "to_v", F.lit("pre").alias("role"), "ord")
    trigger = eps.select("sortie", "episode", F.lit("afcsCapable").alias("signal"), F.lit(0.0).alias("dt"), F.lit(1.0).alias("from_v"), F.lit(0.0).alias("to_v"), F.lit("trigger").alias("role"), F.col("start_ord").alias("ord"))
    return classify.classify(rows.unionByName(trigger)).join(eps.select("sortie", "episode", "start_t"), ["sortie", "episode"])


@query("SELECT sortie, source, signal, n, round(total, 2) AS total, min_v, max_v, has_non_bool, all_integer, CASE WHEN all_integer = 1 THEN n_distinct END AS n_distinct FROM stats")
def channel_stats(s, d):
    return profile.channel_stats(tel.line_samples(s, d)).select("sortie", "source", "signal", "n", F.round("total", 2).alias("total"), "min_v", "max_v", "has_non_bool", "all_integer", "n_distinct")


@query("SELECT sortie, signal, class FROM classes")
def channel_classes(s, d):
    return profile.classify_channels(profile.channel_stats(tel.line_samples(s, d))).select("sortie", "signal", "class")


@query("SELECT sortie, count(*) AS n, count(*) FILTER (WHERE v = 1) AS n_active, round(100.0::DOUBLE * count(*) FILTER (WHERE v = 1) / count(*), 1) AS active_pct FROM samples WHERE signal = 'err' GROUP BY 1")
def bool_summary(s, d):
    return profile.channel_summary(tel.samples(s, d).where("signal = 'err'")).select("sortie", "n", "n_active", "active_pct")


@query("SELECT sortie, signal, list_aggregate(list_sort(list(DISTINCT v::BIGINT)), 'string_agg', ',') AS vals FROM li SEMI JOIN (SELECT sortie, signal FROM classes WHERE class = 'enum') USING (sortie, signal) GROUP BY 1, 2")
def enum_values(s, d):
    return profile.channel_summary(tel.line_samples(s, d)).where("class = 'enum'").select("sortie", "signal", F.concat_ws(",", F.transform("values", lambda x: x.cast("string"))).alias("vals"))


@query("SELECT sortie, signal, round(min_v, 4) AS min, round(max_v, 4) AS max, round(total / n, 2) AS mean FROM classes WHERE class = 'num'")
def num_summary(s, d):
    return profile.channel_summary(tel.line_samples(s, d)).where("class = 'num'").select("sortie", "signal", "min", "max", F.round("mean", 2).alias("mean"))


@query("SELECT sortie, source, count(*) AS total_rows, round(min(t), 3) AS t_min, round(max(t), 3) AS t_max, round(max(t) - min(t), 2) AS duration_s FROM raw GROUP BY 1, 2")
def recording_extent(s, d):
    return profile.recording_extent(tel.raw(s, d))


@query("SELECT sortie, ord, CASE WHEN up <= 10 THEN 'head' ELSE 'tail' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY sortie ORDER BY ord) AS up, row_number() OVER (PARTITION BY sortie ORDER BY ord DESC) AS down FROM raw) WHERE up <= 10 OR down <= 12")
def sample_rows(s, d):
    return profile.sample_rows(tel.raw(s, d)).select("sortie", "ord", "part")


@query("SELECT r.sortie, r.ord FROM (SELECT *, row_number() OVER (PARTITION BY sortie ORDER BY ord) AS p FROM raw) r JOIN (SELECT x.sortie, x.p FROM (SELECT sortie, ord, row_number() OVER (PARTITION BY sortie ORDER BY ord) AS p FROM raw) x JOIN (SELECT sortie, min(ord) AS o FROM trans GROUP BY 1) f ON f.sortie = x.sortie AND f.o = x.ord) a ON a.sortie = r.sortie AND r.p BETWEEN a.p AND a.p + 5")
def context_rows(s, d):
    return profile.context_rows(tel.raw(s, d), tel.found(s, d)).select("sortie", "ord")


@query("SELECT * FROM trans")
def transitions(s, d):
    return tel.found(s, d)


@query("SELECT sortie, source, signal, t, before AS from_v, v AS to_v, ord FROM (SELECT *, lag(v) OVER (PARTITION BY sortie, signal ORDER BY ord) AS before, min((v = floor(v))::INT) OVER (PARTITION BY sortie, signal ORDER BY ord) AS whole, sum(new) OVER (PARTITION BY sortie, signal ORDER BY ord) AS seen FROM (SELECT *, (row_number() OVER (PARTITION BY sortie, signal, v ORDER BY ord) = 1)::INT AS new FROM samples)) WHERE before <> v AND whole = 1 AND seen <= 64")
def transitions_prefix(s, d):
    return ev.transitions(tel.samples(s, d), mode="prefix")


@query("SELECT * FROM gaps")
def data_gaps(s, d):
    return _gaps(s, d)


@query("SELECT sortie, source, count(*) AS n_gaps, round(sum(duration_s), 2) AS gap_s FROM gaps GROUP BY ROLLUP (sortie, source)")
def gap_summary(s, d):
    return ev.gap_summary(_gaps(s, d))


@query("SELECT sortie, signal, t, from_v, to_v FROM trans WHERE regexp_matches(signal, '(?i)ERR')")
def signal_history(s, d):
    return ev.signal_history(tel.found(s, d), "ERR").select("sortie", "signal", "t", "from_v", "to_v")


@query("SELECT sortie, episode, start_t, end_t, duration_s FROM eps")
def episodes(s, d):
    return tel.episodes(s, d).select("sortie", "episode", "start_t", "end_t", "duration_s")


@query("SELECT * FROM ept WHERE role IS NOT NULL")
def episode_transitions(s, d):
    return _ept(s, d)


@query("SELECT sortie, episode, start_t, FALSE AS is_fallback FROM eps WHERE sortie::BIGINT % 2 = 0 UNION ALL SELECT sortie, episode, start_t, TRUE FROM eps WHERE sortie::BIGINT % 2 = 1")
def episodes_fallback(s, d):
    f = tel.found(s, d).where("signal = 'err'")
    odd = F.col("sortie").cast("long") % 2 == 1
    named = f.withColumn("signal", F.when(odd, "sysNotEngage").otherwise(F.col("signal")))
    return ep.with_fallback(ep.extract_episodes(named, "err", 0.0, 1.0, DAY), named, "sysNotEngage", DAY).select("sortie", "episode", "start_t", "is_fallback")


#: Three result sets see each episode at shifts A, B and C; B is near both others, which are apart. The sets' order goes with the sortie.
_SETS = """, shifts(j, d) AS (VALUES (0, 0.0::DOUBLE), (1, 0.6::DOUBLE), (2, 1.3::DOUBLE)),
sets AS (SELECT e.sortie, e.episode, e.end_t, j, (j + e.sortie::BIGINT) % 3 AS rank, start_t + d AS start_t FROM eps e, shifts),
taken(s, kept, j) AS (VALUES (0, 0, 0), (0, 0, 1), (0, 2, 2), (1, 2, 2), (1, 2, 1), (1, 0, 0), (2, 1, 0), (2, 1, 1), (2, 1, 2))
"""


def _sets(s, d):
    e = tel.episodes(s, d).select("sortie", "episode", "start_t", "end_t")
    listed = [e.select("sortie", "episode", (F.col("start_t") + x).alias("start_t"), "end_t", F.pmod(F.lit(j) + F.col("sortie").cast("long"), F.lit(3)).cast("int").alias("rank")) for j, x in enumerate((0.0, 0.6, 1.3))]
    return listed[0].unionByName(listed[1]).unionByName(listed[2])


@query(_SETS + "SELECT s.sortie, s.episode, s.rank, s.start_t, s.end_t, count(*) AS n_merged FROM sets s JOIN taken t ON t.s = s.sortie::BIGINT % 3 AND t.kept = s.j GROUP BY ALL")
def merged_episodes(s, d):
    return ep.merge_episodes(ep.merge_groups(_sets(s, d))).select("sortie", "episode", "rank", "start_t", "end_t", "n_merged")


@query(_SETS + """SELECT sortie, rank, episode, from_rank, signal, t, dt, role FROM (
  SELECT k.sortie, k.rank, k.episode, m.rank AS from_rank, x.signal, x.t, x.dt, x.role, row_number() OVER (PARTITION BY k.sortie, k.rank, k.episode, x.signal, x.t ORDER BY m.rank <> k.rank, m.rank) AS n
  FROM sets k JOIN taken t ON t.s = k.sortie::BIGINT % 3 AND t.kept = k.j JOIN sets m ON m.sortie = k.sortie AND m.episode = k.episode AND m.j = t.j
  JOIN ept x ON x.sortie = m.sortie AND x.episode = m.episode AND x.role IS NOT NULL AND x.ord % 3 <> m.rank) WHERE n = 1""")
def merged_transitions(s, d):
    """Each set saw two thirds of an episode's transitions; merged, they are whole again where sets were near enough."""
    sets = store.stored(_sets(s, d), "sets")
    ranks = F.explode(F.array(*[F.lit(i) for i in range(3)]))
    rows = _ept(s, d).withColumn("rank", ranks).where(F.col("ord") % 3 != F.col("rank"))
    return ep.merge_members(ep.merge_groups(sets), rows, ["signal", "t"]).select("sortie", "rank", "episode", "from_rank", "signal", "t", "dt", "role")


@query("SELECT sortie, signal, axis, t, from_v, to_v, is_anchor FROM modes")
def mode_transitions(s, d):
    return tel.modes(s, d).drop("ord")


@query("SELECT sortie, t, from_name, to_name FROM named")
def decoded_modes(s, d):
    return md.decode_modes(tel.modes(s, d)).select("sortie", "t", "from_name", "to_name")


@query("SELECT e.sortie, e.episode AS probe, 'lat' AS axis, e.start_t AS t, m.to_v AS mode FROM eps e ASOF JOIN (SELECT sortie, t, to_v FROM modes) m ON e.sortie = m.sortie AND e.start_t >= m.t")
def modes_at_time(s, d):
    p = tel.episodes(s, d).select("sortie", F.col("start_t").alias("t"), F.col("start_ord").alias("ord"), F.col("episode").alias("probe"))
    return md.modes_at(p, tel.modes(s, d))


@query("SELECT sortie, signal, round(v, 2) AS peak, round(t, 3) AS peak_time FROM (SELECT *, row_number() OVER (PARTITION BY sortie ORDER BY v DESC, t, ord) AS n FROM samples WHERE signal = 'value') WHERE n = 1")
def peak_values(s, d):
    return fleet.peak_values(tel.samples(s, d), F.col("signal") == "value")


@query("SELECT * FROM (SELECT sortie, min(t) FILTER (WHERE to_name = 'navAppr') AS t_lo, max(t) FILTER (WHERE to_name = 'navAppr' OR from_name = 'navAppr') AS t_hi FROM named GROUP BY 1) WHERE t_lo IS NOT NULL")
def phase_window(s, d):
    return md.phase_window(md.decode_modes(tel.modes(s, d)), ["navAppr"])


@query("SELECT * FROM phases")
def phase_intervals(s, d):
    return _phases(s, d)


@query("SELECT p.sortie, p.phase, p.t_lo, p.t_hi, x.signal, arg_min(x.v, x.ord) AS entry_v, arg_max(x.v, x.ord) AS exit_v, max(abs(x.v)) AS max_abs, round(sqrt(avg(x.v * x.v)), 4) AS rms FROM phases p JOIN samples x ON x.sortie = p.sortie AND x.t BETWEEN p.t_lo AND p.t_hi GROUP BY 1, 2, 3, 4, 5")
def phase_stats(s, d):
    return md.phase_stats(_phases(s, d), tel.samples(s, d), DAY)


@query("SELECT e.sortie, e.episode, e.start_t, CASE WHEN max((p.phase = 'approach')::INT) = 1 THEN 'approach' ELSE max(p.phase) END AS phase FROM eps e LEFT JOIN phases p ON p.sortie = e.sortie AND e.start_t BETWEEN p.t_lo AND p.t_hi GROUP BY 1, 2, 3")
def phase_at_fault(s, d):
    return md.phase_at(tel.episodes(s, d), _phases(s, d), ["approach", "takeoff"], DAY)


@query("SELECT sortie, signal, v, t_lo, t_hi, n FROM (SELECT sortie, signal, min(v) AS v, min(t) AS t_lo, max(t) AS t_hi, count(*) AS n FROM (SELECT *, sum(CASE WHEN before IS NULL OR before <> v THEN 1 ELSE 0 END) OVER (PARTITION BY sortie, signal ORDER BY ord) AS run FROM lagged) GROUP BY sortie, signal, run) WHERE t_hi - t_lo >= 86400 AND n > 1")
def flat_segments(s, d):
    return md.flat_segments(tel.samples(s, d).where("signal <> 'value'"), DAY)


@query("""SELECT sortie, t AS t_lo, t_hi FROM (SELECT sortie, t, sum(d) OVER (PARTITION BY sortie ORDER BY t) AS level, lead(t) OVER (PARTITION BY sortie ORDER BY t) AS t_hi FROM (SELECT sortie, t, sum(d) AS d FROM
 (SELECT sortie, t_lo AS t, 1 AS d FROM flats UNION ALL SELECT sortie, t_hi, -1 FROM flats) GROUP BY 1, 2)) WHERE level >= 2 AND t_hi - t >= 86400""".replace("FROM flats", "FROM (SELECT sortie, min(t) AS t_lo, max(t) AS t_hi FROM (SELECT *, sum(CASE WHEN before IS NULL OR before <> v THEN 1 ELSE 0 END) OVER (PARTITION BY sortie, signal ORDER BY ord) AS run FROM lagged) GROUP BY sortie, signal, run HAVING max(t) - min(t) >= 86400 AND count(*) > 1)"))
def flat_together(s, d):
    return md.flat_together(md.flat_segments(tel.samples(s, d).where("signal <> 'value'"), DAY), 2, DAY)


@query("SELECT sortie, signal, t, v, ord FROM (SELECT *, row_number() OVER (PARTITION BY sortie, signal ORDER BY t, ord, v) - 1 AS k, count(*) OVER (PARTITION BY sortie, signal) AS n FROM samples) WHERE n <= 50 OR k IN (SELECT 0) OR list_contains(list_transform(range(50), lambda i: i * n // 50), k)")
def downsample_uniform(s, d):
    return plots.downsample_uniform(tel.samples(s, d), ["sortie", "signal"], 50).select("sortie", "signal", "t", "v", "ord")


_MINMAX = """, k AS (SELECT sortie, signal, t, v, ord, row_number() OVER (PARTITION BY sortie, signal ORDER BY t, ord, v) - 1 AS k, count(*) OVER (PARTITION BY sortie, signal) AS n FROM {rows}),
b AS (SELECT *, CASE WHEN floor((floor(k / (n / {half}.0::DOUBLE)) + 1) * (n / {half}.0::DOUBLE)) <= k THEN floor(k / (n / {half}.0::DOUBLE)) + 1 WHEN floor(floor(k / (n / {half}.0::DOUBLE)) * (n / {half}.0::DOUBLE)) > k THEN floor(k / (n / {half}.0::DOUBLE)) - 1 ELSE floor(k / (n / {half}.0::DOUBLE)) END AS b FROM k WHERE n > 2 * {half}),
r AS (SELECT *, row_number() OVER (PARTITION BY sortie, signal, b ORDER BY v, k) AS lo, row_number() OVER (PARTITION BY sortie, signal, b ORDER BY v DESC, k) AS hi FROM b WHERE b < {half})
SELECT sortie, signal, t, v, ord FROM k WHERE n <= 2 * {half} UNION ALL SELECT sortie, signal, t, v, ord FROM r WHERE lo = 1 OR hi = 1"""


@query(_MINMAX.format(rows="li", half=50))
def downsample_minmax(s, d):
    return plots.downsample_minmax(tel.line_samples(s, d), ["sortie", "signal"], 100)


@query("SELECT e.sortie, e.episode, x.signal, x.t, x.v, x.ord FROM eps e JOIN samples x ON x.sortie = e.sortie AND x.t BETWEEN e.start_t - 43200 AND coalesce(e.end_t, e.start_t) + 43200")
def episode_plots(s, d):
    return plots.episode_plots(tel.episodes(s, d), tel.samples(s, d), DAY / 2, None)


@query("SELECT x.sortie, x.signal, x.t, x.v, x.ord FROM samples x LEFT JOIN (SELECT sortie, min(t) FILTER (WHERE to_name = 'navAppr') AS t_lo, max(t) FILTER (WHERE to_name = 'navAppr' OR from_name = 'navAppr') AS t_hi FROM named GROUP BY 1) w ON w.sortie = x.sortie WHERE w.t_lo IS NULL OR x.t BETWEEN w.t_lo - 10 AND w.t_hi + 5")
def flight_plots(s, d):
    return plots.flight_plots(tel.samples(s, d), md.decode_modes(tel.modes(s, d)), max_pts=None)


@query("SELECT x.sortie, x.signal, x.t, x.v, x.ord FROM samples x JOIN (SELECT sortie, min(t) FILTER (WHERE to_name = 'takeoff') AS t_lo, max(t) FILTER (WHERE to_name = 'takeoff' OR from_name = 'takeoff') AS t_hi FROM named GROUP BY 1) w ON w.sortie = x.sortie WHERE x.t BETWEEN w.t_lo - 10 AND w.t_hi + 30")
def takeoff_plots(s, d):
    return plots.takeoff_plots(tel.samples(s, d), md.decode_modes(tel.modes(s, d)), max_pts=None)


@query("SELECT signal, score, frequency, n_episodes, n_sorties, mean_dt_s, std_dt_s, round(mean_dt_s * 40, 1) AS mean_dt_samples, round(std_dt_s * 40, 1) AS std_dt_samples FROM corr WHERE frequency >= 0.05")
def correlate(s, d):
    return _corr(s, d)


@query("SELECT signal, CASE WHEN mean_dt_s < -1 THEN 'context' WHEN mean_dt_s < -0.05 THEN 'precursor' ELSE 'near-simultaneous' END AS cluster FROM corr WHERE frequency >= 0.05")
def timing_clusters(s, d):
    return _corr(s, d).select("signal", fn.timing_cluster(F.col("mean_dt_s")).alias("cluster"))


@query("""SELECT a.signal, a.from_v AS common_from, b.to_v AS common_to FROM
 (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY c DESC, m) AS r FROM (SELECT signal, from_v, count(*) AS c, min(n) AS m FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY sortie, episode, ord) AS n FROM ept WHERE role IS NOT NULL) WHERE n <= 200 GROUP BY 1, 2)) a
 JOIN (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY c DESC, m) AS r FROM (SELECT signal, to_v, count(*) AS c, min(n) AS m FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY sortie, episode, ord) AS n FROM ept WHERE role IS NOT NULL) WHERE n <= 200 GROUP BY 1, 2)) b ON a.signal = b.signal WHERE a.r = 1 AND b.r = 1""")
def common_direction(s, d):
    return fleet.common_direction(_ept(s, d))


@query("SELECT sortie, episode, signal, dt, place FROM (SELECT *, row_number() OVER (PARTITION BY sortie, episode ORDER BY abs(dt), ord, signal) AS place FROM ept WHERE role IS NOT NULL AND role <> 'trigger') WHERE place <= 10")
def concurrent_signals(s, d):
    return fleet.concurrent(_ept(s, d)).select("sortie", "episode", "signal", "dt", "place")


@query("SELECT e.sortie, e.episode, count(*) AS n_gaps, round(sum(g.duration_s), 3) AS gap_s FROM eps e JOIN gaps g ON g.sortie = e.sortie AND g.t_start <= e.start_t AND e.start_t - g.t_end <= 86400 GROUP BY 1, 2")
def gaps_before(s, d):
    return fleet.gaps_before(tel.episodes(s, d), _gaps(s, d), DAY)


@query("SELECT sortie, episode, category FROM classified")
def classify_faults(s, d):
    return _classified(s, d).select("sortie", "episode", "category")


@query("SELECT category, count(*) AS n, count(DISTINCT sortie) AS n_sorties, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS pct FROM classified GROUP BY 1")
def fault_distribution(s, d):
    return fleet.fault_distribution(_classified(s, d))


@query("SELECT category, axis, mode, count(*) AS n FROM (SELECT c.category, 'lat' AS axis, m.to_v AS mode FROM classified c ASOF JOIN (SELECT sortie, t, to_v FROM modes) m ON c.sortie = m.sortie AND c.start_t >= m.t) GROUP BY CUBE (category, axis, mode)")
def fault_mode_matrix(s, d):
    return fleet.fault_mode_matrix(_classified(s, d), tel.modes(s, d))


@query("SELECT * FROM upstream")
def upstream(s, d):
    return _up(s, d)


@query('SELECT p_name || \'-\' || p_partkey AS signal, hop FROM (WITH RECURSIVE dn(k, hop) AS (SELECT max(p_partkey), 0 FROM part UNION SELECT k // 2, hop + 1 FROM dn WHERE hop < 15 AND k > 0) SELECT k, min(hop) AS hop FROM dn GROUP BY k) JOIN part ON p_partkey = k WHERE hop > 0 AND p_size % 3 = 0')
def downstream(s, d):
    nodes, edges = tel.graph(s, d)
    start = nodes.agg(F.max(F.col("key").cast("long")).cast("string").alias("key"))
    return graph.upstream(nodes, edges, start, forward=True).select("signal", "hop")


@query("SELECT h.hop, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (ORDER BY h.hop)::BIGINT AS cumulative FROM (SELECT unnest(range(1, (SELECT max(hop) FROM upstream) + 1)) AS hop) h LEFT JOIN (SELECT hop, count(*) AS n FROM upstream GROUP BY 1) c ON c.hop = h.hop")
def hop_distribution(s, d):
    return graph.hop_distribution(_up(s, d))


@query("SELECT p_partkey::VARCHAR AS key, (SELECT count(*) FROM part q WHERE q.p_partkey // 2 = p.p_partkey AND q.p_partkey > 0) AS in_degree FROM part p WHERE EXISTS (SELECT 1 FROM part q WHERE q.p_partkey // 2 = p.p_partkey AND q.p_partkey > 0)")
def in_degrees(s, d):
    return graph.in_degree(tel.graph(s, d)[1])


@query("SELECT signal, CASE WHEN model = 'Brand#1' THEN 'removed' ELSE 'added' END AS status FROM upstream WHERE model IN ('Brand#1', 'Brand#2')")
def upstream_diff(s, d):
    u = _up(s, d)
    return graph.upstream_diff(u.where("model <> 'Brand#2'"), u.where("model <> 'Brand#1'"))


@query("SELECT signal, hop FROM upstream WHERE model <> 'Brand#3'")
def coverage_gap(s, d):
    u = _up(s, d)
    return graph.coverage_gap(u, u.where("model = 'Brand#3'")).select("signal", "hop")


@query("SELECT signal, hop, n FROM upstream JOIN (SELECT p_name || '-' || p_partkey AS signal, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) USING (signal)")
def cause_filter(s, d):
    parts = load(s, d, "part").select("p_partkey", F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("signal"))
    seen = load(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n")).join(parts, "p_partkey").select("signal", "n")
    return graph.cause_filter(_up(s, d), seen).select("signal", "hop", "n")


@query("SELECT source, regexp_extract(source, '(?:^|[^A-Za-z])([SG][0-9]{3})', 1) || '_' || regexp_extract(source, '_([0-9])[.]zip', 1) AS sortie, 'N208B' AS tail FROM files")
def sortie_tags(s, d):
    k = F.col("s_suppkey")
    f = load(s, d, "supplier").select(F.concat(F.lit("AFCS_S"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("N208B_"), (k % 4).cast("string"), F.lit(".zip")).alias("source"))
    return fn.with_sortie_tags(f).select("source", "sortie", "tail")


@query("SELECT p_partkey, regexp_extract('FCC1A.g_' || replace(p_brand, '#', '') || '_mdlrefdw.rtb.' || replace(p_name, ' ', ''), '[.]([^.]*)$', 1) AS suffix, 'FCC1A' AS lane, replace(p_brand, '#', '') AS model FROM part")
def signal_parts(s, d):
    sig = F.concat(F.lit("FCC1A.g_"), F.regexp_replace("p_brand", "#", ""), F.lit("_mdlrefdw.rtb."), F.regexp_replace("p_name", " ", ""))
    return fn.with_signal_parts(load(s, d, "part").select("p_partkey", sig.alias("signal"))).select("p_partkey", "suffix", "lane", "model")


@query("SELECT event_id, (event_id % 300) * 86400.0::DOUBLE + (event_id % 24) * 3600 + (event_id % 60) * 60 + (event_id % 59) AS seconds FROM events")
def time_seconds(s, d):
    k = F.col("event_id")
    text = F.concat_ws(":", *[(k % m).cast("string") for m in (300, 24, 60, 59)])
    return load(s, d, "events").select("event_id", fn.time_seconds(text).alias("seconds"))


@query("SELECT p_partkey FROM part WHERE NOT regexp_matches(replace(p_name, ' ', ''), '^(red.*|.*bolt)$')")
def exclude_signals(s, d):
    return fn.exclude_signals(load(s, d, "part").select("p_partkey", F.regexp_replace("p_name", " ", "").alias("signal")), ["red*", "*bolt"]).select("p_partkey")


@query("SELECT p_brand AS source, w AS wanted, arg_min(p_name || '.' || p_type, p_partkey) AS signal FROM part, (VALUES ('ECONOMY'), ('SMALL')) x(w) WHERE p_type = w GROUP BY 1, 2")
def resolve_plot_signals(s, d):
    c = load(s, d, "part").select(F.col("p_brand").alias("source"), F.concat_ws(".", "p_name", "p_type").alias("signal"), F.col("p_partkey").alias("col_ord"))
    return fn.resolve_plot_signals(c, ["ECONOMY", "SMALL"])


@query("SELECT sortie, signal, t, from_v, to_v, ord % 3 AS rank FROM trans")
def merge_transitions(s, d):
    # Each transition is in two sources, the second one of a higher rank.
    rank = F.col("ord") % 3
    return ev.merge_transitions(tel.found(s, d).withColumn("rank", F.explode(F.array(rank, rank + 1))), F.col("rank")).select("sortie", "signal", "t", "from_v", "to_v", "rank")


@query("SELECT sortie, min(t_start) AS t_start, max(t_end) AS t_end, round(max(t_end) - min(t_start), 3) AS duration_s FROM (SELECT *, sum(new) OVER (PARTITION BY sortie ORDER BY t_start) AS n FROM (SELECT *, CASE WHEN t_start <= lag(t_end) OVER (PARTITION BY sortie ORDER BY t_start) THEN 0 ELSE 1 END AS new FROM gaps)) GROUP BY sortie, n")
def merge_gaps(s, d):
    g = _gaps(s, d)
    return ev.merge_gaps(g.unionByName(g.withColumn("source", F.lit("twin"))), dedupe=True)


@query("SELECT sortie, w AS signal FROM (SELECT DISTINCT sortie FROM raw), (VALUES ('err'), ('flap')) x(w) WHERE NOT EXISTS (SELECT 1 FROM trans t WHERE t.sortie = raw.sortie AND t.signal = w)".replace("FROM (SELECT DISTINCT sortie FROM raw),", "FROM (SELECT DISTINCT sortie FROM raw) raw,"))
def backfill_missing(s, d):
    wanted = load(s, d, "events").select(F.when(F.col("event_type") == "error", "err").otherwise("flap").alias("signal")).distinct()
    return backfill.missing_pairs(wanted, tel.raw(s, d), tel.found(s, d))


@query("SELECT patch, sortie, o AS overlap_s FROM (SELECT *, row_number() OVER (PARTITION BY patch ORDER BY o DESC, sortie) AS n FROM (SELECT p.sortie AS patch, r.sortie, round(greatest(least(p.b, r.b) - greatest(p.a, r.a), 0), 3) AS o FROM (SELECT sortie, round(min(t), 3) AS a, round(max(t), 3) AS b FROM raw GROUP BY 1) p, (SELECT sortie, round(min(t), 3) AS a, round(max(t), 3) AS b FROM raw GROUP BY 1) r WHERE least(p.b, r.b) - greatest(p.a, r.a) > -1)) WHERE n = 1")
def best_overlap(s, d):
    e = profile.recording_extent(tel.raw(s, d))
    return backfill.best_overlap(e.withColumnRenamed("sortie", "patch"), e)


@query("SELECT count(*) AS n, count(*) FILTER (WHERE done) AS n_done, count(*) FILTER (WHERE NOT done) AS n_pending, count(*) FILTER (WHERE done AND NOT has) AS n_quiet, round(100.0::DOUBLE * count(*) FILTER (WHERE done) / count(*), 1) AS done_pct FROM (SELECT r.sortie, r.sortie::BIGINT % 5 > 0 AS done, r.sortie IN (SELECT sortie FROM eps) AS has FROM (SELECT DISTINCT sortie FROM raw) r)")
def batch_status(s, d):
    files = tel.raw(s, d).select("sortie").distinct().withColumn("done", F.col("sortie").cast("long") % 5 > 0)
    return fleet.batch_status(files, tel.episodes(s, d))


@query("SELECT count(*) AS n, round(quantile_cont(e, 0.5), 4) AS median_s, max(e) AS max_s, count(*) FILTER (WHERE e <= 100) AS n_short, count(*) FILTER (WHERE e > 100 AND e <= 300) AS n_medium, count(*) FILTER (WHERE e > 300) AS n_long FROM (SELECT o_totalprice / 1000 AS e FROM orders)")
def run_profile(s, d):
    return fleet.run_profile(load(s, d, "orders").select((F.col("o_totalprice") / 1000).alias("elapsed_s")))


@query("SELECT 'sorties' AS measure, count(DISTINCT sortie) AS n FROM raw UNION ALL SELECT 'faults', count(*) FROM eps UNION ALL SELECT 'sorties_affected', count(DISTINCT sortie) FROM eps UNION ALL SELECT 'gaps', count(*) FROM gaps UNION ALL SELECT 'phase_' || phase, count(*) FROM phases GROUP BY phase")
def fleet_summary(s, d):
    return fleet.fleet_summary(tel.raw(s, d), tel.episodes(s, d), _phases(s, d), _gaps(s, d))


@query("SELECT c AS n_episodes, count(*) AS n_sorties, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS pct FROM (SELECT r.sortie, (SELECT count(*) FROM eps e WHERE e.sortie = r.sortie) AS c FROM (SELECT DISTINCT sortie FROM raw) r) GROUP BY 1")
def exposure(s, d):
    return fleet.exposure(tel.episodes(s, d), tel.raw(s, d))


@query("SELECT sortie, count(*) FILTER (WHERE p = 'approach') AS approach, count(*) FILTER (WHERE p = 'takeoff') AS takeoff, count(*) FILTER (WHERE p = 'gap') AS gaps FROM (SELECT sortie, phase AS p FROM phases UNION ALL SELECT sortie, 'gap' FROM gaps) GROUP BY 1")
def ops_per_sortie(s, d):
    return fleet.ops_per_sortie(_phases(s, d), _gaps(s, d), ["approach", "takeoff"])


def queries() -> dict:
    from . import detail, files, patching, phasing  # noqa: F401  (they register their queries here)

    return dict(R)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
