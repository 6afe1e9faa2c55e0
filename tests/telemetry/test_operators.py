"""Telemetry operators on small made-up recordings, with sequential oracles for the folds."""

import collections
import json
import random
import zipfile
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from wakelog.functions import names as fn
from wakelog.operators import backfill, classify, episodes as ep, events as ev, fleet, graph, modes as md, plots, profile
from wakelog.sources import sinks, telemetry as src
from wakelog.streaming import incremental

S = "sortie string, source string, signal string, t double, v double, ord long"
T = "sortie string, source string, signal string, t double, from_v double, to_v double, ord long"


def samples(spark, series, sortie="s1"):
    return spark.createDataFrame([(sortie, "a", sig, float(t), float(v), i) for sig, pts in series.items() for i, (t, v) in enumerate(pts)], S)


def test_time_and_cells(spark):
    rows = spark.createDataFrame([("12.5",), ("01:02:03.5",), ("002:01:00:00",), ("x",), ("1.5d",), ("1_000",), ("nan",), (None,), ("1e400",)], "c string")
    got = [r[0] for r in rows.select(fn.time_seconds(rows["c"])).collect()]
    assert got == [12.5, 3723.5, 176400.0, None, None, None, None, None, None]
    fn.register_functions(spark)
    assert spark.sql("SELECT time_seconds('01:00:00'), signal_suffix('a.b.c'), timing_cluster(-2D)").head()[:] == (3600.0, "c", "context")


def test_names(spark):
    f = spark.createDataFrame([("grp_v2024_S107N208B_2.zip",), ("x_G011ZKMLN.zip",), ("none.zip",)], "source string")
    assert [(r["sortie"], r["tail"], r["label"]) for r in fn.with_sortie_tags(f).collect()] == [("S107_2", "N208B", "S107_2_N208B"), ("G011", "ZKMLN", "G011_ZKMLN"), (None, None, None)]
    s = spark.createDataFrame([("FCC1A.g_abc_mdlrefdw.rtb.latActive",), ("afcsCapable",)], "signal string")
    assert [(r["suffix"], r["lane"], r["model"]) for r in fn.with_signal_parts(s).collect()] == [("latActive", "FCC1A", "abc"), ("afcsCapable", None, None)]
    assert [r[0] for r in fn.exclude_signals(s, fleet.EXCLUDED).collect()] == ["FCC1A.g_abc_mdlrefdw.rtb.latActive"]
    assert fn.time_column(["A", " irig_x "]) == " irig_x " and fn.time_column(["a", "IRIG z"], "loose") == "IRIG z"
    with pytest.raises(ValueError):
        fn.time_column(["a"])


def test_channel_classes(spark):
    s = samples(spark, {"b": [(i, i % 2) for i in range(9)], "e64": [(i, i) for i in range(64)], "e65": [(i, i) for i in range(65)], "f": [(0, 0), (1, 1), (2, 0.5)]})
    got = {r["signal"]: r for r in profile.channel_summary(s).collect()}
    assert {k: r["class"] for k, r in got.items()} == {"b": "bool", "e64": "enum", "e65": "num", "f": "num"}
    assert got["b"]["active_pct"] == 44.4 and got["e64"]["values"] == list(range(64)) and got["f"]["mean"] == 0.5
    assert [r["signal"] for r in ev.transitions(s).where("signal in ('f', 'e65')").collect()] == []
    assert {r["signal"] for r in ev.transitions(s, mode="prefix").collect()} == {"b", "e64", "e65", "f"}


def test_gaps_are_strict(spark):
    raw = spark.createDataFrame([("s", "a", float(t), i) for i, t in enumerate([0, 1.0, 2.001, 5])], "sortie string, source string, t double, ord long")
    assert [(r["t_start"], r["t_end"]) for r in ev.data_gaps(raw).collect()] == [(1.0, 2.001), (2.001, 5.0)]


def fold(rows, tail):
    out, open_, last = [], None, None
    for t, o, sig, opens in sorted(rows):
        if open_ is None and opens and (last is None or t - last > tail):
            open_ = (sig, t)
        elif open_ and not opens and sig == open_[0]:
            out.append((*open_, t))
            open_, last = None, t
    return out + ([(*open_, None)] if open_ else [])


@pytest.mark.parametrize("seed", range(4))
def test_episodes_against_a_fold(spark, seed):
    rnd = random.Random(seed)
    rows = [("s1", "a", rnd.choice(["FCC1A.x.cap", "FCC1B.x.cap", "other"]), float(rnd.randint(0, 60)), *rnd.choice([(1.0, 0.0), (0.0, 1.0)]), i) for i in range(50)]
    got = ep.extract_episodes(spark.createDataFrame(rows, T).repartition(3), "cap").orderBy("episode").collect()
    want = fold([(t, o, sig, f == 1) for _, _, sig, t, f, _, o in rows if sig.endswith(".cap")], 3.0)
    assert [(r["trigger_signal"], r["start_t"], r["end_t"]) for r in got] == want


def test_episodes_of_one_long_sortie(spark):
    # 100,000 edges, once all apart and once all within the tail of one another, so that the chain is long.
    for gap, n in ((4.0, 50_000), (1.0, 16_667)):
        edges = spark.range(100_000).selectExpr("'s1' AS sortie", "'a' AS source", "'cap' AS signal", f"id * {gap}D AS t", "double((id + 1) % 2) AS from_v", "double(id % 2) AS to_v", "id AS ord")
        got = ep.extract_episodes(edges, "cap", tail=3.0).agg(F.count("*").alias("n"), F.max("episode").alias("m"), F.sum("duration_s").alias("s")).head()
        assert (got["n"], got["m"]) == (n, n) and got["s"] == n * gap


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merging_against_a_loop(spark, seed):
    rnd = random.Random(seed)
    listed = sorted((s, r, round(rnd.uniform(0, 12), 1), i) for s in ("s1", "s2") for i, r in enumerate(rnd.choice((0, 1, 2)) for _ in range(25)))
    rows = [(s, r, i, t, None) for s, r, t, i in listed] + [("s3", 0, 1, None, None)]
    want, moves = {("s3", 0, 1): ("s3", 0, 1)}, [(s, r, i, sig, float(rnd.randint(0, 4)), 10 * i + o) for s, r, _, i in listed for o, sig in enumerate("ab")]
    for s, r, t, i in listed:
        if (s, r, i) not in want:
            want.update({(s2, r2, i2): (s, r, i) for s2, r2, t2, i2 in listed if s2 == s and abs(t2 - t) < 1.0 and (s2, r2, i2) not in want})
    groups = ep.merge_groups(spark.createDataFrame(rows, "sortie string, rank int, episode int, start_t double, end_t double").repartition(3))
    assert {(g["sortie"], g["rank"], g["episode"]): (g["sortie"], g["m_rank"], g["m_episode"]) for g in groups.collect()} == want
    assert {(k["sortie"], k["rank"], k["episode"]): k["n_merged"] for k in ep.merge_episodes(groups).collect()} == dict(collections.Counter(want.values()))
    first, place = {}, {(s, r, i): n for n, (s, r, _, i) in enumerate(listed)}
    for s, r, i, sig, t, o in sorted(moves, key=lambda m: (want[m[:3]] != m[:3], place[m[:3]], m[5])):
        first.setdefault((*want[s, r, i], sig, t), o)
    found = ep.merge_members(groups, spark.createDataFrame(moves, "sortie string, rank int, episode int, signal string, t double, ord int"), ["signal", "t"])
    assert {(m["sortie"], m["rank"], m["episode"], m["signal"], m["t"]): m["ord"] for m in found.collect()} == first


def test_episode_roles_and_fallback(spark):
    f = spark.createDataFrame([("s1", "a", "cap", 10.0, 1.0, 0.0, 5), ("s1", "a", "x", 5.0, 0.0, 1.0, 1), ("s1", "a", "x", 4.9, 0.0, 1.0, 0), ("s1", "a", "y", 11.0, 0.0, 1.0, 6), ("s1", "a", "cap", 12.0, 0.0, 1.0, 7), ("s1", "a", "z", 15.0, 0.0, 1.0, 8), ("s1", "a", "z", 15.1, 1.0, 0.0, 9), ("s2", "a", "sysNotEngage", 3.0, 0.0, 1.0, 1)], T)
    e = ep.extract_episodes(f, "cap")
    assert [(r["signal"], r["role"]) for r in ep.episode_transitions(e, f).orderBy("t").collect()] == [("x", "pre"), ("cap", "trigger"), ("y", "during"), ("cap", "during"), ("z", "tail")]
    assert {(r["sortie"], r["is_fallback"]) for r in ep.with_fallback(e, f).collect()} == {("s1", False), ("s2", True)}


def test_modes_and_phases(spark):
    s = samples(spark, {"latActive": [(0, 3), (5, 3), (10, 0), (20, 3), (30, 3)]})
    m = ev.mode_transitions(ev.transitions(s), ev.first_samples(s))
    named = md.decode_modes(m)
    assert [(r["t"], r["to_name"], r["is_anchor"]) for r in named.orderBy("t").collect()] == [(0.0, "navAppr", True), (10.0, "standby", False), (20.0, "navAppr", False)]
    assert md.phase_window(named, ["navAppr"]).head()[:] == ("s1", 0.0, 20.0)
    ends = spark.createDataFrame([("s1", 30.0)], "sortie string, t_max double")
    p = md.phases(md.mode_intervals(named, ends), {"approach": ["navAppr"]})
    assert sorted((r["t_lo"], r["t_hi"]) for r in p.collect()) == [(0.0, 10.0), (20.0, 30.0)]
    probes = spark.createDataFrame([("s1", 10.0, 99, 1), ("s1", 9.9, 99, 2)], "sortie string, t double, ord long, probe int")
    assert {r["probe"]: r["mode"] for r in md.modes_at(probes, m).collect()} == {1: 0.0, 2: 3.0}


@pytest.mark.parametrize("n", [9, 10, 11, 37, 500, 2001])
def test_downsampling(spark, n):
    rnd = random.Random(n)
    pts = [(i, rnd.randint(0, 5)) for i in range(n)]
    s = samples(spark, {"a": pts})
    got = sorted((r["t"], r["v"]) for r in plots.downsample_uniform(s, ["signal"], 10).collect())
    assert got == ([pts[int(i * n / 10)] for i in range(10)] if n > 10 else pts)
    want = pts
    if n > 10:
        want, step = [], n / 5
        for b in range(5):
            part = pts[int(b * step) : int((b + 1) * step)]
            want += sorted({min(part, key=lambda p: (p[1], p[0])), max(part, key=lambda p: (p[1], -p[0]))})
    assert sorted((r["t"], r["v"]) for r in plots.downsample_minmax(s, ["signal"], 10).collect()) == want


def test_classes(spark):
    def rows(n, *moves):
        return [("s", n, "cap", 0.0, 1.0, 0.0, "trigger", 100), *[("s", n, sig, dt, f, t, "pre", i) for i, (sig, dt, f, t) in enumerate(moves)]]

    cases = [
        rows(1, ("apDisc", -1.0, 0.0, 1.0)), rows(2, ("rollRespEng", -1.0, 1.0, 0.0), ("rollRespDebounceOut", -0.5, 0.0, 1.0)), rows(3, ("latCmdEng", -1.0, 1.0, 0.0)), rows(4, ("xMonFlag", 0.01, 0.0, 1.0)), rows(5, ("mistrimX", -1.0, 0.0, 1.0)),
        rows(6, ("adsValid", -1.0, 1.0, 0.0)), rows(7, ("enforceStandby", -1.0, 0.0, 1.0)), rows(8, ("fgCapable", -1.0, 1.0, 0.0)), rows(9), rows(10, ("toga", -1.0, 0.0, 1.0)), rows(11, ("toga", -1.0, 0.0, 1.0), ("afcsEngaged", -0.5, 1.0, 0.0)), rows(12, ("apDisc", -1.0, 0.0, 1.0), ("monFlag", -0.5, 0.0, 1.0)),
    ]
    df = spark.createDataFrame(sum(cases, []), "sortie string, episode int, signal string, dt double, from_v double, to_v double, role string, ord long")
    got = {r["episode"]: r for r in classify.classify(df).collect()}
    names = ["PILOT_CMD", "RESP_MONITOR", "CMD_MONITOR", "MONITOR_FAULT", "MISTRIM", "VALIDITY_LOSS", "ENFORCE_SBY", "CAP_LOST", "UNKNOWN", "UNKNOWN", "PILOT_CMD", "MONITOR_FAULT"]
    assert [got[i + 1]["category"] for i in range(12)] == names
    assert got[2]["confidence"] == "confirmed" and got[2]["evidence"] == "rollrespdebounceout" and got[2]["axis"] == "lateral" and got[1]["confidence"] == "n/a"


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_walks_against_a_queue(spark, monkeypatch, most):
    # With many paths allowed whole ones are followed, without any the walk goes ring by ring.
    monkeypatch.setattr(graph, "MOST_PATHS", most)
    rnd = random.Random(3)
    edges = [(str(rnd.randrange(40)), str(rnd.randrange(40))) for _ in range(70)]
    e = spark.createDataFrame(edges, "srcKey string, dstKey string")
    back = defaultdict(set)
    for a, b in edges:
        back[b].add(a)
    want, todo = {"0": 0}, deque(["0"])
    while todo:
        k = todo.popleft()
        for x in back[k] - set(want):
            want[x] = want[k] + 1
            todo.append(x)
    got = graph.walk(spark.createDataFrame([("0",)], "key string"), e, 40)
    assert {r["key"]: r["hop"] for r in got.collect()} == want


def test_start_and_bridges(spark):
    n = spark.createDataFrame([("M/cap/Logic/Outport:1", "lg", "Logic", "Cap", False, None), ("M/x/Inport:1", "cap", "Inport", "M", True, None), ("a", "src", "Gain", "M", True, None)], "key string, blockName string, blockType string, model string, isTestPoint boolean, testPointName string")
    e = spark.createDataFrame([("a", "M/cap/Logic/Outport:1")], "srcKey string, dstKey string")
    assert [r["key"] for r in graph.start_nodes(n, e, "cap").collect()] == ["M/cap/Logic/Outport:1"]
    assert [tuple(r) for r in graph.virtual_edges(n, e).collect()] == [("M/cap/Logic/Outport:1", "M/x/Inport:1")]


def test_sources(spark, tmp_path):
    text = "time,FCC1A.a.cap,b\n,1,\n0.0,1,2.5\n\n00:00:01,0,x\n2.0,0,nan,9\n3.0,1\n"
    (tmp_path / "w.csv").write_text(text)
    raw = src.read_telemetry_csv(spark, str(tmp_path / "w.csv"))
    got = sorted((r["signal"], r["t"], r["v"]) for r in src.csv_to_long(raw, ["FCC1A.a.cap", "b"]).collect())
    want = [("FCC1A.a.cap", 0.0, 1.0), ("FCC1A.a.cap", 1.0, 0.0), ("FCC1A.a.cap", 2.0, 0.0), ("FCC1A.a.cap", 3.0, 1.0), ("b", 0.0, 2.5)]
    assert got == want
    with zipfile.ZipFile(tmp_path / "S001N208B_1.zip", "w") as z:
        z.writestr("a.csv", text)
        z.writestr("b.csv", text)
    for mounted in (False, True):
        z1 = src.read_telemetry_archives(spark, [str(tmp_path / "S001N208B_1.zip")], mounted=mounted)
        assert sorted((r["signal"], r["t"], r["v"]) for r in z1.collect()) == want
        assert src.read_telemetry_archives(spark, [str(tmp_path / "S001N208B_1.zip")], "all", mounted=mounted).count() == 2 * len(want)
        few = src.read_telemetry_archives(spark, [str(tmp_path / "S001N208B_1.zip")], columns=["cap"], mounted=mounted)
        assert sorted((r["signal"], r["t"], r["row_ord"], r["col_ord"]) for r in few.collect()) == [("FCC1A.a.cap", float(i), i + 1, 1) for i in range(4)]
    (tmp_path / "docs").mkdir()
    tr = [{"signal": "cap", "time": "10.0", "from": 1, "to": 0, "row_idx": 3}]
    (tmp_path / "docs/analysis_S001.json").write_text(json.dumps({"filename": "x", "episodes": [{"episode": 1, "start_time": "10.0", "transitions": tr}], "data_gaps": [{"t_start": 1, "t_end": 2, "duration_s": 1}]}))
    (tmp_path / "docs/analysis_S002.json").write_text('{"filename": "y", "epi')
    tables = src.read_analysis(spark, str(tmp_path / "docs"))
    assert tables["corrupt"].count() == 1 and tables["episodes"].head()["start_t"] == 10.0 and tables["episode_transitions"].head()["dt"] == 0.0
    # S001 comes before its leg S001_1, which the archive names.
    assert [(r["sortie"], r["kind"]) for r in src.discover(spark, str(tmp_path)).collect()] == [("S001", "analysis"), ("S001_1", "archive"), ("S002", "analysis")]
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"key": "a", "model": "x"}, {"key": "a", "model": "y"}], "edges": [{"srcKey": "a", "dstKey": "b"}]}))
    nodes, edges = src.read_trace_graph(spark, str(tmp_path / "g.json"))
    assert nodes.head()["model"] == "y" and edges.count() == 1


def test_cells_in_chunks(monkeypatch):
    import io

    from wakelog.sources import cells

    text = 'irig,"a,b",c\r\n"1.5","2",+3\r\n\r\n002:01:00:00,x,.5\r\nbad,1,1\r\n7,1e400,4.\r\n8'
    want = [(0, 1, "a,b", 1.5, 2.0), (0, 2, "c", 1.5, 3.0), (1, 2, "c", 176400.0, 0.5), (3, 2, "c", 7.0, 4.0)]
    for size in (7, 30, 1000):
        monkeypatch.setattr(cells, "CHUNK", size)
        rows = [r for b in cells.long_batches(io.BytesIO(text.encode()), "s", "m") for r in b.to_pylist()]
        assert sorted((r["row_ord"], r["col_ord"], r["signal"], r["t"], r["v"]) for r in rows) == want
    assert list(cells.long_batches(io.BytesIO(b""), "s", "m")) == []


def test_sinks_and_incremental(spark, tmp_path):
    pts = samples(spark, {"a": [(0, 1), (1, 2)]})
    sinks.write_hires(pts, str(tmp_path / "hi"))
    assert json.loads(spark.read.text(str(tmp_path / "hi")).head()["value"]) == {"flight_plots": {"a": [[0.0, 1.0], [1.0, 2.0]]}}
    sinks.write_report(spark.createDataFrame([("x", 0.5)], "signal string, score double"), {"pre": 5.0}, "correlations", str(tmp_path / "rep"))
    assert json.loads(spark.read.text(str(tmp_path / "rep")).head()["value"]) == {"pre": 5.0, "correlations": [{"signal": "x", "score": 0.5}]}
    pts.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        incremental.run_incremental(spark, str(tmp_path / "in"), S, str(tmp_path / "ck"), str(tmp_path / "out"), lambda df: df.select("sortie", "signal", "t"))
    assert incremental.read_incremental(spark, str(tmp_path / "out"), "sortie string, signal string, t double").count() == 2


def test_backfill_and_sets(spark):
    old = spark.createDataFrame([("s", "a", 1.0)], "sortie string, signal string, v double")
    new = spark.createDataFrame([("s", "a", 2.0), ("s", "b", 3.0)], "sortie string, signal string, v double")
    once = backfill.upsert(old, new, ["sortie", "signal"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, backfill.upsert(once, new, ["sortie", "signal"]).collect())) == [("s", "a", 1.0), ("s", "b", 3.0)]
    assert sorted(map(tuple, backfill.upsert(old, new, ["sortie", "signal"], True).collect())) == [("s", "a", 2.0), ("s", "b", 3.0)]
    rec = spark.createDataFrame([("r1", 0.0, 10.0), ("r2", 5.0, 30.0)], "sortie string, t_min double, t_max double")
    patch = spark.createDataFrame([("p", 8.0, 20.0), ("q", 100.0, 120.0)], "patch string, t_min double, t_max double")
    assert [tuple(r) for r in backfill.best_overlap(patch, rec).collect()] == [("p", "r2", 12.0)]


def test_labels_and_time_columns(spark):
    f = spark.createDataFrame([(x,) for x in ("in/S1024N208B_1.zip", "S119_2.zip", "S10N208B_1.zip", "grp_s102n208b_3.zip", "XS102N208B_1.zip")], "source string")
    got = [(r["sortie"], r["tail"], r["label"]) for r in fn.with_sortie_tags(f).collect()]
    assert got == [("S1024_1", "N208B", "S1024_1_N208B"), ("S119", None, None), ("S10_1", "N208B", "S10_1_N208B"), ("S102_3", "N208B", "S102_3_N208B"), (None, None, None)]
    for name in ("tsec", "timesec", "reltime", "elapsed_s", "runtime", "missiontime", "testtime"):
        assert fn.time_column(["a", name]) == name
    assert fn.time_column(["clock", "utc", "irig"]) == "irig"
    names = spark.createDataFrame([(x,) for x in ("FCC1A.g_abc_mdlref.rtb.x", "FCC1A.g_abc_mdl.rtb.x", "FCC1A.g_abc.rtb.x", "FMS1.A743.lat.x")], "signal string")
    assert [r["model"] for r in fn.with_signal_parts(names).collect()] == ["abc", "abc", "abc", None]


def test_sql_times_are_those_of_the_column(spark):
    fn.register_functions(spark)
    cells = ["12.5", "01:02:03.5", "002:01:00:00", "1.5d", "nan", "1:2:3d", "1.5:2:3", " 7 ", "1e400", "", None]
    got = spark.createDataFrame([(c,) for c in cells], "c string").selectExpr("c", "time_seconds(c) AS f").withColumn("e", fn.time_seconds(F.col("c"))).collect()
    assert [r["f"] for r in got] == [r["e"] for r in got] == [12.5, 3723.5, 176400.0, None, None, None, None, 7.0, None, None, None]


def test_csv_files_with_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,x,y\n1,10,20\n2,11,21\n")
    (tmp_path / "b.csv").write_text("y,time,x,z\n22,3,12,5\n")
    got = src.csv_to_long(src.read_telemetry_csv(spark, str(tmp_path)), ["x", "y", "z"]).collect()
    assert sorted((r["t"], r["signal"], r["v"]) for r in got) == [(1, "x", 10), (1, "y", 20), (2, "x", 11), (2, "y", 21), (3, "x", 12), (3, "y", 22), (3, "z", 5)]


def test_graph_cases(spark):
    node = lambda k, kind="Logic", block=None, model="M": (k, block or k, kind, model, True, None)
    nodes = spark.createDataFrame([node("top"), node("l"), node("r"), node("end"), node("in", "Inport", "sigA"), node("p1", block="sigA"), node("p2", block="sigA"), node("q1"), node("q2")], "key string, blockName string, blockType string, model string, isTestPoint boolean, testPointName string")
    # A diamond, a cycle, a node that the graph does not describe, and a dead end that two nodes of one name may feed.
    edges = spark.createDataFrame([("l", "top"), ("r", "top"), ("end", "l"), ("end", "r"), ("top", "end"), ("gone", "l"), ("behind", "gone"), ("in", "r"), ("q1", "p1"), ("q2", "p2")], "srcKey string, dstKey string")
    start = nodes.where("key = 'top'").select("key")
    assert {r["key"]: r["hop"] for r in graph.walk(start, edges, 15, nodes=nodes).collect()} == {"top": 0, "l": 1, "r": 1, "end": 2, "gone": 2, "in": 2}
    assert {(r["srcKey"], r["dstKey"]) for r in graph.virtual_edges(nodes, edges).collect()} == {("p1", "in"), ("p2", "in")}
    bridged = edges.unionByName(graph.virtual_edges(nodes, edges))
    got = {r["key"]: r["hop"] for r in graph.walk(start, bridged, 15, nodes=nodes).collect()}
    assert got["p1"] == got["p2"] == 3 and got["q1"] == got["q2"] == 4
    assert {r["key"] for r in graph.walk(start, edges, 1, nodes=nodes).collect()} == {"top", "l", "r"}


def test_classes_of_single_episodes(spark):
    form = "sortie string, episode int, signal string, t double, dt double, from_v double, to_v double, role string, ord long"
    cases = {
        1: [("FCC.toga", -1.0, 0, 1), ("FCC.fgAfcsEngaged", -0.5, 1, 0)], 2: [("FCC.toga", -1.0, 0, 1)],
        3: [("x.rollRespEng", -0.2, 1, 0), ("x.pitchRespDebounceOut", -0.3, 0, 1)], 4: [("x.pitchRespEng", 0.04, 1, 0), ("x.rollRespEng", -0.5, 1, 0), ("x.rollRespDebounceOut", 2.0, 0, 3)],
        5: [("x.apDisc", -1.0, 0, 1), ("x.monFlag", -0.5, 0, 1)], 6: [("x.adsValid", -0.5, 1, 0), ("x.irsHealthy", -0.9, 1, 0)], 7: [("x.apCapable", 0.0, 1, 0)],
    }
    rows = [("s", e, sig, 10 + dt, dt, float(a), float(b), "pre", i) for e, c in cases.items() for i, (sig, dt, a, b) in enumerate(c)]
    rows += [("s", e, "x.afcsCapable", 10.0, 0.0, 1.0, 0.0, "trigger", 99) for e in cases]
    found = spark.createDataFrame(rows, form)
    got = {r["episode"]: (r["category"], r["label"], r["evidence"], r["confidence"]) for r in classify.classify(found).collect()}
    assert got[1] == ("PILOT_CMD", "Pilot Deactivation (TOGA/QD)", "toga", "n/a") and got[2][:2] == ("UNKNOWN", "Unknown Exit")
    assert got[3] == ("RESP_MONITOR", "Response Monitor Trip", "rollrespeng", "unconfirmed") and got[4][2:] == ("rollrespdebounceout", "confirmed")
    assert got[5][0] == "MONITOR_FAULT" and got[6][:3] == ("VALIDITY_LOSS", "IRS Validity Loss", "irshealthy") and got[7][0] == "UNKNOWN"
    located = classify.locate_trigger(found.withColumn("role", F.lit(None).cast("string")), "AFCSCAPABLE", 1.0, 0.0)
    assert {r["episode"]: r["category"] for r in classify.classify(located).collect()} == {e: g[0] for e, g in got.items()}


def test_ranked_report(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{i}", float(i)) for i in range(20)], "signal string, score double").repartition(5)
    sinks.write_report(rows, {"top": 20}, "correlations", str(tmp_path / "r"), [F.desc("score")])
    doc = json.loads("".join(p.read_text() for p in (tmp_path / "r").glob("*.txt")))
    assert [c["score"] for c in doc["correlations"]] == [float(i) for i in range(19, -1, -1)] and doc["top"] == 20


def test_late_files_add_to_a_sortie(spark, tmp_path):
    run = lambda: incremental.run_incremental(spark, str(tmp_path / "in"), "sortie string, v long", str(tmp_path / "c"), str(tmp_path / "out"), lambda df: df.groupBy("sortie").agg(F.sum("v").alias("v")).where("v < 1000"))
    for part, want in (([("a", 1), ("b", 2)], {"a": 1, "b": 2}), ([("a", 10)], {"a": 11, "b": 2}), ([("b", 1000), ("c", 5)], {"a": 11, "c": 5})):
        spark.createDataFrame(part, "sortie string, v long").write.mode("append").parquet(str(tmp_path / "in"))
        run()
        # What a sortie had before goes, even where its new analysis is empty.
        assert {r["sortie"]: r["v"] for r in incremental.read_incremental(spark, str(tmp_path / "out"), "v long, sortie string").collect()} == want


def test_correlation_window_and_rounding(spark):
    form = "sortie string, episode int, signal string, dt double, from_v double, to_v double, ord long"
    rows = [("s", 1, "FCC1A.g_m_mdl.rtb.x", -1.00049, 0.0, 1.0, 1), ("s", 2, "FCC1B.g_m_mdl.rtb.x", -1.0, 0.0, 1.0, 1), ("s", 1, "FCC1A.g_m_mdl.rtb.x", -9.0, 1.0, 0.0, 0), ("s", 2, "FCC1A.g_m_mdl.rtb.x", -8.0, 1.0, 0.0, 0), ("s", 2, "FCC1A.g_m_mdl.rtb.x", -7.0, 1.0, 0.0, 2), ("s", 1, "a.b.apCapable", -0.1, 1.0, 0.0, 3)]
    found = spark.createDataFrame(rows, form)
    got = fleet.fleet_correlation(found.select("sortie", "episode"), found, "model_suffix").collect()
    assert [(r["place"], r["signal"], r["model"], r["mean_dt_s"], r["mean_dt_samples"], r["common_from"], r["common_to"]) for r in got] == [(1, "x", "m", -1.0, -40.0, 0.0, 1.0)]


def test_zero_positions_are_no_positions(spark):
    s = samples(spark, {"GNSS_Latitude": [(0, 0), (1, 52)], "alt": [(0, 0), (1, 9)]})
    m = md.decode_modes(spark.createDataFrame([], "sortie string, signal string, axis string, t double, from_v double, to_v double, is_anchor boolean, ord long"))
    assert sorted((r["signal"], r["v"]) for r in plots.flight_plots(s, m).collect()) == [("GNSS_Latitude", 52.0), ("alt", 0.0), ("alt", 9.0)]
