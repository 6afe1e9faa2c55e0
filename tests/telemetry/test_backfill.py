"""Back-fill, generations, documents and phases on small made-up recordings."""

import json
import random

import pytest
from pyspark.sql import functions as F

from wakelog.functions import names as fn
from wakelog.operators import modes as md
from wakelog.sources import generations as gen, patches, sinks, telemetry as src
from wakelog.streaming import incremental


def test_generations_replace_and_empty_keys(spark, tmp_path):
    out, form = str(tmp_path / "g"), "v int, k string"
    rows = lambda x: spark.createDataFrame(x, form)
    assert gen.read_generations(spark, out, form, ["k"]).collect() == [] and gen.next_run(spark, out, "k string") == 0
    gen.write_generation(rows([(1, "a"), (2, "a"), (3, "b")]), rows([(0, "a"), (0, "b"), (0, "c")]), out, 0, ["k"])
    gen.write_generation(rows([(9, "b")]), rows([(0, "a"), (0, "b")]), out, gen.next_run(spark, out, "k string"), ["k"])
    now = lambda: sorted((r["k"], r["v"]) for r in gen.read_generations(spark, out, form, ["k"]).collect())
    assert now() == [("b", 9)]
    # A run that is repeated takes the place of itself.
    gen.write_generation(rows([(7, "b")]), rows([(0, "a"), (0, "b")]), out, 1, ["k"])
    assert now() == [("b", 7)] and gen.next_run(spark, out, "k string") == 2


def test_backfilled_plots(spark, tmp_path):
    (tmp_path / "s=S1").mkdir(), (tmp_path / "s=S2").mkdir()
    (tmp_path / "s=S1/a.csv").write_text("time,FCC1A.flap,FCC1B.flap,junk\n" + "".join(f"{i},{i},5,x\n" for i in range(40)))
    (tmp_path / "s=S1/b.csv").write_text("time,FCC1A.flap\n1,99\n")
    (tmp_path / "s=S2/c.csv").write_text("other,rec_time\n1,0\n")
    modes = spark.createDataFrame([("S1", 12.0, "standby", "navAppr"), ("S1", 20.0, "navAppr", "standby")], "sortie string, t double, from_name string, to_name string")
    eps = spark.createDataFrame([("S1", 1, 35.0, None)], "sortie string, episode int, start_t double, end_t double")
    sorties = spark.createDataFrame([("S1",), ("S2",)], "sortie string")
    out, of = str(tmp_path / "out"), F.regexp_extract("path", "s=([^/]*)/", 1)
    run = lambda **k: patches.backfill_plots(spark, out, str(tmp_path / "s=*/*.csv"), of, ["flap", "gone"], modes, eps, sorties, margin=3.0, **k)
    assert [(r["sortie"], r["signal"], r["header"], r["path"][-5:]) for r in run().collect()] == [("S1", "flap", "FCC1A.flap", "a.csv")]
    points = lambda scope: sorted((r["t"], r["v"]) for r in patches.stored_points(spark, out).where(F.col("scope") == scope).collect())
    assert points("flight") == [(float(i), float(i)) for i in range(2, 26)] and points("takeoff") == []
    assert points("episode") == [(float(i), float(i)) for i in range(32, 39)]
    # Nothing is missing any more but what no file has; with force all is made anew.
    assert run().collect() == []
    (tmp_path / "s=S1/a.csv").write_text("time,FCC1A.flap\n100,1\n")
    assert run(force=True).count() == 1 and points("flight") == points("episode") == []


def stored_document(spark, out, more=None, sortie="S1"):
    doc = {"filename": "x", "rec_start_s": 100.0, "duration_s": 50.0, "bool_channels": [{"name": "FCC1A.cap", "active_count": 1, "total_count": 2, "active_pct": 50.0}], **(more or {})}
    rows = spark.createDataFrame([(json.dumps(doc), sortie)], "document string, sortie string")
    gen.write_generation(rows, rows, out, gen.next_run(spark, out, "sortie string"), ["sortie"])


def test_patched_histories(spark, tmp_path):
    out = str(tmp_path / "docs")
    stored_document(spark, out)
    stored_document(spark, out, {"rec_start_s": 1000.0, "sysNotEngage": [{"signal": "a", "time": "1", "from": 0, "to": 1}]}, "S2")
    moves = spark.createDataFrame([("p", "FCC1A.sysNotEngage", 120.5, 0.0, 1.0, 7), ("p", "FCC1A.sysNotEngage", 110.0, 1.0, 0.0, 3), ("q", "sysNotEngage", 1010.0, 0.0, 1.0, 1)], "patch string, signal string, t double, from_v double, to_v double, ord long")
    extents = spark.createDataFrame([("p", 90.0, 130.0), ("q", 1000.0, 1020.0)], "patch string, t_min double, t_max double")
    patch = lambda **k: [tuple(r) for r in patches.patch_histories(spark, out, moves, extents, "sysNotEngage", **k).orderBy("sortie").collect()]
    assert patch() == [("S1", "p")] and patch() == []
    docs = {r["sortie"]: json.loads(r["document"]) for r in patches.documents(spark, out).collect()}
    assert [(m["time"], m["from"], m["to"]) for m in docs["S1"]["sysNotEngage"]] == [("110.0", 1.0, 0.0), ("120.5", 0.0, 1.0)]
    assert [b["name"] for b in docs["S1"]["bool_channels"]] == ["FCC1A.cap", "FCC1A.sysNotEngage"] and docs["S1"]["filename"] == "x"
    assert patch(force=True) == [("S1", "p"), ("S2", "q")]


def test_torque_of_documents(spark, tmp_path):
    out, move = str(tmp_path / "docs"), lambda t, v, s="a.latActiveEnum": {"signal": s, "time": str(t), "from": 0, "to": v}
    stored_document(spark, out, {"mode_transitions": [move(1, 2), move(4, 3), move(4, 1), move(9, 0), move(2, 5, "b.atActiveEnum")]})
    plots = {"flight_plots": {"x.rollTorq": [[3.0, 5.0], [5.0, 7.125], [6.0, 7.125]], "x.torqLimit": [[1.0, 99.0]], "y.torque": [], "z.pitchTorq": [[1.0, 2.0]]}, "takeoff_plots": {"x.rollTorq": [[1.0, 7.125]], "z.pitchTorq": [[2.0, 2.5]]}}
    hires = spark.createDataFrame([("S1", json.dumps(plots))], "sortie string, document string")
    got = {r["signal"]: (r["peak"], r["peak_time"], r["modes"]) for r in patches.torque_from_documents(patches.documents(spark, out), hires).collect()}
    assert got == {"x.rollTorq": (7.13, 5.0, {"latActiveEnum": 1.0, "atActiveEnum": 5.0}), "z.pitchTorq": (2.5, 2.0, {"latActiveEnum": 2.0, "atActiveEnum": 5.0})}
    assert patches.backfill_torque(spark, out, hires).count() == 1 and patches.backfill_torque(spark, out, hires).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_cards_against_a_loop(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for s in ("s1", "s2", "s3"):
        for phase in ("approach", "landing"):
            t = 0
            for _ in range(6):
                t += rnd.randint(1, 6)
                rows.append((s, phase, float(t), float(t + rnd.randint(0, 5))))
                t = rows[-1][3]
    rows += [("s1", "takeoff", 0.0, 3.0)]
    want = [("s1", "takeoff", 0.0, 3.0, None)]
    for s in ("s1", "s2", "s3"):
        islands = []
        for r in sorted((r for r in rows if r[0] == s and r[1] != "takeoff"), key=lambda r: r[2:]):
            if islands and r[2] <= max(x[3] for x in islands[-1]):
                islands[-1].append(r)
            else:
                islands.append([r])
        for i in islands:
            first = min((r[2] for r in i if r[1] == "approach"), default=None)
            later = [r[2] for r in i if r[1] == "landing" and first is not None and r[2] >= first]
            want += [(s, "approach_landing", min(r[2] for r in i), max(r[3] for r in i), min(later))] if later else [(*r, None) for r in i]
    found = md.phase_cards(spark.createDataFrame(rows, "sortie string, phase string, t_lo double, t_hi double").repartition(3))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_flat_inside_phases(spark):
    seg = spark.createDataFrame([("s", "a", 0.0, 10.0), ("s", "b", 4.0, 20.0), ("s", "c", 6.0, 8.0), ("s", "a", 10.0, 30.0), ("s", "b", 40.0, 50.0), ("s", "c", 45.0, 60.0)], "sortie string, signal string, t_lo double, t_hi double")
    p = spark.createDataFrame([("s", "approach", 5.0, 15.0), ("s", "landing", 15.0, 47.0), ("s", "landing", 50.0, 55.0)], "sortie string, phase string, t_lo double, t_hi double")
    got = sorted(tuple(r) for r in md.flat_in_phases(seg, p, 2, 2.0, 7.0).collect())
    assert got == [("s", "approach", 5.0, 15.0, 3), ("s", "landing", 15.0, 20.0, 2), ("s", "landing", 45.0, 47.0, 2)]


def test_tracking_and_touchdown(spark):
    form = "sortie string, signal string, t double, v double, ord long"
    x = spark.createDataFrame([("s", "x.cmd", 0.0, 1.0, 0), ("s", "x.act", 0.0, 3.0, 0), ("s", "x.act", 1.5, 9.0, 1), ("s", "x.cmd", 2.0, 4.0, 2), ("s", "x.cmd", 2.0, 5.0, 3), ("s", "x.act", 2.5, 4.0, 4)], form)
    errors = md.tracking_errors(x, "act", "cmd", 1.0)
    assert sorted((r["t"], r["error"]) for r in errors.collect()) == [(0.0, 2.0), (2.5, -1.0)]
    p = spark.createDataFrame([("s", "landing", 0.0, 2.5)], "sortie string, phase string, t_lo double, t_hi double")
    assert [(r["n"], r["max_abs"], r["rms"]) for r in md.phase_tracking(p, errors).collect()] == [(2, 2.0, 1.5811)]
    down = spark.createDataFrame([("s", "wow", 0.5, 0.0, 1.0), ("s", "wow", 1.0, 1.0, 0.0), ("s", "wow", 2.0, 0.0, 1.0), ("s", "wow", 9.0, 0.0, 1.0)], "sortie string, signal string, t double, from_v double, to_v double")
    place = spark.createDataFrame([("s", "lat", 1.0, 50.0, 0), ("s", "lat", 2.1, 51.0, 1)], form)
    assert [tuple(r) for r in md.touchdowns(p, down, place, "wow", {"lat": "lat", "lon": "lon"}).collect()] == [("s", "landing", 0.0, 2.5, 2.0, 50.0, None)]


def test_files_and_queue(spark, tmp_path):
    for name in ("traceData_v1.json", "traceData_v2.json", "other_v9.json"):
        (tmp_path / name).write_text("{}")
    assert src.latest_trace_graph(spark, str(tmp_path)).endswith("traceData_v2.json")
    names = spark.createDataFrame([("S102_1",), ("G3",), (None,)], "sortie string")
    assert [r["trace_graph"] for r in fn.with_named_graph(names, {"2_": "a", "S1": "b"}, "z").collect()] == ["a", "z", "z"]
    manifest = str(tmp_path / "m")
    sinks.write_manifest(spark.createDataFrame([("S1", "ok", 2.0), ("S2", "ok", 3.0)], "sortie string, status string, elapsed_s double"), manifest)
    sinks.requeue_corrupt(spark.createDataFrame([("x/S2.json",)], "path string"), F.regexp_extract("path", "(S[0-9]+)", 1), manifest, 1)
    files = spark.createDataFrame([("S1",), ("S2",), ("S3",)], "sortie string")
    assert sorted(r["sortie"] for r in incremental.pending(files, spark.read.parquet(manifest)).collect()) == ["S2", "S3"]
