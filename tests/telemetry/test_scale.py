"""Operators whose work must grow with their input: results against plain loops, and what they hold on the way."""

import collections
import random
import re

from pyspark.sql import functions as F

from wakelog.operators import backfill, classify, events as ev, graph
from wakelog.sources import patches, sinks, telemetry as src


def test_bridges_are_decided_by_name_and_shared(spark):
    """the bridges against plain loops; dead ends that share theirs are walked without the pairs of the third rule."""
    rng, nodes = random.Random(5), []
    for i in range(160):
        model, block = rng.choice(["Siga", "Sigb", "SigLogic", "M"]), rng.choice(["siga", "Siga", "sigb", "sigLogic", "x", "", "long" * 9])
        logic = rng.choice(["sigalogic", "SIGBLogic", "xlogicLogic", "logic", "plain", "long" * 9 + "Logic"])
        nodes.append((f"{model}/{logic}/{i}/{rng.choice(['siga', 'top'])}/{rng.choice(['Outport:1', 'Inport:1'])}", block, rng.choice(["Inport", "Inport", "Logic", "Gain"]), model, True, None))
    edges = [(rng.choice(nodes)[0], n[0]) for n in nodes if rng.random() < 0.4]
    degree = collections.Counter(b for _, b in edges)
    want = set()
    for key, block, kind, model, *_ in nodes:
        if kind != "Inport" or degree[key]:
            continue
        fed = [n for n in nodes if degree[n[0]]]
        gates = [n for n in fed if "Outport:1" in n[0] and n[2] in graph.START_TYPES and n[3] == block[:1].upper() + block[1:]]
        logic = [n for n in fed if "Outport:1" in n[0] and n[3] == model and block.lower() + "logic" in n[0].lower()]
        if gates:
            want.add((min(gates, key=lambda n: (block.lower() not in n[0].split("/")[-2].lower(), -degree[n[0]], n[0]))[0], key))
        elif logic:
            want.add((min(logic, key=lambda n: (-degree[n[0]], n[0]))[0], key))
        else:
            want |= {(n[0], key) for n in fed if n[1] == block}
    n = spark.createDataFrame(nodes, "key string, blockName string, blockType string, model string, isTestPoint boolean, testPointName string")
    e = spark.createDataFrame(edges, "srcKey string, dstKey string")
    got = [tuple(r) for r in graph.virtual_edges(n, e).collect()]
    assert len(got) == len(want) and set(got) == want and len({b for _, b in want}) < len(want)
    plain = graph.upstream(n, e.unionByName(spark.createDataFrame(sorted(want), "srcKey string, dstKey string")), graph.start_nodes(n, e, "siga"), 6)
    assert sorted(graph.bridged_upstream(n, e, "siga", 6).select("signal", "hop").collect()) == sorted(plain.select("signal", "hop").collect())
    # What is written for the walk stays below nodes and edges; before, it held the pairs.
    shared = graph._bridges(n, e)
    assert shared[0].count() + shared[1].count() + shared[2].count() <= 2 * len(nodes)


def test_pairs_of_a_name_are_dealt_in_tiles(spark, tmp_path, monkeypatch):
    """one name's pairs are shared by tasks and small as Parquet; before, one task wrote them with every key in full."""
    fed, dead = [f"{'p' * 250}/f{i}" for i in range(5000)], [f"d{i}" for i in range(120)]
    nodes = spark.createDataFrame([(k, "same", "Gain", "M") for k in fed] + [(k, "same", "Inport", "M") for k in dead], "key string, blockName string, blockType string, model string")
    graph.virtual_edges(nodes, spark.createDataFrame([("root", k) for k in fed], "srcKey string, dstKey string")).write.parquet(str(tmp_path / "out"))
    pairs = spark.read.parquet(str(tmp_path / "out"))
    assert pairs.count() == pairs.distinct().count() == len(fed) * len(dead)
    assert {r[0] for r in pairs.select("srcKey").distinct().collect()} == set(fed) and {r[0] for r in pairs.select("dstKey").distinct().collect()} == set(dead)
    assert max(r["count"] for r in pairs.groupBy(F.input_file_name()).count().collect()) < 0.7 * len(fed) * len(dead)
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < len(fed) * len(dead)
    # Small tiles against plain loops: names of all sizes, on one side only, and nodes that are there twice.
    for name, n in (("TILE", 8), ("RUN", 2), ("TASK_PAIRS", 200)):
        monkeypatch.setattr(graph, name, n)
    rng = random.Random(14)
    ends, heads = ([(f"{kind}{rng.randrange(300)}", rng.choice(["a", "a", "a", "b", "c", "", only])) for _ in range(200)] for kind, only in (("d", "x"), ("f", "y")))
    got = graph._paired(spark.createDataFrame(ends, "dstKey string, blockName string"), spark.createDataFrame([(b, k) for k, b in heads], "blockName string, srcKey string"))
    assert got.columns == ["srcKey", "dstKey"]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter((f, d) for f, a in heads for d, b in ends if a == b)
    none = graph._paired(spark.createDataFrame([], "dstKey string, blockName string"), spark.createDataFrame([("a", "k")], "blockName string, srcKey string"))
    assert none.collect() == []


def test_recordings_within_others_do_not_meet_patches(spark):
    """the best overlap against all pairs, and few recordings left where they share their time."""
    rng = random.Random(6)
    span = lambda: sorted(rng.choice([0.1 * rng.randrange(300), rng.uniform(0, 30)]) for _ in range(2))
    recs = [(f"r{rng.randrange(400)}", *span()) for _ in range(600)]
    pats = [(f"p{i}", *span()) for i in range(300)] + [("far", 500.0, 501.0), ("point", 7.0, 7.0)]
    want = {}
    for p, a, b in pats:
        found = [(-(min(b, d) - max(a, c)), r) for r, c, d in recs if min(b, d) - max(a, c) > -1.0]
        if found:
            want[p] = (min(found)[1], round(max(0.0, -min(found)[0]), 3))
    r = spark.createDataFrame([*recs, (None, 1.0, 2.0), ("r1", None, 2.0)], "sortie string, t_min double, t_max double").where("sortie is not null")
    p = spark.createDataFrame(pats, "patch string, t_min double, t_max double")
    got = {x["patch"]: (x["sortie"], x["overlap_s"]) for x in backfill.best_overlap(p, r).collect()}
    assert got.keys() == want.keys() and "far" not in got
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 0.0011 for k in want)
    left = {tuple(x) for x in backfill.uncovered(r).where("t_min is not null").collect()}
    assert left == {x for x in set(recs) if not any(y[1] <= x[1] and y[2] >= x[2] and y[0] <= x[0] and y != x for y in recs)}
    assert len(left) < 60


def test_documents_of_many_sorties_share_files(spark, tmp_path):
    """packed documents give the same tables as a folder each, from files that do not grow in number with the sorties."""
    form = '{{"filename":"a\\tb","total_rows":{i},"data_gaps":[{{"t_start":1.0,"t_end":{i}.5,"duration_s":2.0}}],"episodes":[]}}'
    docs = [(f"s{i}", form.format(i=i).replace("\t", "\\t")) for i in range(40)] + [("odd\t\"x", '{"total_rows":7}'), ("bad", '{"total_rows":')]
    df = spark.createDataFrame(docs, "sortie string, document string").coalesce(2)
    sinks.write_analysis(df, str(tmp_path / "packed"), packed=True)
    sinks.write_analysis(df.where("sortie not like 'odd%'"), str(tmp_path / "apart"))
    assert len(list((tmp_path / "packed").glob("*.txt"))) <= 2
    assert {tuple(r) for r in src.read_packed(spark, str(tmp_path / "packed")).collect()} == set(docs)
    got, want = src.read_analysis(spark, str(tmp_path / "packed"), packed=True), src.read_analysis(spark, str(tmp_path / "apart") + "/*/*.txt")
    of = F.regexp_extract("path", "sortie=([^/]*)/", 1).alias("sortie")
    for name in ("documents", "gaps"):
        mine = got[name].where("sortie not like 'odd%'").select("sortie", *got[name].columns[1:])
        assert sorted(mine.collect(), key=str) == sorted(want[name].select(of, *want[name].columns[1:]).collect(), key=str)
    assert [r["sortie"] for r in got["corrupt"].collect()] == ["bad"]
    points = spark.createDataFrame([(f"s{i}", "x", float(i), 1.0, 0) for i in range(30)], "sortie string, signal string, t double, v double, ord long")
    sinks.write_hires(points.coalesce(1), str(tmp_path / "hires"), packed=True)
    assert src.read_packed(spark, str(tmp_path / "hires")).count() == 30


def test_shared_files_fill_plots_of_many_sorties(spark, tmp_path):
    """files that hold many sorties give what a file for each gives; each sortie's first file by name counts."""
    cells = [(f"S{i}", f"{10 * i + k}", f"{k}", f"{-k}") for i in range(30) for k in range(4)]
    rows = spark.createDataFrame(cells, "sortie string, time string, `A.flap` string, `B.flap` string").repartition(3, "sortie")
    rows.write.option("header", True).csv(str(tmp_path / "a"))
    # Only these have a second signal; for the first one a file that comes later does not count.
    rows.where("sortie in ('S3', 'S7')").select("time", F.lit("9").alias("A.flap"), F.lit("5").alias("C.gear"), "sortie").coalesce(1).write.option("header", True).csv(str(tmp_path / "b"))
    modes = spark.createDataFrame([], "sortie string, t double, from_name string, to_name string")
    eps = spark.createDataFrame([("S3", 1, 31.0, None)], "sortie string, episode int, start_t double, end_t double")
    sorties = spark.createDataFrame([(f"S{i}",) for i in range(31)], "sortie string")
    out = str(tmp_path / "out")
    run = lambda **k: patches.backfill_plots(spark, out, str(tmp_path / "*/*.csv"), "sortie", ["flap", "gear", "gone"], modes, eps, sorties, margin=1.0, **k)
    located = run()
    assert located.count() == 32 and located.select("path").distinct().count() <= 4
    got = lambda scope: sorted((r["sortie"], r["signal"], r["t"], r["v"]) for r in patches.stored_points(spark, out).where(F.col("scope") == scope).collect())
    want = sorted([(f"S{i}", "flap", 10.0 * i + k, float(k)) for i in range(30) for k in range(4)] + [(x, "gear", 10.0 * int(x[1:]) + k, 5.0) for x in ("S3", "S7") for k in range(4)])
    assert got("flight") == want
    assert got("episode") == sorted((s, g, 30.0 + k, v) for s, g, k, v in [("S3", "flap", k, float(k)) for k in range(3)] + [("S3", "gear", k, 5.0) for k in range(3)])
    assert run().collect() == [] and run(force=True).count() == 32 and got("flight") == want


def test_csv_samples_are_made_without_a_shuffle(spark, tmp_path):
    """the cells of a row keep its other columns, so none are gathered again; before, each row was a group of its own."""
    (tmp_path / "a.csv").write_text("sortie,rec_time,x,y\n7,1,2,3\nseven,2,,4\n,3,5,nan\n")
    long = src.csv_to_long(src.read_telemetry_csv(spark, str(tmp_path)), ["x", "y"], ("sortie",))
    assert sorted(map(tuple, long.select("sortie", "signal", "t", "v").collect()), key=str) == sorted([("7", "x", 1.0, 2.0), ("7", "y", 1.0, 3.0), ("seven", "y", 2.0, 4.0), (None, "x", 3.0, 5.0)], key=str)
    import __spark_entry__ as entry

    plan = entry.queries()["csv_samples"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_merging_moves_rows_before_it_sorts_them(spark):
    """one sort for a merge, none beside the window's for transitions of known channels; before, a task held its rows two or three times."""
    rows = [("s", "f", x, float(i), float(v), i) for x in ("a", "b") for i, v in enumerate([0, 1, 1, 2, 0])]
    samples = spark.createDataFrame(rows, "sortie string, source string, signal string, t double, v double, ord long")
    known = samples.select("sortie", "source", "signal").distinct().withColumn("class", F.lit("enum"))
    every = ev.transitions(samples, mode="all")
    assert sorted(every.collect()) == sorted(ev.transitions(samples, known).collect()) and every.count() == 6
    again = every.unionByName(every.withColumn("from_v", F.lit(-1.0))).withColumn("rank", F.when(F.col("from_v") < 0, 1).otherwise(0))
    merged = ev.merge_transitions(again, F.col("rank"))
    assert sorted(merged.drop("rank").collect()) == sorted(every.collect())
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Join" not in plan(every) and plan(every).count("Sort [") == 1
    assert plan(ev.merge_transitions(samples.withColumn("rank", F.lit(0)), F.col("rank"))).count("Sort [") == 1


def _class_of(rows):
    """Category, evidence and confidence of an episode's rows by plain loops over (signal, dt, from, to, role, ord)."""
    others = [(sig.split(".")[-1].lower(), dt, a, b, o) for sig, dt, a, b, role, o in rows if role != "trigger" and sig is not None]
    moves = [r for r in others if r[2] in (0, 1) and r[3] in (0, 1) and r[1] is not None]
    pre, at = (lambda dt: dt < -0.010), (lambda dt: dt < -0.010 or abs(dt) <= 0.05)
    order = lambda r: (abs(r[1]), r[4], r[0])
    pick = lambda p, to, when, of=moves: [r[0] for r in sorted((r for r in of if re.search(p, r[0]) and r[3] == to and when(r[1])), key=order)]
    cmd = [r[0] for r in sorted((r for r in moves if re.search("ap.?disc|disconnect|^toga$|apquickdisconnect", r[0]) and pre(r[1]) and (r[0] != "toga" or r[3] == 1)), key=order)]
    resp, cmdmon, mon, trim, sby, cap = (pick(p, to, w) for p, to, w in (("resp.?eng", 0, at), ("cmd.?eng", 0, at), ("mon.?flag|monitorflag", 1, at), ("mistrim|xcd", 1, at), ("enforcestandby", 1, at), ("capable", 0, pre)))
    valid = [r[0] for r in sorted((r for r in moves if re.search("valid|health", r[0]) and r[3] == 0 and at(r[1])), key=lambda r: (r[1], *order(r)))]
    debounces = [r[0] for r in sorted((r for r in others if re.search("debounce.*out$", r[0])), key=order)]
    axis = lambda of, kind: (re.match(rf"([a-z]+?){kind}", of) or [0, ""])[1]
    own = lambda of, kind: next((d for form in (f".*{kind}.*debounce.*out$", ".*debounce.*out$") for d in debounces if axis(of, kind) and re.match(axis(of, kind) + form, d)), None)
    sure = lambda category, seen, by: (category, seen, "confirmed" if by else "unconfirmed")
    first = debounces[0] if debounces else None
    if cmd and not mon and (not re.search("^toga$|apquickdisconnect", cmd[0]) or any("afcsengage" in r[0] and r[2] == 1 for r in moves)):
        return "PILOT_CMD", cmd[0], "n/a"
    if resp:
        meant = next((r for r in resp if axis(r, "resp") and any(re.match(axis(r, "resp") + ".*debounce.*out$", d) for d in debounces)), resp[0])
        return sure("RESP_MONITOR", own(meant, "resp") or meant, own(meant, "resp"))
    if cmdmon:
        return sure("CMD_MONITOR", own(cmdmon[0], "cmd") or cmdmon[0], own(cmdmon[0], "cmd"))
    for category, seen, by in (("MONITOR_FAULT", mon, first), ("MISTRIM", trim, first), ("VALIDITY_LOSS", valid, True), ("ENFORCE_SBY", sby, first), ("CAP_LOST", cap, first)):
        if seen:
            return sure(category, seen[0], by)
    return "UNKNOWN", None, "n/a"


FORM = "sortie string, episode int, signal string, dt double, from_v double, to_v double, role string, ord long"


def _episodes_of_rules(rng, n):
    names = "x.toga apDisc F.apQuickDisconnect rollRespEng pitchRespEng x.pitchCmdEng monFlag latMistrim irsValid a.b.adsHealthy enforceStandby apCapable afcsEngaged rollRespDebounceOut pitchDebounceOut pitchCmdDebounceOut other a.".split()
    rows = []
    for e in range(n):
        for o in range(rng.choice([0, 1, 2, 4, 7])):
            rows.append(("s", e, rng.choice([*names, None]), rng.choice([-2.0, -0.5, -0.03, -0.01, 0.0, 0.05, 0.06, 1.0]), float(rng.choice([0, 1, 1, 2])), float(rng.choice([0, 0, 1, 3])), rng.choice(["pre", "pre", "during"]), rng.choice([o, o, 3])))
        rows += [("s", e, "x.afcsCapable", 0.0, 1.0, 0.0, "trigger", 99)] * (e % 5 != 4) * (1 + (e % 7 == 0))
    return rows


def test_classes_against_loops_and_without_what_nobody_reads(spark):
    """classes, evidence and confidence by plain loops; a class alone is found without gathering names, and rows of no rule are not summed."""
    rows = _episodes_of_rules(random.Random(13), 700)
    of = collections.defaultdict(list)
    for _, e, *r in rows:
        of[e].append(tuple(r))
    want = {e: _class_of(r) for e, r in of.items() if any(x[4] == "trigger" for x in r)}
    found = spark.createDataFrame(rows, FORM)
    classes = classify.classify(found)
    got = [(r["episode"], (r["category"], r["evidence"], r["confidence"])) for r in classes.collect()]
    assert len(got) == len(want) and dict(got) == want and len({c for c, *_ in want.values()}) == 9
    kept = {e: c for e, (c, *_) in want.items() if c != "PILOT_CMD" or not any(r[0] and r[0].split(".")[-1] in ("other", "toga") for r in of[e])}
    hidden = classify.hide_commanded(classes, found, ["toga", "other"])
    assert {r["episode"]: r["category"] for r in hidden.collect()} == kept and len(kept) < len(want)
    plan = hidden.select("sortie", "episode", "category")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "regexp_extract" not in plan
    assert classify.LOOKED_AT in plan


def test_lines_are_dealt_to_episodes_once(spark, tmp_path):
    """F8: dossiers against plain loops over lines; after lines are dealt to their episodes, none is moved by episode again."""
    from wakelog.plans import detail

    rng = random.Random(8)
    lines = [(rng.randrange(60), rng.randrange(400), rng.randrange(120), rng.randrange(1, 8)) for _ in range(900)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    parts = [(i, f"part {i}", "Brand", "Type", i % 7) for i in range(40)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    of = collections.defaultdict(list)
    for order, part, supplier, number in lines:
        name, a, b = detail.LINES[min((part + number * 5) % 20, 11)]
        of[supplier % 50, order].append((name, -((part * 7 + number) % 97) / 40.0, a, b, "pre", number))
    want = {k: (len(rows) + 1, min(r[1] for r in rows)) for k, rows in of.items() if _class_of(rows)[0] == "UNKNOWN"}
    out = detail.dossiers(spark, str(tmp_path))
    got = [((r["sortie"], r["episode"]), (r["n"], r["first_dt"])) for r in out.collect()]
    assert len(got) == len(want) and dict(got) == want and 0 < len(want) < len(of)
    plan = detail.dossiers(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(sortie#\d+L, episode#\d+L, \d+\), ENSURE_REQUIREMENTS", plan)
