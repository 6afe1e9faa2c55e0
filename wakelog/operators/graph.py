"""The model dependency graph: start nodes, dead-end bridges, upstream and downstream walks, and comparisons."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import stored

START_TYPES = ("Logic", "SubSystem", "SignalConversion")


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dstKey").alias("key")).agg(F.count("*").alias("in_degree"))


def start_nodes(nodes: DataFrame, edges: DataFrame, signal: str) -> DataFrame:
    """(key): where the walk for a signal starts (GR-2)."""
    n = nodes.join(in_degree(edges), "key")
    model = signal[:1].upper() + signal[1:]
    fit = n.where((F.col("model") == model) & F.contains("key", F.lit("Outport:1")) & F.col("blockType").isin(*START_TYPES))
    parent = F.lower(F.element_at(F.split("key", "/"), -2))
    best = fit.orderBy(F.contains(parent, F.lit(signal.lower())).desc(), F.desc("in_degree"), "key").limit(1).select("key")
    named = n.where((F.col("blockName") == signal) | (F.col("testPointName") == signal)).select("key").distinct()
    return best.unionByName(named.join(best.select(F.lit(1).alias("_x")).limit(1), how="left_anti", on=F.lit(True)))


def _bridges(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bridges to Inport nodes without an in-edge, by the first rule that gives one (GR-3), without their pairs written out.

    (srcKey, dstKey) of the rules that give one bridge; (dstKey, blockName) of the nodes whose bridges come from every fed
    node of their name; (blockName, srcKey) of the fed nodes. The first two rules look at a dead end's name, or at name and
    model, so each is decided once for all dead ends that share these.
    """
    degrees = in_degree(edges)
    name = F.col("blockName")
    dead = nodes.where((F.col("blockType") == "Inport") & name.isNotNull()).join(degrees, "key", "left_anti").select(F.col("key").alias("dstKey"), "blockName", F.col("model").alias("_model"), F.lower(name).alias("_low"))
    fed = nodes.join(degrees, "key").select(F.col("key").alias("srcKey"), F.col("model").alias("src_model"), F.col("blockName").alias("src_block"), "blockType", "in_degree")
    out1 = fed.where(F.contains("srcKey", F.lit("Outport:1")))
    parent = F.lower(F.element_at(F.split("srcKey", "/"), -2))
    first = lambda named: F.min(F.struct((~named).alias("other"), (-F.col("in_degree")).alias("d"), "srcKey"))
    gates = out1.where(F.col("blockType").isin(*START_TYPES))
    by_model = dead.select("blockName").distinct().join(gates, F.col("src_model") == F.concat(F.upper(F.substring(name, 1, 1)), F.expr("substring(blockName, 2)")))
    by_model = by_model.groupBy("blockName").agg(first(F.coalesce(F.contains(parent, F.lower(name)), F.lit(False))).alias("_one"))
    # A key holds name + "logic" if the name ends where one of the key's "logic" begins: what ends there is listed, up to
    # the longest name, and joined by equality.
    asked = dead.select("_model", "_low").distinct()
    pieces = F.split(F.lower("srcKey"), "logic")
    heads = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.array_join(F.slice(pieces, F.lit(1), i), "logic"))
    before = out1.where(F.size(pieces) > 1).select(F.col("src_model").alias("_model"), "srcKey", "in_degree", F.explode(heads).alias("head")).crossJoin(F.broadcast(asked.agg(F.max(F.length("_low")).alias("most"))))
    ends = F.transform(F.sequence(F.greatest(F.lit(1), F.length("head") + 1 - F.col("most")), F.length("head") + 1), lambda i: F.substr("head", i))
    by_logic = before.select("_model", "srcKey", "in_degree", F.explode(ends).alias("_low")).join(asked, ["_model", "_low"]).groupBy("_model", "_low").agg(first(F.lit(False)).alias("_two"))
    rule = F.when(F.col("_one").isNotNull(), 0).when(F.col("_two").isNotNull(), 1).otherwise(2)
    ruled = dead.join(by_model, "blockName", "left").join(by_logic, ["_model", "_low"], "left").select("dstKey", "blockName", F.struct(rule.alias("rule"), F.coalesce("_one", "_two").alias("x")).alias("b"))
    ruled = stored(ruled.withColumn("b", F.min("b").over(W.partitionBy("dstKey"))), "dead-ends")
    return ruled.where("b.rule < 2").select("b.x.srcKey", "dstKey").distinct(), ruled.where("b.rule = 2").select("dstKey", "blockName"), fed.where("src_block is not null").select(F.col("src_block").alias("blockName"), "srcKey")


#: Pairs of a name come in tiles of about so many keys a side, and in these by runs of about so many fed nodes.
TILE, RUN = 2048, 64
#: Pairs that one task gives, about, where they are too many for spark.sql.shuffle.partitions tasks.
TASK_PAIRS = 1 << 22


def _paired(many: DataFrame, fed: DataFrame) -> DataFrame:
    """(srcKey, dstKey): every fed node with every dead end of its name.

    Tiles of a name are dealt to tasks, so neither a frequent name nor the number of names decides how many work. Each side
    is moved once for every tile that it meets: its size times the other side's over TILE. In a tile one run of fed nodes
    after the other meets all dead ends, so a task's keys are few and come again soon: as Parquet the pairs are indexes
    into small dictionaries that compress well, where whole names would write every key out.
    """
    fed = stored(fed, "fed")
    counts = lambda side, n: side.groupBy("blockName").agg(F.count("*").alias(n))
    sizes = stored(counts(many, "n_ends").join(counts(fed, "n_fed"), "blockName"), "names")
    pairs = sizes.agg(F.sum(F.col("n_ends") * F.col("n_fed"))).head()[0] or 0
    parts = max(int(fed.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / TASK_PAIRS))
    dealt = lambda key, n, size: F.pmod(F.xxhash64(key), F.ceil(F.col(n) / size))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / TILE) - 1))
    ends = many.join(sizes, "blockName").select("blockName", dealt("dstKey", "n_ends", TILE).alias("a"), each("n_fed").alias("b"), "dstKey")
    runs = fed.join(sizes, "blockName").groupBy("blockName", "n_ends", dealt("srcKey", "n_fed", RUN).alias("run")).agg(F.collect_list("srcKey").alias("srcKeys"))
    runs = runs.select("blockName", each("n_ends").alias("a"), F.floor(F.col("run") / (TILE // RUN)).alias("b"), "srcKeys")
    tile = ["blockName", "a", "b"]
    return runs.repartition(parts, *tile).join(ends.repartition(parts, *tile), tile).select(F.explode("srcKeys").alias("srcKey"), "dstKey")


def virtual_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(srcKey, dstKey): bridges to Inport nodes without an in-edge, by the first rule that gives one (GR-3).

    By the third rule every dead end of a name has a bridge from every fed node of that name, so there may be far more rows
    than nodes; walks do without them (see bridged_upstream).
    """
    one, many, fed = _bridges(nodes, edges)
    return one.unionByName(_paired(many, fed))


#: Hops that one job takes at most where it follows whole paths, and where it removes repeats after each hop.
PATH_HOPS, HOPS_A_JOB = 15, 4
#: Paths that a job may follow.
MOST_PATHS = 4_000_000


def _along_paths(frontier: DataFrame, step: DataFrame, hops: int) -> DataFrame:
    """(key, hop): what the frontier reaches within so many hops, every path followed to its end without a shuffle for each hop."""
    rows = frontier.select("hop", F.col("key").alias("k0"))
    for i in range(1, hops + 1):
        rows = rows.join(step.select(F.col("key").alias(f"k{i - 1}"), F.col("to").alias(f"k{i}")), f"k{i - 1}", "left")
    met = F.array(*[F.struct(F.col(f"k{i}").alias("key"), (F.col("hop") + i).alias("hop")) for i in range(1, hops + 1)])
    return rows.select(F.inline(met)).where("key is not null")


def _in_rings(frontier: DataFrame, step: DataFrame, hops: int, seen: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """As _along_paths, but what a hop reaches is told apart, and from what is known, before the next one."""
    rings, here = [], frontier
    for _ in range(hops):
        if leaves is not None:
            here = here.join(leaves, "key", "left").groupBy(F.coalesce("by", "key").alias("key")).agg(F.min("hop").alias("hop"))
        here = here.join(step, "key").groupBy(F.col("to").alias("key")).agg(F.min(F.col("hop") + 1).alias("hop")).join(seen.select("key"), "key", "left_anti")
        rings.append(here)
    return reduce(DataFrame.unionByName, rings)


def walk(start: DataFrame, edges: DataFrame, max_hops: int = 15, forward: bool = False, nodes: DataFrame | None = None, leaves: DataFrame | None = None) -> DataFrame:
    """(key, hop): every node within max_hops against (or along) the edges, with its least hop (GR-4, GR-5).

    nodes: those that the graph describes; others are reached but not passed through. Edges are written once, sorted by the
    node they leave, and all hops read them. A job takes several hops, then what is new is written down; the walk ends when
    nothing is. While the size of the frontier and the largest number of edges at a node prove that the paths are few, a job
    follows them all; beyond that, repeats and known nodes go out after each hop. Both give the same rows.

    leaves: (key, by), nodes that are left by the edges of another node only, so that edges which many nodes share are
    there once; with them repeats always go out after each hop.
    """
    here, there = ("srcKey", "dstKey") if forward else ("dstKey", "srcKey")
    step = edges.select(F.col(here).alias("key"), F.col(there).alias("to")).distinct()
    step = stored((step if nodes is None else step.join(nodes.select("key"), "key", "left_semi")).sortWithinPartitions("key"), "steps")
    seen = frontier = start.select("key", F.lit(0).alias("hop")).distinct()
    sizes = {bool(r[0]): r["n"] for r in step.groupBy("key").agg(F.count("*").alias("n")).agg(F.lit(False).alias("start"), F.max("n").alias("n")).unionByName(frontier.agg(F.lit(True).alias("start"), F.count("*").alias("n"))).collect()}
    hop, count, widest = 0, sizes[True], max(2, sizes[False] or 0)
    while hop < max_hops and count:
        fits = int(math.log(MOST_PATHS / count, widest)) if count < MOST_PATHS and leaves is None else 0
        hops = min(max_hops - hop, min(fits, PATH_HOPS) if fits > 1 else HOPS_A_JOB)
        reached = _along_paths(frontier, step, hops) if fits > 1 else _in_rings(frontier, step, hops, seen, leaves)
        last, told = hop + hops, Observation()
        new = reached.groupBy("key").agg(F.min("hop").alias("hop")).join(seen.select("key"), "key", "left_anti")
        new = stored(new.observe(told, F.count(F.when(F.col("hop") == last, 1)).alias("n")), f"hop-{last}")
        frontier, seen, hop, count = new.where(F.col("hop") == last), seen.unionByName(new), last, told.get["n"]
    return seen


def upstream(nodes: DataFrame, edges: DataFrame, start: DataFrame, max_hops: int = 15, forward: bool = False, leaves: DataFrame | None = None) -> DataFrame:
    """(signal, model, hop, blockType): test points reached beyond the start, each name at its least hop."""
    reached = walk(start, edges, max_hops, forward, nodes, leaves).where("hop > 0").join(nodes, "key")
    points = reached.where(F.col("isTestPoint") & ~F.col("blockName").startswith("signalConversion"))
    best = points.groupBy("blockName").agg(F.min(F.struct("hop", "key", "model", "blockType")).alias("b"))
    return best.select(F.col("blockName").alias("signal"), "b.model", "b.hop", "b.blockType")


def bridged_upstream(nodes: DataFrame, edges: DataFrame, signal: str, max_hops: int = 15) -> DataFrame:
    """Test points upstream of a signal: from its start nodes, over edges and the bridges at dead ends (GR-2, 3 and 4).

    Dead ends that every fed node of their name bridges to share these bridges: the first of them by key has the edges, and
    the others are left by it. So the walk reads as many edges as there are nodes and edges, not the pairs.
    """
    one, many, fed = _bridges(nodes, edges)
    by = many.groupBy("blockName").agg(F.min("dstKey").alias("by"))
    shared = fed.join(by, "blockName").select("srcKey", F.col("by").alias("dstKey"))
    leaves = stored(many.join(by, "blockName").select(F.col("dstKey").alias("key"), "by").distinct(), "leaves")
    return upstream(nodes, edges.select("srcKey", "dstKey").unionByName(one).unionByName(shared), start_nodes(nodes, edges, signal), max_hops, leaves=leaves)


def hop_distribution(found: DataFrame) -> DataFrame:
    """(hop, n, cumulative) for every hop from 1 to the largest (AGG-11)."""
    hops = found.agg(F.max("hop").alias("m")).where("m >= 1").select(F.explode(F.sequence(F.lit(1), F.col("m"))).alias("hop"))
    counts = hops.join(found.groupBy("hop").agg(F.count("*").alias("n")), "hop", "left").select("hop", F.coalesce("n", F.lit(0)).alias("n"))
    return counts.withColumn("cumulative", F.sum("n").over(W.orderBy("hop").rowsBetween(W.unboundedPreceding, 0)))


def with_correlations(found: DataFrame, correlations: DataFrame) -> DataFrame:
    """Upstream rows with their fleet correlation where there is one (JN-8)."""
    return found.join(correlations.select("signal", "score", "frequency", "mean_dt_s"), "signal", "left")


def cause_filter(found: DataFrame, correlations: DataFrame) -> DataFrame:
    """Signals that are both upstream and correlated (GR-6)."""
    return correlations.join(found.select("signal", "hop"), "signal")


def chain_filter(transitions: DataFrame, found: DataFrame) -> DataFrame:
    """Transitions whose suffix is upstream, with the hop (JN-9); needs the column suffix."""
    return transitions.join(found.select(F.col("signal").alias("suffix"), "hop"), "suffix")


def upstream_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(signal, status): added or removed between two sets (JN-10)."""
    a, b = old.select("signal").distinct(), new.select("signal").distinct()
    return b.join(a, "signal", "left_anti").withColumn("status", F.lit("added")).unionByName(a.join(b, "signal", "left_anti").withColumn("status", F.lit("removed")))


def coverage_gap(found: DataFrame, observed: DataFrame) -> DataFrame:
    """Test points of a walk that no flight has observed (JN-11)."""
    return found.join(observed.select("signal").distinct(), "signal", "left_anti")
