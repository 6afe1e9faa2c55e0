"""Greedy choice along time by pointers: who comes next, islands, and doubling of the pointers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import stored


#: Islands up to this many rows are followed jump by jump.
SHORT = 12


def greedy_chain(rows: DataFrame, keys: list[str], order: list[str], apart: float, strict: bool = True) -> DataFrame:
    """The rows kept when each key's are gone through by (t, order): the first, then always the next one far enough on.

    rows: t, reach (not before t; null: nothing comes after this row) and more. Far enough is ``t - reach > apart``, with
    strict False ``>=`` (apart above 0), reach being the last kept row's.

    Rows that no earlier one reaches are kept for certain, so they cut a key's rows into islands, found with one running
    maximum. Where islands have several rows, each row points to the one that would come next. Short islands are followed
    jump by jump in one plan; else pointers are doubled: a round writes down the rows that 2**n jumps reach, so there are as
    many rounds as the largest island's length has bits.
    Nothing is gathered by key. Keys are not null. An empty table gives an empty one.
    """
    far = lambda t, reach: (t - reach > apart) if strict else (t - reach >= apart)
    own, of = ["_k", "_root", "_island", "_size"], [*keys, "_island"]
    by = W.partitionBy(*keys).orderBy("t", *order)
    reached = F.max(F.coalesce("reach", F.lit(float("inf")))).over(by.rowsBetween(W.unboundedPreceding, -1))
    numbered = rows.withColumns({"_k": F.row_number().over(by), "_before": reached})
    numbered = numbered.withColumn("_root", F.col("_before").isNull() | far(F.col("t"), F.col("_before"))).drop("_before")
    numbered = numbered.withColumn("_island", F.sum(F.col("_root").cast("long")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    told = Observation()
    numbered = stored(numbered.withColumn("_size", F.count("*").over(W.partitionBy(*of))).observe(told, F.max("_size").alias("n")), "chain")
    longest = told.get["n"] or 0
    roots = numbered.where("_root").drop(*own)
    if longest <= 1:
        return roots
    many = numbered.where("_size > 1")
    jumps, marked = _next(many, of, apart, far), many.where("_root").select(*keys, "_k")
    if longest <= SHORT:
        path = marked.withColumn("_k0", F.col("_k")).drop("_k")
        for i in range(1, longest):
            path = path.join(jumps.select(*keys, F.col("_k").alias(f"_k{i - 1}"), F.col("_to").alias(f"_k{i}")), [*keys, f"_k{i - 1}"], "left")
        marked = path.select(*keys, F.explode(F.array(*[f"_k{i}" for i in range(1, longest)])).alias("_k")).where("_k is not null")
    else:
        marked = _doubled(marked, stored(jumps, "chain-next"), keys, longest)
    return roots.unionByName(many.where("not _root").join(marked, [*keys, "_k"], "left_semi").drop(*own))


def _doubled(marked: DataFrame, jumps: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """(keys, _k): the rows that some number of jumps, below longest, leads to from the marked ones."""
    steps = 1
    while steps < longest:
        marked = stored(marked.unionByName(marked.join(jumps, [*keys, "_k"]).select(*keys, F.col("_to").alias("_k"))), "chain-marked")
        steps *= 2
        if steps < longest:
            onward, told = jumps.select(*keys, F.col("_k").alias("_to"), F.col("_to").alias("_end")), Observation()
            further = jumps.join(onward, [*keys, "_to"]).select(*keys, "_k", F.col("_end").alias("_to"))
            jumps = stored(further.observe(told, F.count("*").alias("n")), "chain-next")
            if not told.get["n"]:
                break
    return marked


def _next(many: DataFrame, of: list[str], apart: float, far) -> DataFrame:
    """(keys, _k, _to): of each row the first row of its island that is far enough on, if there is one.

    A place is looked up at reach + apart; as ``t - reach`` may round otherwise, the times beside it are tried, too.
    """
    ahead = W.partitionBy(*of).orderBy("t")
    times = many.groupBy(*of, "t").agg(F.min("_k").alias("_to"))
    spot: Column = F.struct("t", "_to")
    near = F.struct(spot.alias("a"), F.lead(spot, 1).over(ahead).alias("b"), F.lead(spot, 2).over(ahead).alias("c"))
    spots = times.select(*of, F.col("t").alias("_at"), F.lit(0).alias("_side"), near.alias("_near"))
    probes = many.where("reach is not null").select(*of, (F.col("reach") + apart).alias("_at"), F.lit(1).alias("_side"), "_k", "reach")
    placed = spots.unionByName(probes, allowMissingColumns=True).withColumn("_near", F.last("_near", ignorenulls=True).over(W.partitionBy(*of).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)))
    pick = F.coalesce(*[F.when(far(F.col(f"_near.{x}.t"), F.col("reach")), F.col(f"_near.{x}._to")) for x in "abc"])
    return placed.where("_side = 1").select(*[c for c in of if c != "_island"], "_k", pick.alias("_to")).where("_to is not null")
