"""Iterative graph operators as DataFrame rounds.

Each round is written to the shared folder, so a lost executor replays one round at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.fingerprint import hamming_bits
from ..session import discard, stored

MAX_ROUNDS = 200
#: tables of claimed nodes before they are written as one
CLAIM_TABLES = 16


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Written edges with their number and a sum of hashes, both taken in the writing pass."""
    seen = Observation()
    whole = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    table = stored(edges.observe(seen, F.count("*").alias("n"), whole.alias("h")), "components")
    return table, (seen.get["n"], seen.get["h"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every endpoint; component is the smallest node id in it.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). Only minima are
    aggregated per node, never neighbour lists, so a hub costs no more than its edges.
    """
    start = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    work, state = _counted(start)
    before = None
    for _ in range(MAX_ROUNDS):
        if before == state:
            break
        before = state
        both = work.unionByName(work.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (
            both.join(low, "u")
            .filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
        )
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        last = work
        work, state = _counted(small.select("e.u", "e.v").filter("u <> v").distinct())
        discard(last)
    else:
        raise RuntimeError("components did not converge")
    stars = work.groupBy("u").agg(F.min("v").alias("component"))
    roots = work.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.withColumnRenamed("u", "node").unionByName(roots)


def medoid(members: DataFrame, cluster: list[str]) -> DataFrame:
    """Member with the least total Hamming distance to its cluster, lowest ``node`` on ties.

    Input: ``cluster`` columns, ``node``, ``bits``, ``n`` copies. The total distance of a
    candidate follows from how many members set each bit, so no pairs are formed.
    """
    one = F.lit(1).cast("long")
    ones = [
        F.sum(F.shiftright("bits", i).bitwiseAND(one) * F.col("n")).alias(f"o{i}")
        for i in range(64)
    ]
    totals = members.groupBy(*cluster).agg(F.sum("n").alias("total"), *ones)
    totals = totals.select(*cluster, "total", F.array(*[F.col(f"o{i}") for i in range(64)]).alias("ones"))
    score = F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("long"),
        lambda s, i: s
        + F.when(
            F.call_function("shiftright", F.col("bits"), i).bitwiseAND(one) == 1,
            F.col("total") - F.get(F.col("ones"), i),
        ).otherwise(F.get(F.col("ones"), i)),
    )
    scored = members.join(totals, cluster).withColumn("score", score)
    best = F.min(F.struct("score", "node", "bits"))
    return scored.groupBy(*cluster).agg(best.alias("best"), F.sum("n").alias("size")).select(
        *cluster,
        F.col("best.node").alias("medoid"),
        F.col("best.bits").alias("medoid_bits"),
        F.col("best.score").alias("medoid_score"),
        "size",
    )


def distance_to(member_bits: Column, centre_bits: Column) -> Column:
    return hamming_bits(member_bits, centre_bits).cast("int")


def greedy_star(edges: DataFrame, block: list[str]) -> DataFrame:
    """Greedy star clustering: (``block``, anchor, variant) for every claimed node.

    ``edges``: ``block``, hi, lo, hi_rank (a sortable struct, smaller first). hi outranks lo.
    Anchors are the lexicographically first maximal independent set: in each round the neighbours of
    nodes without an undecided better neighbour are claimed and leave with their edges. A node that
    was never claimed is an anchor, also when it lost its last edge in the round that freed it.
    Afterwards every variant goes to its best-ranked adjacent anchor over the full edge list.
    """
    edges = stored(edges.select(*block, "hi", "lo", "hi_rank"), "star-edges")
    claimed: list[DataFrame] = []
    work = edges.select(*block, "hi", "lo")
    for turn in range(MAX_ROUNDS * 50):
        if work.isEmpty():
            break
        better = work.select(*block, F.col("lo").alias("hi")).distinct()
        free = work.join(better, [*block, "hi"], "left_anti")
        gone = stored(free.select(*block, "lo").distinct(), "star-claimed")
        last, work = work, stored(
            work.join(gone, [*block, "lo"], "left_anti").join(
                gone.withColumnRenamed("lo", "hi"), [*block, "hi"], "left_anti"
            ),
            "star-work",
        )
        if turn:
            discard(last)
        claimed.append(gone)
        if len(claimed) == CLAIM_TABLES:
            # one table in place of many, so the plan does not grow with the rounds
            claimed = [stored(reduce(DataFrame.unionByName, claimed), "star-claimed")]
    else:
        raise RuntimeError("stars were not settled in the allowed rounds")
    taken = reduce(DataFrame.unionByName, claimed) if claimed else edges.select(*block, "lo").limit(0)
    return (
        edges.join(taken.withColumnRenamed("lo", "hi"), [*block, "hi"], "left_anti")
        .groupBy(*block, "lo")
        .agg(F.min_by("hi", "hi_rank").alias("anchor"))
        .select(*block, "anchor", F.col("lo").alias("variant"))
    )
