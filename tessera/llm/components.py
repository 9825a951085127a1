"""Connected components by alternating large-star and small-star steps; of few edges at once on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch
from tessera.llm.skew import join_one
from tessera.plans.graph import LOCAL_EDGES, smallest_of


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b) that isn't the smallest of its component.

    Up to ``LOCAL_EDGES`` different edges are joined on the driver. Else each round is two grouped minima and two joins to them, in which the rows of hubs are dealt out; every round is
    written, so that lineage stays short. It ends when a round changes nothing.
    """
    e = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = _sum(e)
    if 0 < before[0] <= LOCAL_EDGES:
        found = e.toArrow()
        node, least = smallest_of(found["u"].to_numpy(), found["v"].to_numpy())
        scratch.drop(e)
        rest = node != least
        table = pa.table({"node": node[rest], "component": least[rest]})
        return scratch.save(e.sparkSession.createDataFrame(table).coalesce(1), "components")
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("c"))
        large = join_one(both.filter("y > x"), least, ["x"], ["m"], "c", F.col("y")).select(F.col("y").alias("u"), F.least("m", "x").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = join_one(large, down, ["u"], ["m"], "c", F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        nxt = scratch.save(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        scratch.drop(e)
        e, now = nxt, _sum(nxt)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _sum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())
