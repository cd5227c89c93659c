"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al. 2014).

Each step is one aggregation and one join; minima are written before the join, so that both join
sides are plain shuffles that adaptive execution can split when one node has very many edges. The
steps shrink the depth of all trees together, so a chain of n nodes takes about log(n) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component): each node of ``edges`` (a, b) with the smallest node that it reaches.

    Loops and edges with a null end are ignored; an empty table gives an empty table. If the edges still change after ``rounds`` steps, that is
    an error: chains of 2 ** 59 nodes would be needed.
    """
    e = scratch.save("cc", edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first())

    now = state(e)
    done = not now[0]
    for k in range(rounds):
        if done:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(f"cc-low{k}", both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w")))
        large = scratch.save(f"cc-large{k}", both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).filter("u <> v").distinct())
        low2 = scratch.save(f"cc-least{k}", large.groupBy("u").agg(F.min("v").alias("w")))
        down = large.join(low2, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).filter("u <> v")
        e = scratch.save(f"cc{k}", down.unionByName(low2.select("u", F.col("w").alias("v"))).distinct())
        then, now = now, state(e)
        done = then == now
        del both, low, large, low2, down
        scratch.drop(f"cc-low{k}", f"cc-large{k}", f"cc-least{k}", "cc" if not k else f"cc{k - 1}")
    if not done:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    low = e.groupBy("u").agg(F.min("v").alias("component"))
    return low.select(F.col("u").alias("node"), "component").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
