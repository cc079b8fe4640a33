"""Connected components of an edge table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round: neighbours of each node are linked to the smallest of them and itself instead. The large
    star moves larger neighbours, the small star smaller ones and the node. A minimum per node
    (aggregated before it is shuffled) and a join replace neighbour lists, so that no hub's
    neighbours meet in one row; the join may split a hub's rows."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:  # from the larger to the smaller
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(F.col("u"), F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    if large:
        moved = moved.where("v > u").select("v", F.col("m").alias("w"))
    else:
        moved = moved.select("v", F.col("m").alias("w")).unionAll(least.select(F.col("u").alias("v"), F.col("m").alias("w")))
    return moved.where("v <> w").select(F.greatest("v", "w").alias("u"), F.least("v", "w").alias("v")).distinct()


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component): every node of edges (u, v: long, not null) with the smallest node that it reaches.

    Self-loops are ignored and repeated edges count once. Each round is written to the shared folder,
    so a lost executor costs one round at most. The rounds end when the edges stay as they were
    (their number and two sums of hashes), after about log2 of the longest chain; where that takes
    more than the stated rounds, an error is raised rather than a wrong result given."""

    def mark(df: DataFrame) -> tuple:
        h = F.xxhash64("u", "v")
        return tuple(df.agg(F.count("*"), F.sum(F.shiftright(h, 16)), F.bit_xor(h)).first())

    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = mark(now)
    for _ in range(rounds):
        if not before[0]:
            break
        now = written(_stars(_stars(now, True), False), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
