"""Connected components by alternating large and small stars, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.tables import shared


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hook neighbours to the smallest neighbour: the larger ones (large star) or the others (small)."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        joined = joined.where("v > u")
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    hooked = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return hooked.unionAll(own).where("u <> v").distinct()


def _digest(edges: DataFrame) -> tuple:
    one = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(one)).first())


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node that has an edge.

    The minimum of a node's neighbours is folded in each task before the shuffle and joined back, so
    a hub is no single task; rounds grow with the logarithm of the longest path. Each
    round is a table in the shared folder, so a lost executor costs no earlier round.
    Loops and repeated edges are allowed; rows with a null end are left out.
    """
    pairs = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null")
    pairs = shared(pairs.distinct(), "edges")  # the edges are worked out once
    loops = pairs.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    now = pairs.where("u <> v")
    before = _digest(now)
    while before[0]:
        now = shared(_star(_star(now, large=True), large=False), "edges")
        after = _digest(now)
        if after == before:
            break
        before = after
    own = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    found = own.unionAll(roots).unionAll(loops)
    return found.groupBy("node").agg(F.min("component").alias("component"))
