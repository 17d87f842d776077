"""Connected components of an edge table."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from augury.session import cut_lineage

TASK_EDGES = 100_000


def _stars(edges: DataFrame, larger: bool, tasks: int) -> DataFrame:
    """One star step over edges (a > b). Large: every vertex ties its larger neighbours to its smallest. Small: every
    vertex ties its smaller neighbours, and itself, to the smallest of them. At most ``tasks`` tasks write for a shuffle."""
    if larger:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).coalesce(tasks).distinct().coalesce(tasks)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (smallest node reachable) for every node of ``edges`` (``a``, ``b``).

    Alternating large and small stars: work per round is in proportion to the edges, minima combine in the map tasks,
    and hubs only meet in joins that Spark may split. Tasks are in proportion to the edges too, as every task of a round
    leaves files, however few its edges. It stops when a round changes nothing, after O(log n) rounds in
    practice, and raises if it has not by ``most_rounds``: it never returns an unfinished answer.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut_lineage(e)
    state = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = state(e)
    for _ in range(most_rounds):
        tasks = max(1, math.ceil(seen[0] / TASK_EDGES))
        e = cut_lineage(_stars(_stars(e.coalesce(tasks), True, tasks), False, tasks))
        now = state(e)
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = now
    raise RuntimeError(f"components still change after {most_rounds} rounds")
