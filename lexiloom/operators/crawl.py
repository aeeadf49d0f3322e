"""Breadth-first traversal of a link table with depth and page limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.runtime import cut


def crawl(seeds: DataFrame, edges: DataFrame, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """(url, depth) of pages reached from seeds (url) over edges (src, dst).

    A level is one join with the edges and one anti join with what was visited; both are equi-joins.
    Links to numbered list pages cost no depth: they are followed to a fixed point inside a level.
    Beyond ``max_pages`` the first pages by depth and URL count. Each level is checkpointed once and what
    was visited is their union, so nothing is written twice and lost executors cost no restart.
    """
    free = F.col("dst").rlike(r"/page/\d+(?:/|$)")
    levels = [cut(seeds.select("url", F.lit(0).alias("depth")).distinct())]
    frontier, depth = levels[0], 0
    visited = lambda: reduce(DataFrame.unionByName, levels)
    while True:
        step = frontier.join(edges, frontier.url == edges.src).select(F.col("dst").alias("url"), free.alias("free"))
        step = cut(step.join(visited().select("url"), "url", "left_anti").groupBy("url").agg(F.max("free").alias("free")))
        same = step.where("free").select("url", F.lit(depth).alias("depth"))
        if not same.isEmpty():
            levels.append(same)
            frontier = frontier.unionByName(same)
            continue
        if depth >= max_depth or (max_pages is not None and visited().count() >= max_pages):
            break
        depth += 1
        deeper = step.where("not free").select("url", F.lit(depth).alias("depth"))
        if deeper.isEmpty():
            break
        levels.append(deeper)
        frontier = deeper
    return visited() if max_pages is None else visited().orderBy("depth", "url").limit(max_pages)
