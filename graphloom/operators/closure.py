"""Cycle-safe reachability over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.storage import materialize


def closure(edges: DataFrame, seeds: DataFrame | None = None, max_rounds: int = 1000) -> DataFrame:
    """All pairs (repo_name, src, dst) joined by a path of one edge or more of ``edges`` (repo_name, src, dst); only from ``seeds`` (repo_name, src) if given.

    From seeds each round extends the pairs found in the last one by a step. Without seeds paths
    double: the last round's pairs are joined to all that are known, so there are as many
    rounds as the longest path has binary digits. Known pairs are dropped, and each round is
    written to the shared folder, so neither plans nor lost executors grow the work. A node on
    a cycle reaches itself.
    """
    steps = materialize(edges.select("repo_name", "src", "dst").distinct(), "steps")
    fresh = steps if seeds is None else materialize(steps.join(seeds.select("repo_name", "src").distinct(), ["repo_name", "src"], "left_semi"), "reach")
    found = fresh
    for _ in range(max_rounds):
        further = (found if seeds is None else steps).select("repo_name", F.col("src").alias("mid"), F.col("dst").alias("far"))
        more = fresh.withColumnRenamed("dst", "mid").join(further, ["repo_name", "mid"]).select("repo_name", "src", F.col("far").alias("dst")).distinct()
        fresh = materialize(more.join(found, ["repo_name", "src", "dst"], "left_anti"), "reach")
        if fresh.isEmpty():
            return found
        found = found.unionAll(fresh)
    raise RuntimeError("closure did not end")
