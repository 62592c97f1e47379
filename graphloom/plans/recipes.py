"""Compositions of the named queries that reviews of a repository start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph

from . import named


def hub_functions(g: Graph, repo_name: str | None = None, limit: int = 10) -> DataFrame:
    """The functions of each repository that most different functions call."""
    fan = named._where(g["calls"], repo_name=repo_name).where("caller <> callee").groupBy("repo_name", "callee").agg(F.count_distinct("caller").alias("callers"))
    return named._top(fan, ["repo_name"], [F.desc("callers"), F.asc("callee")], limit)


def file_owners(g: Graph, repo_name: str | None = None) -> DataFrame:
    """For each file the author with most of its commits, and that author's share; ties go to the lower e-mail."""
    work = named._where(g["modifies"].select("hash", "repo_name", "path"), repo_name=repo_name).join(g["authored_by"], "hash").groupBy("repo_name", "path", "email").agg(F.count("*").alias("n"))
    # the greatest count first, then the least e-mail: both in one aggregate, without a window
    best = work.groupBy("repo_name", "path").agg(F.sum("n").alias("commits"), F.min(F.struct((-F.col("n")).alias("m"), "email")).alias("b"))
    return best.select("repo_name", "path", F.col("b.email").alias("owner"), F.round(-F.col("b.m") / F.col("commits"), 4).alias("share"), "commits")


def mr_overlaps(g: Graph, repo_name: str | None = None, state: str = "opened") -> DataFrame:
    """Pairs of merge requests of one repository and state that touch the same files, with how many: they may conflict."""
    mrs = named._where(g["merge_request"].where(F.col("state") == state), repo_name=repo_name).select("repo_name", "iid")
    files = named.mr_files(g, repo_name=repo_name).join(mrs, ["repo_name", "iid"], "left_semi")
    other = files.withColumnRenamed("iid", "other_iid")
    return files.join(other, ["repo_name", "path"]).where("iid < other_iid").groupBy("repo_name", "iid", "other_iid").agg(F.count("*").alias("shared_files"))
