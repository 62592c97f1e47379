"""Small relational helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import materialize

#: A side is broadcast only if it has been counted and has no more rows than this.
BROADCAST_ROWS = 500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def hinted(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` (a written table, so that counting is cheap) with a broadcast hint if its checked size allows; else as it is, for a shuffled join."""
    return F.broadcast(small) if small.count() <= limit else small


def lowered(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns of ``keep`` and ``t``, the text in lower case with null as empty."""
    return docs.select(*keep, F.lower(F.coalesce("text", F.lit(""))).alias("t"))


def digest(col: str = "text") -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a text."""
    return F.xxhash64(col).alias("d1"), F.xxhash64(F.lit(7), F.col(col)).alias("d2")


def with_ids(docs: DataFrame, column: str = "doc_id") -> DataFrame:
    """``docs`` with its integer ids as 64-bit ones; ids of another kind are an error."""
    kind = docs.schema[column].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"{column} must be an integer column, not {kind}")
    return docs if kind == "bigint" else docs.withColumn(column, F.col(column).cast("long"))


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of ``edges`` (a, b) as (node, root): root is the least node reached.

    Alternating large-star and small-star rounds, each written to the shared folder,
    until nothing changes. A node's least neighbour is a combined aggregate that is joined
    back, so a node with a third of all edges is no single task. Self-loops and repeated
    edges do no harm.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())

    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(e)
    if before[0] == 0:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        # an edge (a, b) has a > b: the least neighbour of b is among the b's of its own edges, else it is b
        least = e.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = e.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        e = materialize(small.where("a <> b").distinct(), "edges")
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
