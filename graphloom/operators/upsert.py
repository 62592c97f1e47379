"""Idempotent upserts: last write wins by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], seq: list[str | Column]) -> DataFrame:
    """One row for each key: the one that is last by ``seq``, a total order. Combines map-side, so hot keys don't hurt."""
    props = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(s) if isinstance(s, str) else s for s in seq])
    if not props:
        return df.distinct()
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*props), order).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.`{p}`").alias(p) for p in props])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], set_columns: list[str] | None = None, keep_old_if_null: bool = False) -> DataFrame:
    """``old`` with the rows of ``new`` merged in by key (``new`` has one row for each).

    Columns in ``set_columns`` (all others of ``new`` by default) take the new value where a
    row is incoming, or, with ``keep_old_if_null``, where that value isn't null. Columns
    that ``new`` lacks keep the old value. Keys compare null-safe.
    """
    changed = set(set_columns if set_columns is not None else [c for c in new.columns if c not in keys])
    n = new.select(*[F.col(f"`{c}`").alias(f"__n_{c}") for c in new.columns], F.lit(True).alias("__incoming"))
    on = None
    for k in keys:
        c = old[k].eqNullSafe(n[f"__n_{k}"])
        on = c if on is None else on & c
    joined = old.withColumn("__stored", F.lit(True)).join(n, on, "full_outer")
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.when(F.col("__stored"), F.col(f"`{c}`")).otherwise(F.col(f"__n_{c}")).alias(c))
        elif c in changed:
            fresh = F.coalesce(F.col(f"__n_{c}"), F.col(f"`{c}`")) if keep_old_if_null else F.col(f"__n_{c}")
            out.append(F.when(F.col("__incoming"), fresh).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return joined.select(*out)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it doesn't have."""
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)
