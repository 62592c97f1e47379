"""Exact deduplication against immutable snapshots, screened by binary-fuse filters.

A snapshot is made once of a table: its exact buckets (the doc_ids of each digest) and, for each shard of digests, a static 3-wise binary-fuse filter with 16-bit
fingerprints. Both are written and never change; any number of batches are screened against
what is stored. Incoming digests probe the filter of their shard; only positives join the
exact buckets, and a pair counts only if the whole texts are equal. Texts that occur twice in
the new batch are grouped separately, without touching the snapshot.

Digests have 128 bits. Texts are compared whole by grouping the candidates by the text itself;
the groups then go back to the rows by digest, or, where two texts share a digest, by text.

Defined results: a null text or null doc_id is never reported; empty texts equal
each other; the first document of a group is the one with the least doc_id;
repeated rows (same doc_id and text) count as one document; different texts under one doc_id
are taken each by itself; texts of any length are compared whole; ids are integers; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import materialize, new_path

from .tables import digest, hinted, read, with_ids
from .text import mix

#: Digests in one shard, so in one filter of about 2.3 MB.
KEYS_PER_SHARD = 1_000_000


class BinaryFuse16:
    """A static 3-wise binary-fuse filter over distinct 64-bit keys, built by peeling in numpy rounds."""

    def __init__(self, seed: int, segment: int, segments: int, cells: np.ndarray):
        self.seed, self.segment, self.segments, self.cells = seed, segment, segments, cells

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1)))
        first = ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
        g = mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        m = np.uint64(segment - 1)
        at = np.stack([(first + k) * segment + ((g >> np.uint64(21 * k)) & m).astype(np.int64) for k in range(3)])
        return at, (h ^ (h >> np.uint64(32))).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse16:
        keys = np.unique(np.asarray(keys).astype(np.uint64))
        n = len(keys)
        segment = 1 << int(np.clip(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25), 2, 18))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        segments = max(1, -(-int(n * factor + 8) // segment) - 2)
        for seed in range(200):
            if seed and seed % 20 == 0:
                segments += 1 + segments // 10
            cells = (segments + 2) * segment
            at, prints = cls._places(keys, seed, segment, segments)
            count = np.bincount(at.ravel(), minlength=cells)
            ids = np.zeros(cells, np.int64)
            for row in at:
                np.bitwise_xor.at(ids, row, np.arange(n))
            order, left = [], n
            single = np.flatnonzero(count == 1)
            while len(single):
                key, pick = np.unique(ids[single], return_index=True)
                cell = single[pick]
                order.append((key, cell))
                left -= len(key)
                places = at[:, key]
                for row in places:
                    np.bitwise_xor.at(ids, row, key)
                np.subtract.at(count, places.ravel(), 1)
                near = np.unique(places)
                single = near[count[near] == 1]
            if not left:
                table = np.zeros(cells, np.uint16)
                for key, cell in reversed(order):
                    a, b, c = at[:, key]
                    table[cell] = 0
                    table[cell] = prints[key] ^ table[a] ^ table[b] ^ table[c]
                return cls(seed, segment, segments, table)
        raise RuntimeError("binary-fuse construction failed")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        at, prints = self._places(np.asarray(keys).astype(np.uint64), self.seed, self.segment, self.segments)
        return (self.cells[at[0]] ^ self.cells[at[1]] ^ self.cells[at[2]]) == prints


_FILTER = "shard int, seed int, segment int, segments int, cells binary"


def build_filters(digests: DataFrame) -> DataFrame:
    """One filter for each shard of ``digests`` (shard, d1)."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        f = BinaryFuse16.build(pdf["d1"].to_numpy())
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1].astype("int32"), "seed": f.seed, "segment": f.segment, "segments": f.segments, "cells": [f.cells.tobytes()]})

    return digests.select("shard", "d1").groupBy("shard").applyInPandas(make, _FILTER)


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """The rows of ``incoming`` (shard, d1, d2) that their shard's filter accepts: all that are in the snapshot and about 1 in 65,536 others."""

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return left.iloc[:0][["d1", "d2"]]
        r = right.iloc[0]
        f = BinaryFuse16(int(r.seed), int(r.segment), int(r.segments), np.frombuffer(r.cells, np.uint16))
        return left.loc[f.contains(left["d1"].to_numpy()), ["d1", "d2"]]

    return incoming.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(probe, "d1 long, d2 long")


@dataclass
class Snapshot:
    """What is stored of a table (``filters``, ``buckets``: d1, d2, doc_id), and the table (``texts``: doc_id, text), which mustn't change."""

    filters: DataFrame
    buckets: DataFrame
    texts: DataFrame
    shards: int


def _shard(shards: int):
    return F.pmod(F.xxhash64("d1"), F.lit(shards)).cast("int").alias("shard")


def _texts(docs: DataFrame) -> DataFrame:
    return with_ids(docs).select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")


def _digests(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written digests of all rows (doc_id, d1, d2), and each digest with its least and greatest doc_id."""
    keys = materialize(texts.select("doc_id", *digest()), "digests")
    # a copy made thousands of times combines before the shuffle
    return keys, materialize(keys.groupBy("d1", "d2").agg(F.min("doc_id").alias("keep_id"), F.max("doc_id").alias("last")), "distinct")


def build_snapshot(docs: DataFrame, path: str | None = None, keys_per_shard: int = KEYS_PER_SHARD) -> Snapshot:
    """Make the snapshot of ``docs`` and write it to ``path`` (a folder of this session by default)."""
    return _build(docs, path, keys_per_shard)[0]


def _build(docs: DataFrame, path: str | None, keys_per_shard: int) -> tuple[Snapshot, DataFrame, DataFrame]:
    texts = _texts(docs)
    keys, distinct = _digests(texts)
    shards = max(1, -(-distinct.count() // keys_per_shard))
    path = path or new_path(docs.sparkSession, "snapshot")
    keys.select(_shard(shards), "d1", "d2", "doc_id").write.parquet(f"{path}/buckets")
    buckets = docs.sparkSession.read.parquet(f"{path}/buckets")
    build_filters(buckets.select("shard", "d1").distinct()).withColumn("shards", F.lit(shards)).write.parquet(f"{path}/filters")
    return load_snapshot(path, docs), keys, distinct


def load_snapshot(path: str, docs: DataFrame) -> Snapshot:
    """The snapshot of ``docs`` that is stored at ``path``."""
    spark = docs.sparkSession
    filters = spark.read.parquet(f"{path}/filters")
    first = filters.select("shards").head()
    return Snapshot(filters.drop("shards"), spark.read.parquet(f"{path}/buckets").drop("shard"), _texts(docs), first[0] if first else 1)


def _groups(texts: DataFrame, wanted: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, keep_id, d1, d2) for the rows of ``texts`` whose digest is in ``wanted``: keep_id is the least doc_id with that very text."""
    ids = hinted(materialize(keys.join(hinted(wanted), ["d1", "d2"], "left_semi").select("doc_id").distinct(), "candidates"))
    near = texts.join(ids, "doc_id", "left_semi")
    same = near.groupBy("text").agg(F.min("doc_id").alias("keep_id"), F.max("doc_id").alias("last")).where("keep_id < last")
    same = materialize(same.select(*digest(), "keep_id"), "same")  # the byte check is this grouping by the texts themselves
    clash = materialize(same.groupBy("d1", "d2").count().where("count > 1").select("d1", "d2"), "clash")
    out = keys.join(hinted(same), ["d1", "d2"]).select("doc_id", "keep_id", "d1", "d2")
    if clash.isEmpty():
        return out
    # two texts with one digest: their rows go back by the text
    text = texts.select("doc_id", "text", *digest()).join(hinted(clash), ["d1", "d2"], "left_semi")
    least = text.groupBy("text").agg(F.min("doc_id").alias("keep_id"))
    return out.join(hinted(clash), ["d1", "d2"], "left_anti").unionByName(text.join(least, "text").select("doc_id", "keep_id", "d1", "d2"))


def batch_copies(batch: DataFrame, keys: DataFrame | None = None, distinct: DataFrame | None = None) -> DataFrame:
    """(doc_id, keep_id, d1, d2) for each row of ``batch`` whose text a row with a lesser doc_id of the batch has."""
    texts = _texts(batch)
    if keys is None or distinct is None:
        keys, distinct = _digests(texts)
    wanted = materialize(distinct.where("keep_id < last").select("d1", "d2"), "repeated")
    return _groups(texts, wanted, keys).where("doc_id <> keep_id")


def screen_batch(batch: DataFrame, snapshot: Snapshot, keys: DataFrame | None = None, distinct: DataFrame | None = None) -> DataFrame:
    """(doc_id, keep_id, d1, d2) for each row of ``batch`` whose text the snapshot has; keep_id is the least doc_id there."""
    texts = _texts(batch)
    if keys is None or distinct is None:
        keys, distinct = _digests(texts)
    positive = screen(distinct.select(_shard(snapshot.shards), "d1", "d2"), snapshot.filters)
    bucket = materialize(snapshot.buckets.join(hinted(materialize(positive, "positive")), ["d1", "d2"], "left_semi"), "bucket")
    hits = materialize(bucket.select("d1", "d2").distinct(), "hits")
    # whole texts of the hits on both sides; copies combine before the shuffle
    old = snapshot.texts.join(hinted(materialize(bucket.select("doc_id").distinct(), "old-ids")), "doc_id", "left_semi").select("text", F.col("doc_id").alias("keep_id"))
    ids = hinted(materialize(keys.join(hinted(hits), ["d1", "d2"], "left_semi").select("doc_id").distinct(), "new-ids"))
    new = texts.join(ids, "doc_id", "left_semi").select("text", F.lit(None).cast("long").alias("keep_id"))
    both = old.unionAll(new).groupBy("text").agg(F.min("keep_id").alias("keep_id"), F.count_if(F.col("keep_id").isNull()).alias("n"))
    found = materialize(both.where("keep_id IS NOT NULL AND n > 0").select(*digest(), "keep_id", F.sha2("text", 256).alias("exact")), "found")
    clash = materialize(found.groupBy("d1", "d2").count().where("count > 1").select("d1", "d2"), "clash")
    out = keys.join(hinted(found.drop("exact")), ["d1", "d2"]).select("doc_id", "keep_id", "d1", "d2")
    if clash.isEmpty():
        return out
    rows = texts.select("doc_id", *digest(), F.sha2("text", 256).alias("exact")).join(hinted(clash), ["d1", "d2"], "left_semi")
    return out.join(hinted(clash), ["d1", "d2"], "left_anti").unionByName(rows.join(found, ["d1", "d2", "exact"]).select("doc_id", "keep_id", "d1", "d2"))


def exact_duplicates(docs: DataFrame, first_new_id: int | None = None, keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """Duplicates of ``docs`` as (doc_id, keep_id, found); see ``_duplicates``."""
    return _duplicates(docs, first_new_id, keys_per_shard).select("doc_id", "keep_id", "found").distinct()


def _duplicates(docs: DataFrame, first_new_id: int | None = None, keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """Duplicates of ``docs`` as (doc_id, keep_id, d1, d2, found).

    Documents below ``first_new_id`` are made a snapshot (the lower half of the id range by
    default), the others are the new batch. ``found``: 'snapshot' for a new document whose
    text the snapshot has, 'batch' for a new one that repeats another new one,
    'archive' for a repeat inside the snapshot itself.
    """
    docs = with_ids(docs).select("doc_id", "text")
    if first_new_id is None:
        lo, hi = docs.where("text IS NOT NULL").agg(F.min("doc_id"), F.max("doc_id")).head()
        first_new_id = 0 if lo is None else (lo + hi) // 2 + 1
    old, new = docs.where(F.col("doc_id") < first_new_id), docs.where(F.col("doc_id") >= first_new_id)
    snapshot, old_keys, old_distinct = _build(old, None, keys_per_shard)
    keys, distinct = _digests(_texts(new))
    archive = batch_copies(old, old_keys, old_distinct).withColumn("found", F.lit("archive"))
    hits = materialize(screen_batch(new, snapshot, keys, distinct), "snapshot-hits")
    batch = batch_copies(new, keys, distinct).join(hinted(hits.select("doc_id", "d1", "d2").distinct()), ["doc_id", "d1", "d2"], "left_anti")
    return archive.unionByName(hits.withColumn("found", F.lit("snapshot"))).unionByName(batch.withColumn("found", F.lit("batch")))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each text: the one with the least doc_id. Rows whose text or doc_id is null stay."""
    gone = hinted(materialize(_duplicates(docs).select(F.col("doc_id").alias("gone_id"), F.col("d1").alias("gone_d1"), F.col("d2").alias("gone_d2")).distinct(), "gone"))
    d1, d2 = digest()
    kept = docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (d1 == gone["gone_d1"]) & (d2 == gone["gone_d2"]), "left_anti")
    # rows repeated under one id: only those ids are shuffled
    twice = materialize(docs.where("doc_id IS NOT NULL AND text IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    twice = hinted(twice)
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionAll(kept.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


OP4_SQL = """
WITH b AS (SELECT (min(doc_id) + max(doc_id)) // 2 + 1 AS mid FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)
SELECT doc_id, keep_id, CASE WHEN doc_id < mid THEN 'archive' WHEN keep_id < mid THEN 'snapshot' ELSE 'batch' END AS found
FROM g, b WHERE doc_id <> keep_id
"""
