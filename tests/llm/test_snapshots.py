"""Stored snapshots of exact dedup with several batches, digests that clash, and packing's spread of hot ids."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, packing, tables


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def found(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_two_batches_against_one_stored_snapshot(spark, tmp_path):
    old = frame(spark, [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (None, "c")])
    exact_dedup.build_snapshot(old, f"{tmp_path}/snap", keys_per_shard=2)
    before = {p: p.read_bytes() for p in (tmp_path / "snap").rglob("*.parquet")}
    for rows, want, copies in (
        ([(10, "b"), (11, "x"), (12, "x"), (13, ""), (14, None), (15, "a")], [(10, 2), (13, 5), (15, 1)], [(12, 11)]),
        ([(20, "x"), (20, "a"), (20, "zz"), (21, "a"), (22, "a"), (22, "a")], [(20, 1), (21, 1), (22, 1)], [(21, 20), (22, 20)]),
        ([], [], []),
    ):
        snapshot = exact_dedup.load_snapshot(f"{tmp_path}/snap", old)
        batch = frame(spark, rows)
        assert found(exact_dedup.screen_batch(batch, snapshot).distinct(), "doc_id", "keep_id") == want
        assert found(exact_dedup.batch_copies(batch).distinct(), "doc_id", "keep_id") == copies
    assert before == {p: p.read_bytes() for p in (tmp_path / "snap").rglob("*.parquet")}
    empty = exact_dedup.build_snapshot(frame(spark, []), f"{tmp_path}/none")
    assert exact_dedup.screen_batch(old, empty).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_clashing_digests_are_told_apart(spark, monkeypatch, seed):
    """With digests of two values only, the texts alone decide."""
    weak = lambda col="text": ((F.length(col) % 2).cast("long").alias("d1"), F.lit(0).cast("long").alias("d2"))
    monkeypatch.setattr(exact_dedup, "digest", weak)
    r = np.random.RandomState(seed)
    rows = [(i, "w" * int(r.randint(1, 30))) for i in range(200)] + [(7, "other"), (7, "other"), (201, None)]
    first = duckdb.connect()
    first.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    first.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(first.execute(exact_dedup.OP4_SQL).fetchall())
    assert found(exact_dedup.exact_duplicates(frame(spark, [rows[i] for i in r.permutation(len(rows))])), "doc_id", "keep_id", "found") == want


def test_a_third_of_all_rows_are_one_text(spark):
    ids = spark.range(60_000)
    df = ids.select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same text")).otherwise(F.hex(F.xxhash64("id"))).alias("text"))
    got = exact_dedup.exact_duplicates(df).groupBy("found").agg(F.count("*").alias("n"), F.max("keep_id").alias("k"))
    assert found(got, "found", "n", "k") == [("archive", 9999, 0), ("snapshot", 10_000, 0)]
    assert exact_dedup.drop_exact_duplicates(df).count() == 40_001


def test_packing_spreads_rows_of_one_id(spark):
    rows = [(None, "a b c")] * 3000 + [(5, "a b c d")] * 3000
    got = packing.pack(frame(spark, rows), capacity=7, pieces_per_partition=500).toPandas()
    assert len(got) == 6000 and got.groupby("part").size().max() < 700
    assert got.n_tokens.sum() == 21_000 and got.groupby(["part", "bin"]).n_tokens.sum().max() <= 7
    ints = packing.pack(frame(spark, [(1, "a b")]).withColumn("doc_id", F.col("doc_id").cast("int")).withColumn("row", F.lit("clash")))
    assert ints.collect()[0].doc_id == 1
    with pytest.raises(TypeError):
        packing.pack(frame(spark, rows).withColumn("doc_id", F.lit("x")))


def test_ids(spark):
    assert tables.with_ids(frame(spark, []).withColumn("doc_id", F.lit(1).cast("smallint"))).schema["doc_id"].dataType.simpleString() == "bigint"
