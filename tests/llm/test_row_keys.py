"""Different texts under one id, in shuffled row order, against SQL; hot minimizers; ids of other types."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, suffix_dedup
from graphloom.llm.text import Tokens

R = np.random.RandomState(41)
WORDS = ["".join(chr(97 + c) for c in R.randint(0, 26, 5)) for _ in range(3000)]


def prose(seed, n):
    return " ".join(np.random.RandomState(seed).choice(WORDS, n))


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, (columns, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({columns})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def same(df, columns, rows):
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted(rows, key=key)


def corpus():
    long, other, third = prose(1, 120), prose(2, 90), prose(3, 70)
    rows = [(1, long), (2, prose(4, 30) + " " + long), (2, other), (3, other + " " + prose(5, 20)), (4, third + " " + prose(6, 9)), (4, prose(7, 5) + " " + third), (5, long), (5, long), (6, None), (7, ""), (None, long)]
    return rows + [(10 + k, prose(20 + k, 60)) for k in range(6)]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_repeats_with_two_texts_of_one_id(spark, seed):
    rows = corpus()
    order = [rows[i] for i in np.random.RandomState(seed).permutation(len(rows))]
    got = suffix_dedup.repeated_passages(spark.createDataFrame(order, "doc_id int, text string").withColumn("key", F.lit("clash")).withColumn("seg", F.lit(1)).repartition(3))
    columns, want = by_sql(suffix_dedup.OP8_SQL, documents=("doc_id BIGINT, text VARCHAR", rows))
    assert want and same(got, columns, want) and not any(r[0] == 4 for r in want)


def test_hot_minimizers_give_the_same_spans(spark):
    rows = [(k, f"{prose(50 + k, 30)} {prose(1, 80)} {prose(90 + k, 30)} {prose(2, 55)}") for k in range(40)]
    rows += [(100 + k, "same words again and again " * (20 + k)) for k in range(30)]  # one minimizer, many lengths
    df = spark.createDataFrame(rows, "doc_id long, text string")
    columns, want = by_sql(suffix_dedup.OP8_SQL, documents=("doc_id BIGINT, text VARCHAR", rows))
    assert same(suffix_dedup.repeated_passages(df), columns, want) and same(suffix_dedup.repeated_passages(df, hot=500), columns, want)


def test_many_contexts_of_one_minimizer(spark, monkeypatch):
    """A run of words in 20,000 contexts: its minimizer's segments are split, the largest sort stays small."""
    import pyarrow as pa

    run = prose(1, 55).split()
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.hex(F.xxhash64("id", F.lit(k))) for k in range(3)], *map(F.lit, run), *[F.hex(F.xxhash64("id", F.lit(k))) for k in range(3, 6)]).alias("text"))
    got = suffix_dedup.repeated_passages(ids, hot=100_000)
    assert got.agg(F.count("*"), F.min("first_word"), F.max("first_word"), F.min("n_words"), F.max("n_words"), F.max("origin")).head()[:] == (20_000, 3, 3, 55, 55, 0)
    tokens = Tokens(pa.array([r.text for r in ids.limit(50).collect()]))
    low = suffix_dedup.segments(tokens)[3]
    fine = suffix_dedup.segments(tokens, heavy=np.unique(low))
    assert fine[2].sum() == suffix_dedup.segments(tokens)[2].sum() and len(np.unique(fine[3])) > len(np.unique(low))


@pytest.mark.parametrize("seed", [0, 1])
def test_decontaminate_with_two_texts_of_one_id(spark, seed):
    rows = corpus()
    items = [(1, " ".join(prose(1, 120).split()[20:60])), (1, " ".join(prose(2, 90).split()[10:50])), (2, prose(300, 40)), (None, " ".join(prose(3, 70).split()[5:40])), (3, None), (1, " ".join(prose(1, 120).split()[20:60]))]
    r = np.random.RandomState(seed)
    docs = spark.createDataFrame([rows[i] for i in r.permutation(len(rows))], "doc_id int, text string").withColumn("d1", F.lit("clash")).withColumn("item_id", F.lit(1)).repartition(3)
    bench = spark.createDataFrame([items[i] for i in r.permutation(len(items))], "item_id int, text string").withColumn("doc_id", F.lit(1))
    columns, want = by_sql(decontaminate.OP2_SQL, documents=("doc_id BIGINT, text VARCHAR", rows), benchmark=("item_id BIGINT, text VARCHAR", items))
    assert same(decontaminate.contaminated(docs, bench), columns, want) and {(3, 1), (4, None)} <= {(w[columns.index("doc_id")], w[columns.index("item_id")]) for w in want}
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["6", "7", "None", *[str(10 + k) for k in range(6)]])


def test_benchmark_slices_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BYTES_PER_PASS", 500)
    rows = corpus()
    items = [(k, " ".join(prose(1, 120).split()[k : k + 40])) for k in range(0, 60, 10)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns, want = by_sql(decontaminate.OP2_SQL, documents=("doc_id BIGINT, text VARCHAR", rows), benchmark=("item_id BIGINT, text VARCHAR", items))
    assert same(decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench), columns, want)


def test_other_ids_are_refused(spark):
    df = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    for call in (suffix_dedup.repeated_passages, lambda d: decontaminate.contaminated(d, d.withColumn("item_id", F.lit(1)))):
        with pytest.raises(TypeError, match="integer"):
            call(df)
