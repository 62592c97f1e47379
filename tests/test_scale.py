"""Work and memory that must not grow faster than the input."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.plans import samples
from graphloom.sources import code

PART = "p_partkey long"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_files_are_parsed_once_and_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(samples, "FILES_PER_TASK", 10)
    spark.range(95).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    df = samples.parse(spark, str(tmp_path), "rust")
    assert plan(df).count("MapInArrow") == 1 and df.rdd.getNumPartitions() == 10
    assert df.count() == 95 * 4 and df.where("kind = 'method' AND name = 'C7.m7' AND list = 'self,a' AND other = 'g7'").count() == 1


def test_python_is_parsed_in_processes_that_end(monkeypatch):
    """Names that Python's parser met stay in its process for good."""
    monkeypatch.setattr(code, "PYTHON_AT_ONCE", 2)
    monkeypatch.setattr(code, "parse", lambda p, c, *_: None if "skip" in p else {"path": p, "pid": os.getpid()})
    found = {r["path"]: r["pid"] for r in code._parse_some([(p, b"") for p in ("a.py", "b.js", "skip.py", "x/c.PY", "no", "e.rs")], None, False)}
    assert set(found) == {"a.py", "b.js", "x/c.PY", "no", "e.rs"}
    assert found["b.js"] == found["no"] == found["e.rs"] == os.getpid() and len({found["a.py"], found["x/c.PY"], os.getpid()}) == 3


def test_faults_in_a_forked_process_are_told(monkeypatch):
    def parse(path, *_):
        if path == "gone.py":
            os._exit(3)
        raise KeyError(path)

    monkeypatch.setattr(code, "parse", parse)
    with pytest.raises(RuntimeError, match="KeyError.*a.py"):
        list(code._parse_some([("a.py", b"")], None, False))
    with pytest.raises(RuntimeError, match="without a result"):
        list(code._parse_some([("gone.py", b"")], None, False))


def test_one_row_of_texts_is_joined_by_all_tasks(spark):
    """Sorted over several partitions and batches, without nulls, and nothing of it passes through the driver."""
    from graphloom.plans import registry

    df = spark.range(25000).select(F.format_string("n%05d", F.col("id")).alias("a"), F.lit("x").alias("b")).repartition(7)
    nothing = df.where("a = 'no'").select("a")
    out = registry._one_row_of_texts({"pairs": (df, ["a", "b"]), "one": (df.where("a < 'n00003'").select("a").unionAll(spark.createDataFrame([(None,), ("",)], "a string")), ["a"]), "none": (nothing, ["a"])})
    row = out.head()
    assert row.pairs == ",".join(f"n{k:05d}>x" for k in range(25000)) and row.one == ",n00000,n00001,n00002" and row.none == ""
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [3, 7, 100])
def test_order_of_files_is_checked_across_batches_and_splits(spark, tmp_path, rows):
    """Faults inside a batch, at its ends and between the splits of one file; no sort of the rows themselves."""
    from graphloom import schema

    data = [("r", f"{k:03d}" if k not in (50, 33) else "000") for k in range(40, 60)] + [("s", "b"), ("s", None), ("r", "a"), (None, "c"), (None, "b")]
    spark.createDataFrame(data, "repo_name string, name string").coalesce(1).write.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        found = schema.unsorted(spark.read.parquet(f"{tmp_path}/t"), "name")
        assert sorted((r["row"], r["value"]) for r in found.collect()) == [(10, "000"), (21, None), (24, "b")]
        assert schema.unsorted(spark.read.parquet(f"{tmp_path}/t").where("repo_name = 's'"), "name").count() == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Window") < plan.rindex("MapInArrow")  # what is sorted is only what the tasks give
    # the ends of two splits of a file, as two tasks give them
    import pyarrow as pa

    batch = lambda row, values: pa.RecordBatch.from_pylist([{"file": "f", "row": row + k, "repo": "r", "value": v} for k, v in enumerate(values)])
    given = [[(r["row"], r["end"]) for b in schema._runs(iter(x)) for r in b.to_pylist()] for x in ([batch(0, "ab"), batch(2, "ca")], [batch(9, "a"), batch(4, "b")])]
    assert given == [[(0, "first"), (3, "bad"), (3, "last")], [(9, "first"), (9, "last"), (4, "first"), (4, "last")]]


def test_differences_in_one_pass(spark):
    """As two EXCEPT ALL count them, with nulls and repeated rows, each side read once."""
    from graphloom.plans import registry

    a = spark.createDataFrame([("x", 1), ("x", 1), ("y", None), ("z", 3)], "k string, v int")
    b = spark.createDataFrame([(1, "x"), (None, "y"), (None, "y"), (4, "z")], "v int, k string")
    one = registry._differences(a, b)
    assert tuple(one.head()) == (4, 4) and plan(one).count("LogicalRDD") == 2
    assert tuple(registry._differences(a, a).head()) == (4, 0) and tuple(registry._differences(a.where("v > 9"), a.where("v > 9")).head()) == (0, 0)


def test_few_commits_are_sent_to_the_edges(spark):
    """The edges of one merge request, and of the newest commits, are found without a shuffle of all edges."""
    from graphloom import schema
    from graphloom.graph import Graph
    from graphloom.plans import named

    # as large as Spark takes what it can't tell the size of
    edges = spark.range(100).mapInArrow(lambda it: it, "id long").select(*[(F.concat(F.lit("x"), "id") if f == "hash string" else F.lit("1")).cast(f.split()[1]).alias(f.split()[0]) for f in schema.EDGES["modifies"][0].split(", ")])
    held = spark.range(5).mapInArrow(lambda it: it, "id long").select(F.col("id").alias("iid"), F.lit("r").alias("repo_name"), F.concat(F.lit("x"), "id").alias("hash"))
    g = Graph(spark, {"modifies": edges, "contains_commit": held, "merge_request": schema.conform(held, "merge_request")})
    one = named._mr_modifies(g, 2, "r")
    assert one.count() == 1 and "BroadcastHashJoin" in one._jdf.queryExecution().executedPlan().toString()
    assert named._mr_modifies(g, None, None).count() == 5
