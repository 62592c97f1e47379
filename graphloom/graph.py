"""A graph: node and edge DataFrames by name, stored as versioned Parquet snapshots.

Below the root, each save writes the tables that changed to a folder of its own and then
makes a numbered pointer file with the place of every table. The highest complete pointer
is the current snapshot: nothing is replaced or deleted, so a reader always finds one. A pointer
is made only if its number is free, so of two writers that began with the same snapshot the
second fails instead of undoing the first.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema

TABLES_AT_ONCE = 8


class ConflictError(RuntimeError):
    """Another writer saved since this graph was loaded."""


class Origin:
    """What a graph was loaded from: root, number of the snapshot, and each table's place and frame."""

    def __init__(self, root: str, number: int, places: dict[str, str], frames: dict[str, DataFrame]):
        self.root, self.number, self.places, self.frames = root, number, places, frames


class Graph(Mapping):
    """Tables by name; a table that isn't there reads as empty."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame] | None = None, base: Origin | None = None):
        self.spark = spark
        self.tables = dict(tables or {})
        self.base = base

    def __getitem__(self, name: str) -> DataFrame:
        if name not in schema.TABLES:
            raise KeyError(name)
        return self.tables[name] if name in self.tables else schema.empty(self.spark, name)

    def __iter__(self):
        return iter(self.tables)

    def __len__(self) -> int:
        return len(self.tables)

    def __contains__(self, name: object) -> bool:
        return name in self.tables

    def with_tables(self, **tables: DataFrame) -> Graph:
        return Graph(self.spark, {**self.tables, **tables}, self.base)


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _pointers(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """Number and path of every pointer, the highest first."""
    fs, path = _fs(spark, f"{root}/pointers")
    if not fs.exists(path):
        return []
    names = [str(x.getPath().toString()) for x in fs.listStatus(path)]
    return sorted(((int(m[1]), n) for n in names if (m := re.search(r"/(\d+)\.json$", n))), reverse=True)


def _current(spark: SparkSession, root: str, number: int | None = None) -> tuple[int, dict[str, str]]:
    """The highest complete pointer (or the one of the number) and its tables' places; 0 and nothing where nothing was ever saved."""
    found = _pointers(spark, root)
    for k, path in found:
        if number in (None, k):
            lines = [r[0] for r in spark.read.text(path).collect()]  # one line; a second one says that it is complete
            if lines[-1:] == ["."]:
                return k, json.loads(lines[0])
    if found:
        raise RuntimeError(f"no complete snapshot {'' if number is None else number} at {root}")
    return 0, {}


def current_version(spark: SparkSession, root: str) -> int | None:
    """The number of the current snapshot, None where nothing is stored."""
    return _current(spark, root)[0] or None


def save(graph: Graph, root: str) -> int:
    """Write the tables of ``graph`` as a new snapshot below ``root`` and make it current; its number.

    Tables that are still what was loaded from ``root`` aren't written again. Tables that carry
    ``repo_name`` are clustered by it in files of the session's advisory size: small
    repositories share one, a large one has many, and each is sorted, so that a query bound to one
    repository reads few. Raises ConflictError if another writer was faster.
    """
    spark, base = graph.spark, graph.base if graph.base and graph.base.root == root else None
    number, places = (base.number, base.places) if base else _current(spark, root)
    folder = f"v-{uuid.uuid4().hex}"
    kept = {t: places[t] for t, df in graph.tables.items() if base and t in places and df is base.frames.get(t)}

    def write(name: str, df: DataFrame) -> None:
        df = schema.conform(df, name)
        if "repo_name" in df.columns:
            order = [c for c in dict.fromkeys(["repo_name", schema.SORTED.get(name, ""), *schema.TABLES[name][1]]) if c]
            df = df.hint("rebalance", F.col("repo_name")).sortWithinPartitions(*order)
        elif name in schema.SORTED:
            df = df.sortWithinPartitions(schema.SORTED[name])
        df.write.parquet(f"{root}/{folder}/{name}")

    fresh = {t: df for t, df in graph.tables.items() if t not in kept}
    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:  # the tables' jobs share the cluster
        for done in [pool.submit(write, *item) for item in fresh.items()]:
            done.result()
    found = _pointers(spark, root)
    if found and found[0][0] > number:
        raise ConflictError(f"snapshot {number + 1} of {root} was saved by another writer")
    fs, pointer = _fs(spark, f"{root}/pointers/{number + 1:012d}.json")
    try:
        out = fs.create(pointer, False)
    except Exception as e:
        raise ConflictError(f"snapshot {number + 1} of {root} was saved by another writer") from e
    out.write(bytearray(f"{json.dumps(kept | {t: f'{folder}/{t}' for t in fresh})}\n.\n".encode()))
    out.close()
    return number + 1


def load(spark: SparkSession, root: str, version: int | None = None) -> Graph:
    """The current snapshot (or the given one); an empty graph where nothing was ever stored."""
    number, places = _current(spark, root, version)
    tables = {t: spark.read.schema(schema.TABLES[t][0]).parquet(f"{root}/{p}") for t, p in places.items() if t in schema.TABLES}
    return Graph(spark, tables, Origin(root, number, places, dict(tables)))


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete the pointers of all but the last ``keep`` snapshots and the folders that only those used; readers of older ones must have ended."""
    pointers = _pointers(spark, root)
    used = {p.split("/")[0] for k, _ in pointers[:keep] for p in _current(spark, root, k)[1].values()}
    gone = []
    for k, path in pointers[keep:]:
        gone += [p.split("/")[0] for p in _current(spark, root, k)[1].values()]
        fs, at = _fs(spark, path)
        fs.delete(at, False)
    gone = sorted(set(gone) - used)
    for folder in gone:
        fs, at = _fs(spark, f"{root}/{folder}")
        fs.delete(at, True)
    return gone


def initialize(spark: SparkSession, root: str) -> Graph:
    """Create every table that isn't stored yet, empty; what is there stays."""
    graph = load(spark, root)
    missing = [t for t in schema.TABLES if t not in graph]
    if missing:
        save(graph.with_tables(**{t: schema.empty(spark, t) for t in missing}), root)
    return load(spark, root)


def drop_catalog(spark: SparkSession) -> list[str]:
    """Drop the temporary views of the graph's tables; stored data stays."""
    return [t for t in schema.TABLES if spark.catalog.dropTempView(f"graph_{t}")]


def register_views(graph: Graph) -> None:
    """Each table as the temporary view ``graph_<table>``, for SQL over the graph."""
    for name in schema.TABLES:
        graph[name].createOrReplaceTempView(f"graph_{name}")
