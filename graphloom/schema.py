"""Node and edge tables: columns, keys, and the schema operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: table -> (columns, key columns). Node tables first.
NODES: dict[str, tuple[str, tuple[str, ...]]] = {
    "repository": ("name string, url string, default_branch string, updated_at timestamp", ("name",)),
    "branch": ("repo_name string, name string, is_default boolean, head_commit_hash string, updated_at timestamp", ("name", "repo_name")),
    "commit": ("hash string, short_hash string, message string, timestamp timestamp, branch string, repo_name string, updated_at timestamp", ("hash",)),
    "author": ("email string, name string, gitlab_username string, updated_at timestamp", ("email",)),
    "file": ("repo_name string, path string, language string, size bigint, updated_at timestamp", ("path", "repo_name")),
    "directory": ("repo_name string, path string, updated_at timestamp", ("path", "repo_name")),
    "merge_request": (
        "iid bigint, repo_name string, title string, description string, state string, source_branch string, target_branch string, author_name string, author_username string, created_at timestamp, updated_at timestamp, merged_at timestamp, closed_at timestamp, web_url string, labels array<string>, notes_count bigint, updated_at_sync timestamp",
        ("iid", "repo_name"),
    ),
    "class": ("repo_name string, qualified_name string, name string, file_path string, start_line bigint, end_line bigint, bases array<string>, updated_at timestamp", ("qualified_name", "repo_name")),
    "function": (
        "repo_name string, qualified_name string, name string, file_path string, start_line bigint, end_line bigint, parameters array<string>, return_type string, is_method boolean, class_name string, calls array<string>, updated_at timestamp",
        ("qualified_name", "repo_name"),
    ),
    "sync_state": ("repo_name string, last_commit_hash string, last_mr_updated_at timestamp, updated_at timestamp", ("repo_name",)),
    "user": ("username string, name string, email string, updated_at timestamp", ("username",)),
}
EDGES: dict[str, tuple[str, tuple[str, ...]]] = {
    "has_branch": ("repo_name string, branch string", ("repo_name", "branch")),
    "has_commit": ("repo_name string, hash string", ("repo_name", "hash")),
    "authored_by": ("hash string, email string", ("hash", "email")),
    "committed_by": ("hash string, email string", ("hash", "email")),
    "parent_of": ("parent string, child string", ("parent", "child")),
    "modifies": ("hash string, repo_name string, path string, status string, old_path string, additions bigint, deletions bigint", ("hash", "repo_name", "path")),
    "child_of": ("repo_name string, parent string, child string", ("repo_name", "parent", "child")),
    "contains_file": ("repo_name string, directory string, path string", ("repo_name", "directory", "path")),
    "contains_class": ("repo_name string, path string, qualified_name string", ("repo_name", "path", "qualified_name")),
    "inherits": ("repo_name string, child string, parent string", ("repo_name", "child", "parent")),
    "contains_function": ("repo_name string, path string, qualified_name string", ("repo_name", "path", "qualified_name")),
    "has_method": ("repo_name string, class string, function string", ("repo_name", "class", "function")),
    "calls": ("repo_name string, caller string, callee string", ("repo_name", "caller", "callee")),
    "imports": ("repo_name string, source string, target string, imported_name string, alias string", ("repo_name", "source", "target")),
    "created_by": ("iid bigint, repo_name string, dst_label string, dst_key string", ("iid", "repo_name", "dst_label", "dst_key")),
    "sources": ("iid bigint, repo_name string, branch string", ("iid", "repo_name", "branch")),
    "targets": ("iid bigint, repo_name string, branch string", ("iid", "repo_name", "branch")),
    "contains_commit": ("iid bigint, repo_name string, hash string", ("iid", "repo_name", "hash")),
    "reviewed_by": ("iid bigint, repo_name string, dst_label string, dst_key string, approved boolean, created_at timestamp", ("iid", "repo_name", "dst_label", "dst_key")),
    "has_merge_request": ("repo_name string, iid bigint", ("repo_name", "iid")),
}
#: Extracted but not part of the graph proper: kept beside it. ``pending_parent`` has the parent relations that a stream has met before their commits.
DETAILS: dict[str, tuple[str, tuple[str, ...]]] = {
    "mr_note": ("iid bigint, repo_name string, pos bigint, author_username string, author_name string, body string, created_at timestamp, is_system boolean, noteable_type string", ("iid", "repo_name", "pos")),
    "mr_diff": ("iid bigint, repo_name string, new_path string, old_path string, new_file boolean, renamed_file boolean, deleted_file boolean", ("iid", "repo_name", "new_path")),
    "pending_parent": ("parent string, child string", ("parent", "child")),
}
TABLES = NODES | EDGES | DETAILS
#: Columns that rows are sorted by inside files, so that Parquet's minima and maxima prune lookups.
SORTED = {"commit": "timestamp", "file": "language", "merge_request": "state", "author": "name", "function": "name", "class": "name"}


def columns(table: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in TABLES[table][0].split(", ")]


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table][0])


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with exactly the table's columns and types; missing ones are null."""
    have = set(df.columns)
    out = []
    for field in TABLES[table][0].split(", "):
        name, kind = field.split(" ", 1)
        out.append((F.col(f"`{name}`") if name in have else F.lit(None)).cast(kind).alias(name))
    return df.select(*out)


def quote(name: str) -> str:
    """A back-quoted identifier for Spark SQL."""
    return "`" + name.replace("`", "``") + "`"


def violations(df: DataFrame, table: str) -> DataFrame:
    """Keys of ``df`` that occur more than once, with their count."""
    return df.groupBy(*TABLES[table][1]).count().where("count > 1")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, row, repo, value) in the order of their files -> those out of order ('bad'), and both ends of each run of following rows ('first', 'last')."""
    last = None

    def rows(batch: pa.RecordBatch, at: list[int], end: str) -> pa.RecordBatch:
        found = batch.take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays([*found.columns, pa.array([end] * len(at), pa.string())], names=[*batch.schema.names, "end"])

    for batch in batches:
        if not len(batch):
            continue
        both = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        before, after = both.slice(0, len(both) - 1), both.slice(1)
        same = lambda c: pc.or_kleene(pc.fill_null(pc.equal(before[c], after[c]), False), pc.and_(pc.is_null(before[c]), pc.is_null(after[c])))  # noqa: B023, E731
        follows = pc.and_(same("file"), pc.equal(pc.add(before["row"], 1), after["row"]))
        falls = pc.or_(pc.fill_null(pc.less(after["value"], before["value"]), False), pc.and_(pc.is_null(after["value"]), pc.is_valid(before["value"])))
        bad = pc.indices_nonzero(pc.and_(pc.and_(follows, same("repo")), falls)).to_pylist()
        new = pc.indices_nonzero(pc.invert(follows)).to_pylist()
        if bad:
            yield rows(after, bad, "bad")
        if new:
            yield rows(before, new, "last")
            yield rows(after, new, "first")
        if last is None:
            yield rows(batch, [0], "first")
        last = batch.slice(len(batch) - 1)
    if last is not None:
        yield rows(last, [0], "last")


def unsorted(df: DataFrame, column: str) -> DataFrame:
    """Rows of a stored table that come, in their file, before a row of the same repository that they should follow by ``column``."""
    repo = F.col("repo_name") if "repo_name" in df.columns else F.lit(None).cast("string")
    rows = df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), repo.alias("repo"), F.col(column).alias("value"))
    # tasks read their parts of files in order and compare as they go: only the ends of the parts are sorted
    found = rows.mapInArrow(_runs, StructType([*rows.schema.fields, StructField("end", StringType())]))
    place = Window.partitionBy("file").orderBy("row", F.desc("end"))
    ends = found.where("end <> 'bad'").select("*", *[F.lag(c).over(place).alias(f"{c}0") for c in ("row", "repo", "value", "end")])
    apart = ends.where("end = 'first' AND end0 = 'last' AND row = row0 + 1 AND repo <=> repo0 AND (value < value0 OR value IS NULL AND value0 IS NOT NULL)")
    keep = ["file", "row", "repo", "value"]
    return found.where("end = 'bad'").select(*keep).unionAll(apart.select(*keep))


def _is_sorted(graph, table: str, column: str) -> bool:
    if table not in graph or column not in graph[table].columns:
        return False
    try:
        return unsorted(graph[table], column).isEmpty()
    except AnalysisException:  # not read from files
        return False


def verify(graph) -> dict[str, bool]:
    """For each uniqueness rule and sort order, whether the stored graph has it: the table is there and its key is unique, or every file of it is sorted by the column inside each repository."""
    out = {}
    for table in NODES:
        out[f"unique:{table}"] = table in graph and violations(graph[table], table).isEmpty()
    for table, column in SORTED.items():
        out[f"sorted:{table}.{column}"] = _is_sorted(graph, table, column)
    return out
