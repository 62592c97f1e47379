"""Full and incremental loads of a repository into a stored graph, with a cursor.

A load reads the current snapshot, merges what is new and saves a new snapshot; the cursor
is a row of the same snapshot, so data and cursor can't part. Because merging is idempotent,
a full load equals a load of a prefix followed by an update.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .config import Config
from .graph import Graph, load, save
from .operators import ingest
from .operators.upsert import upsert
from .sources import code, git, gitlab
from .storage import materialize


def get_sync_state(graph: Graph, repo_name: str) -> dict | None:
    row = graph["sync_state"].where(F.col("repo_name") == repo_name).head()
    return row.asDict() if row else None


def update_sync_state(graph: Graph, repo_name: str, last_commit_hash: str | None = None, last_mr_updated_at=None) -> Graph:
    """The graph with the repository's cursor set; what isn't given keeps its value."""
    new = graph.spark.createDataFrame([(repo_name, last_commit_hash, last_mr_updated_at)], "repo_name string, last_commit_hash string, last_mr_updated_at timestamp").withColumn("updated_at", F.current_timestamp())
    return graph.with_tables(sync_state=upsert(graph["sync_state"], new, ["repo_name"], keep_old_if_null=True))


def ingest_local_commits(graph: Graph, path: str, repo_name: str, branch: str | None = None, since: str | None = None, max_count: int | None = None) -> tuple[Graph, int]:
    """Commits of a clone merged into ``graph``, and their number."""
    spark = graph.spark
    # the history is read once; every table is made of what was written
    records = materialize(git.load(spark, path, "commits", branch=branch, since=since, maxCount=max_count, repoName=repo_name), "commit-records")
    commits, changes, parents = ingest.flatten_commits(records)
    return ingest.ingest_commits(graph, commits, changes.withColumnRenamed("pos", "commit_pos"), parents), records.count()


def ingest_local_code(graph: Graph, path: str, cfg: Config) -> Graph:
    files = code.read_directory(graph.spark, path)
    return _ingest_code(graph, files, cfg)


def _ingest_code(graph: Graph, files: DataFrame, cfg: Config) -> Graph:
    records = materialize(code.parse_files(files, cfg.repo_name, cfg.parsing.languages, cfg.parsing.ignore_patterns, cfg.parsing.strict), "parsed-files")  # parsed once
    return ingest.ingest_files(graph, *ingest.flatten_files(records))


def ingest_documents(graph: Graph, raw: DataFrame, repo_name: str) -> Graph:
    """Merge requests from raw JSON documents (``value``)."""
    docs = gitlab.parse_merge_requests(raw)
    out = ingest.ingest_merge_requests(graph, gitlab.merge_requests(docs, repo_name), gitlab.mr_commits(docs, repo_name), gitlab.reviews(docs, repo_name), gitlab.notes(docs, repo_name))
    return out.with_tables(mr_diff=schema.conform(gitlab.mr_diffs(docs, repo_name), "mr_diff") if "mr_diff" not in out else out["mr_diff"].unionByName(schema.conform(gitlab.mr_diffs(docs, repo_name), "mr_diff")).dropDuplicates(["iid", "repo_name", "new_path"]))


def _client(g) -> gitlab.Client:
    return gitlab.Client(token=g.private_token, address=g.url, project=g.project_id)


def _merge_requests(graph: Graph, cfg: Config, since) -> Graph:
    g = cfg.gitlab
    raw = materialize(gitlab.read(graph.spark, g.url, g.project_id, g.private_token, updated_after=since and since.isoformat()), "merge-requests")  # fetched once
    out = ingest_documents(graph, raw, cfg.repo_name)
    newest = gitlab.parse_merge_requests(raw).agg(F.max(F.try_to_timestamp("updated_at"))).head()[0]
    return update_sync_state(out, cfg.repo_name, last_mr_updated_at=newest) if newest is not None else out


def ingest_all(spark: SparkSession, cfg: Config) -> dict[str, int]:
    """Full load: repository, branches, commits, code, merge requests, cursor."""
    return _run(spark, cfg, full=True)


def update(spark: SparkSession, cfg: Config) -> dict[str, int]:
    """Load what is new since the cursor; the whole history if there is none. The repository row isn't made here."""
    return _run(spark, cfg, full=False)


def _local(graph: Graph, cfg: Config, tip: str | None, since: str | None) -> tuple[Graph, int]:
    path = cfg.repository.path
    graph, n = ingest_local_commits(graph, path, cfg.repo_name, tip, since, cfg.sync.max_commits)
    return (ingest_local_code(graph, path, cfg) if cfg.parsing.ast_enabled else graph), n


def _remote(graph: Graph, cfg: Config, tip: str | None, since: str | None) -> tuple[Graph, int]:
    g, name = cfg.gitlab, cfg.repo_name
    raw = materialize(gitlab.read(graph.spark, g.url, g.project_id, g.private_token, "commits", branch=tip, since=since, max_count=cfg.sync.max_commits), "remote-commits")
    records = materialize(gitlab.commits(raw, name, tip, since, cfg.sync.max_commits), "commit-records")
    commits, changes, parents = ingest.flatten_commits(records)
    graph = ingest.ingest_commits(graph, commits, changes.withColumnRenamed("pos", "commit_pos"), parents)
    if cfg.parsing.ast_enabled:
        graph = _ingest_code(graph, gitlab.read(graph.spark, g.url, g.project_id, g.private_token, "files", branch=tip), cfg)
    return graph, records.count()


def _run(spark: SparkSession, cfg: Config, full: bool) -> dict[str, int]:
    root, name, path = cfg.store.path, cfg.repo_name, cfg.repository.path
    if not path and not cfg.gitlab:
        raise ValueError("repository.path or gitlab must be configured")
    graph = load(spark, root)
    state = None if full else get_sync_state(graph, name)
    asked = cfg.repository.branch or (cfg.gitlab.branch if cfg.remote else None)
    if cfg.remote:
        heads = gitlab.branches(_client(cfg.gitlab), asked)
    else:
        heads = git.branches(path, asked or "main")
    tip = asked or next((n for n, default, _ in heads if default), None)
    if full:
        repo = spark.createDataFrame([(name, path or cfg.gitlab.url, tip)], "name string, url string, default_branch string")
        graph = ingest.ingest_repository(graph, repo)
    graph = ingest.ingest_branches(graph, spark.createDataFrame([(name, *h) for h in heads], "repo_name string, name string, is_default boolean, head_commit_hash string"))
    graph, n = (_remote if cfg.remote else _local)(graph, cfg, tip, state and state["last_commit_hash"])
    if cfg.gitlab:
        graph = _merge_requests(graph, cfg, state and state["last_mr_updated_at"])
    graph = update_sync_state(graph, name, last_commit_hash=next((h for b, _, h in heads if b == tip), None))
    save(graph, root)
    stored = load(spark, root)
    return {"commits": n, "files": stored["file"].where(F.col("repo_name") == name).where("language IS NOT NULL").count(), "merge_requests": stored["merge_request"].where(F.col("repo_name") == name).count()}
