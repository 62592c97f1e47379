"""Extraction records -> node and edge tables -> merged into a graph.

Edges are resolved after all nodes are known, over the merged node tables; that is the
state to which repeated batch loads converge. All last-write rules use an explicit order:
``pos`` is a record's position in its load, ``load`` the load's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions.columns import ancestors, dirname, mr_state, short_hash
from graphloom.graph import Graph

from .upsert import insert_missing, last_wins, upsert

BATCH = 500


def _merge(graph: Graph, table: str, new: DataFrame, **options) -> DataFrame:
    keys = list(schema.TABLES[table][1])
    if table not in graph:
        return schema.conform(new, table)
    kept = [c for c in new.columns if c in schema.columns(table)]
    return upsert(graph[table], new.select(*kept), keys, **options)


def _edge(graph: Graph, table: str, new: DataFrame) -> DataFrame:
    """Edges of ``new`` merged into the stored ones; at most one for each key."""
    keys = list(schema.TABLES[table][1])
    new = schema.conform(new, table)
    if len(keys) == len(new.columns):
        new = new.distinct()
        return new if table not in graph else graph[table].unionByName(new).distinct()
    return new if table not in graph else upsert(graph[table], new, keys)


# --- repository and branches


def ingest_repository(graph: Graph, repos: DataFrame) -> Graph:
    """``repos``: name, url, default_branch."""
    new = last_wins(repos.select("name", "url", "default_branch"), ["name"], ["url", "default_branch"]).withColumn("updated_at", F.current_timestamp())
    return graph.with_tables(repository=_merge(graph, "repository", new))


def ingest_branches(graph: Graph, branches: DataFrame) -> Graph:
    """``branches``: repo_name, name, is_default, head_commit_hash. HAS_BRANCH needs the repository."""
    new = last_wins(branches.select("repo_name", "name", "is_default", "head_commit_hash"), ["name", "repo_name"], ["is_default", "head_commit_hash"])
    merged = _merge(graph, "branch", new.withColumn("updated_at", F.current_timestamp()))
    owners = graph["repository"].select(F.col("name").alias("repo_name"))
    edges = new.select("repo_name", F.col("name").alias("branch")).join(owners, "repo_name", "left_semi")
    return graph.with_tables(branch=merged, has_branch=_edge(graph, "has_branch", edges))


# --- commits


def flatten_commits(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested commit records (with repo_name and pos) -> commits, changes, parents."""
    commits = records.select(
        "repo_name", "pos", "hash", F.coalesce("short_hash", short_hash(F.col("hash"))).alias("short_hash"), "message", "timestamp", "branch",
        F.coalesce("author.email", F.lit("")).alias("author_email"), F.col("author.name").alias("author_name"), F.coalesce("committer.email", F.lit("")).alias("committer_email"), F.col("committer.name").alias("committer_name"),
    )
    changes = records.select("repo_name", "pos", "hash", F.posexplode("diffs").alias("k", "d")).select("repo_name", "pos", "hash", "k", "d.*")
    parents = records.select("hash", F.explode("parent_hashes").alias("parent"))
    return commits, changes, parents


def author_names(commits: DataFrame, batch: int = BATCH) -> DataFrame:
    """(email, name) of authors and committers, last write wins: loads by repository, batches of ``batch`` commits in order; in a batch the committers come after the authors."""
    when = [F.col("repo_name"), F.floor(F.col("pos") / batch).alias("batch")]
    rows = commits.select(
        *when, "pos", F.explode(F.array(F.struct(F.lit(0).alias("role"), F.col("author_email").alias("email"), F.col("author_name").alias("name")), F.struct(F.lit(1).alias("role"), F.col("committer_email").alias("email"), F.col("committer_name").alias("name")))).alias("p")
    ).select("repo_name", "batch", "pos", "p.*")
    return last_wins(rows.select("email", "name", "repo_name", "batch", "role", "pos"), ["email"], ["repo_name", "batch", "role", "pos"]).select("email", "name")


def modified_files(changes: DataFrame) -> DataFrame:
    """One MODIFIES edge for each commit and path: the change that comes last."""
    flat = changes.select("hash", "repo_name", "path", "status", "old_path", F.coalesce("additions", F.lit(0)).cast("bigint").alias("additions"), F.coalesce("deletions", F.lit(0)).cast("bigint").alias("deletions"), "k")
    return last_wins(flat, ["hash", "repo_name", "path"], ["k", "status", "additions", "deletions"]).drop("k")


def ingest_commits(graph: Graph, commits: DataFrame, changes: DataFrame, parents: DataFrame, all_changes: DataFrame | None = None) -> Graph:
    """``commits``: repo_name, pos, hash, short_hash, message, timestamp, branch, author_*, committer_*; ``changes``: repo_name, hash, k, path, old_path, status, additions, deletions; ``parents``: hash, parent.

    With ``all_changes`` (repo_name, path), ``changes`` are already the last ones, as ``modified_files`` gives them.
    """
    now = F.current_timestamp()
    nodes = last_wins(commits.select("hash", "short_hash", "message", "timestamp", "branch", "repo_name", "pos"), ["hash"], ["repo_name", "pos"]).drop("pos")
    merged = _merge(graph, "commit", nodes.withColumn("updated_at", now))
    authors = _merge(graph, "author", author_names(commits).withColumn("updated_at", now))
    modifies = modified_files(changes) if all_changes is None else changes
    # every change, not only the last one, names the same files, and costs no look at the others
    files = insert_missing(graph["file"], (changes if all_changes is None else all_changes).select("path", "repo_name").withColumn("updated_at", now), ["path", "repo_name"])
    ends = merged.select("hash")
    edges = parents.select("parent", F.col("hash").alias("child")).join(ends.withColumnRenamed("hash", "parent"), "parent", "left_semi").join(ends.withColumnRenamed("hash", "child"), "child", "left_semi")
    owners = graph["repository"].select(F.col("name").alias("repo_name"))
    return graph.with_tables(
        commit=merged,
        author=authors,
        file=schema.conform(files, "file"),
        authored_by=_edge(graph, "authored_by", commits.select("hash", F.col("author_email").alias("email"))),
        committed_by=_edge(graph, "committed_by", commits.where("committer_email <> author_email").select("hash", F.col("committer_email").alias("email"))),
        parent_of=_edge(graph, "parent_of", edges),
        modifies=_edge(graph, "modifies", modifies),
        has_commit=_edge(graph, "has_commit", commits.select("repo_name", "hash").join(owners, "repo_name", "left_semi")),
    )


# --- source code


def flatten_files(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nested file records (with repo_name and pos) -> files, classes, functions (methods too), imports. ``k`` orders what stands in one file."""
    files = records.select("repo_name", "pos", "path", "language", "size")
    classes = records.select("repo_name", "pos", F.posexplode("classes").alias("k", "c")).select("repo_name", "pos", "k", "c.*")
    methods = classes.select("repo_name", "pos", F.col("k").alias("k0"), F.posexplode("methods").alias("k", "f")).select("repo_name", "pos", F.struct(F.lit(0).alias("a"), F.col("k0").alias("b"), F.col("k").alias("c")).alias("k"), "f.*")
    plain = records.select("repo_name", "pos", F.posexplode("functions").alias("k", "f")).select("repo_name", "pos", F.struct(F.lit(1).alias("a"), F.lit(0).alias("b"), F.col("k").alias("c")).alias("k"), "f.*")
    imports = records.select("repo_name", "pos", F.col("path").alias("source"), F.posexplode("imports").alias("k", "i")).select("repo_name", "pos", "k", "source", F.col("i.module_path").alias("target"), F.col("i.imported_name").alias("imported_name"), F.col("i.alias").alias("alias"))
    return files, classes.drop("methods"), methods.unionByName(plain), imports


def directories(paths: DataFrame) -> DataFrame:
    """All directories above the files of ``paths`` (repo_name, path), with their parent (null at the top)."""
    chain = paths.select("repo_name", F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    return chain.withColumn("parent", dirname(F.col("path")))


def resolve(edges: DataFrame, names: DataFrame) -> DataFrame:
    """``edges`` (repo_name, source, name) joined to every symbol of that short name in the same repository (``names``: repo_name, name, target). Repeated edges go before the join, so a common name doesn't multiply them."""
    return edges.distinct().join(names, ["repo_name", "name"]).select("repo_name", "source", "target")


def ingest_files(graph: Graph, files: DataFrame, classes: DataFrame, functions: DataFrame, imports: DataFrame) -> Graph:
    """Frames as ``flatten_files`` makes them."""
    now = F.current_timestamp()
    own = last_wins(files.select("repo_name", "path", "language", "size", "pos"), ["path", "repo_name"], ["pos"]).drop("pos")
    merged = upsert(graph["file"], own.withColumn("updated_at", now), ["path", "repo_name"])
    linked = last_wins(imports.where("target IS NOT NULL AND target <> ''").select("repo_name", "source", "target", "imported_name", "alias", "pos", "k"), ["repo_name", "source", "target"], ["pos", "k"]).drop("pos", "k")
    merged = insert_missing(merged, linked.select(F.col("target").alias("path"), "repo_name").withColumn("updated_at", now), ["path", "repo_name"])
    dirs = directories(own.select("repo_name", "path"))
    inside = own.select("repo_name", dirname(F.col("path")).alias("directory"), "path").where("directory IS NOT NULL AND directory <> ''")
    class_nodes = last_wins(classes.select("repo_name", "qualified_name", "name", "file_path", "start_line", "end_line", "bases", "pos", "k"), ["qualified_name", "repo_name"], ["pos", "k"]).drop("pos", "k")
    class_merged = _merge(graph, "class", class_nodes.withColumn("updated_at", now))
    fields = ["name", "file_path", "start_line", "end_line", "parameters", "return_type", "is_method", "class_name", "calls"]
    nodes = last_wins(functions.select("repo_name", "qualified_name", *fields, "pos", "k"), ["qualified_name", "repo_name"], ["pos", "k"]).drop("pos", "k")
    function_merged = _merge(graph, "function", nodes.withColumn("updated_at", now))
    class_names = class_merged.select("repo_name", "name", F.col("qualified_name").alias("target"))
    bases = classes.select("repo_name", F.col("qualified_name").alias("source"), F.explode("bases").alias("name")).where("name <> ''")
    calls = functions.select("repo_name", F.col("qualified_name").alias("source"), F.explode("calls").alias("name"))
    methods = functions.where("is_method AND class_name IS NOT NULL AND class_name <> ''").select("repo_name", F.col("qualified_name").alias("source"), F.col("class_name").alias("name"))
    return graph.with_tables(
        file=schema.conform(merged, "file"),
        directory=_merge(graph, "directory", dirs.select("repo_name", "path").withColumn("updated_at", now)),
        child_of=_edge(graph, "child_of", dirs.where("parent IS NOT NULL").select("repo_name", "parent", F.col("path").alias("child"))),
        contains_file=_edge(graph, "contains_file", inside),
        contains_class=_edge(graph, "contains_class", classes.select("repo_name", F.col("file_path").alias("path"), "qualified_name")),
        inherits=_edge(graph, "inherits", resolve(bases, class_names).select("repo_name", F.col("source").alias("child"), F.col("target").alias("parent"))),
        contains_function=_edge(graph, "contains_function", functions.select("repo_name", F.col("file_path").alias("path"), "qualified_name")),
        has_method=_edge(graph, "has_method", resolve(methods, class_names).select("repo_name", F.col("target").alias("class"), F.col("source").alias("function"))),
        calls=_edge(graph, "calls", resolve(calls, function_merged.select("repo_name", "name", F.col("qualified_name").alias("target"))).select("repo_name", F.col("source").alias("caller"), F.col("target").alias("callee"))),
        imports=_edge(graph, "imports", linked),
        **{"class": class_merged, "function": function_merged},
    )


# --- merge requests


def merge_approvals(approved: DataFrame, eligible: DataFrame) -> DataFrame:
    """One row for each username of both lists (username, name, email, created_at): approved if the first list has it, with that list's fields."""
    rows = approved.withColumn("approved", F.lit(True)).unionByName(eligible.withColumn("approved", F.lit(False)))
    return last_wins(rows.where("username IS NOT NULL"), ["username"], ["approved", "created_at", "name", "email"])


def ingest_merge_requests(graph: Graph, mrs: DataFrame, commits: DataFrame, reviews: DataFrame, notes: DataFrame | None = None) -> Graph:
    """``mrs``: the node columns and pos; ``commits``: iid, repo_name, hash; ``reviews``: iid, repo_name, username, name, email, approved, created_at, pos; ``notes``: the columns of mr_note."""
    now = F.current_timestamp()
    if notes is not None:
        mrs = mrs.drop("notes_count").join(notes.groupBy("iid", "repo_name").agg(F.count("*").alias("notes_count")), ["iid", "repo_name"], "left").fillna({"notes_count": 0})
    table = [c for c in schema.columns("merge_request") if c in mrs.columns]
    nodes = last_wins(mrs.withColumn("state", mr_state(F.col("state"))).select(*table, "pos"), ["iid", "repo_name"], ["pos"]).drop("pos")
    merged = _merge(graph, "merge_request", nodes.withColumn("updated_at_sync", now))
    writers = mrs.where("author_username IS NOT NULL").select(F.col("author_username").alias("username"), F.col("author_name").alias("name"), F.lit(None).cast("string").alias("email"), "repo_name", F.lit(0).alias("role"), "pos")
    readers = reviews.where("username IS NOT NULL").select("username", "name", "email", "repo_name", F.lit(1).alias("role"), "pos")
    # reviewers are written after authors and alone carry an e-mail
    users = last_wins(writers.unionByName(readers).select("username", "name", "repo_name", "role", "pos"), ["username"], ["repo_name", "role", "pos", "name"]).select("username", "name")
    mails = last_wins(readers.select("username", "email", "repo_name", "pos"), ["username"], ["repo_name", "pos", "email"]).select("username", "email")
    users = _merge(graph, "user", users.join(mails, "username", "left").withColumn("updated_at", now))
    branches = graph["branch"].select("repo_name", F.col("name").alias("branch"))
    key = ["iid", "repo_name"]
    seen = last_wins(reviews.where("username IS NOT NULL").select(*key, "username", "approved", "created_at", "pos"), [*key, "username"], ["pos", "created_at", "approved"])
    tables = {
        "merge_request": merged,
        "user": users,
        "created_by": _edge(graph, "created_by", nodes.where("author_username IS NOT NULL").select(*key, F.lit("User").alias("dst_label"), F.col("author_username").alias("dst_key"))),
        "sources": _edge(graph, "sources", nodes.select(*key, F.col("source_branch").alias("branch")).join(branches, ["repo_name", "branch"], "left_semi")),
        "targets": _edge(graph, "targets", nodes.select(*key, F.col("target_branch").alias("branch")).join(branches, ["repo_name", "branch"], "left_semi")),
        "contains_commit": _edge(graph, "contains_commit", commits.select(*key, "hash").join(graph["commit"].select("hash"), "hash", "left_semi")),
        "reviewed_by": _edge(graph, "reviewed_by", seen.select(*key, F.lit("User").alias("dst_label"), F.col("username").alias("dst_key"), "approved", "created_at")),
        "has_merge_request": _edge(graph, "has_merge_request", nodes.select("repo_name", "iid").join(graph["repository"].select(F.col("name").alias("repo_name")), "repo_name", "left_semi")),
    }
    if notes is not None:
        tables["mr_note"] = _edge(graph, "mr_note", last_wins(notes, ["iid", "repo_name", "pos"], ["created_at", "body"]))
    return graph.with_tables(**tables)


def link_identities(graph: Graph) -> Graph:
    """Users and authors with one e-mail are one person: authors get the user name, and CREATED_BY and REVIEWED_BY edges to users are repeated to authors."""
    same = graph["user"].where("email IS NOT NULL AND email <> ''").groupBy("email").agg(F.max("username").alias("username")).join(graph["author"].select("email"), "email")
    author = graph["author"].drop("gitlab_username").join(same.select("email", F.col("username").alias("gitlab_username")), "email", "left")
    tables = {"author": schema.conform(author, "author")}
    for name in ("created_by", "reviewed_by"):
        e = graph[name]
        more = e.where("dst_label = 'User'").join(same.select(F.col("username").alias("dst_key"), "email"), "dst_key").withColumn("dst_label", F.lit("Author")).withColumn("dst_key", F.col("email"))
        tables[name] = _edge(graph, name, more)
    return graph.with_tables(**tables)


def positions(df: DataFrame, partition: str, *order) -> DataFrame:
    """``df`` with ``pos``: the place of each row in its repository's load."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(partition).orderBy(*order)) - 1)
