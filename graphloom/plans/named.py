"""The named queries as DataFrame builders.

Each takes a graph and optional filters. With all filters of its classic form given, a
query answers for one subject; without them it answers for every subject at once, which
is how whole-table reports run. Nothing is collected here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.columns import contains_ignoring_case, in_directory, module_root
from graphloom.graph import Graph
from graphloom.operators.closure import closure
from graphloom.storage import materialize

HOT_SET = 50


def _where(df: DataFrame, **equal) -> DataFrame:
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def _top(df: DataFrame, by: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group; Spark cuts each partition to as many before the shuffle."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rank") <= limit).drop("__rank")


def _mr_modifies(g: Graph, mr_iid, repo_name) -> DataFrame:
    """MODIFIES edges of the commits that merge requests contain: mr_repo, iid, hash, repo_name, path, ..."""
    mrs = _where(g["merge_request"].select("iid", "repo_name"), iid=mr_iid, repo_name=repo_name)
    held = g["contains_commit"].join(mrs, ["iid", "repo_name"], "left_semi").select("iid", F.col("repo_name").alias("mr_repo"), "hash")
    if mr_iid is not None:  # written, so that Spark knows how few they are and sends them to the edges instead of shuffling those
        held = materialize(held, "mr-commits")
    return held.join(g["modifies"], "hash")


def files_changed_in_mr(g: Graph, mr_iid: int | None = None, repo_name: str | None = None) -> DataFrame:
    """Files that a merge request's commits touch, with their summed changes."""
    # aggregate on the edges; the file's language joins the small result
    rolled = (
        _mr_modifies(g, mr_iid, repo_name)
        .groupBy("mr_repo", "iid", "repo_name", "path")
        .agg(
            F.sum(F.coalesce("additions", F.lit(0))).cast("bigint").alias("additions"),
            F.sum(F.coalesce("deletions", F.lit(0))).cast("bigint").alias("deletions"),
            F.sort_array(F.collect_set("status")).alias("statuses"),
            F.sort_array(F.collect_set("hash")).alias("commit_hashes"),
        )
        .withColumn("commit_touch_count", F.size("commit_hashes").cast("bigint"))
    )
    out = rolled.join(g["file"].select("repo_name", "path", "language"), ["repo_name", "path"])
    return out.select("mr_repo", "iid", "repo_name", "path", "language", "additions", "deletions", "statuses", "commit_hashes", "commit_touch_count")


def commit_history(g: Graph, file_path: str | None = None, repo_name: str | None = None, limit: int = 50) -> DataFrame:
    """The last ``limit`` commits of each file, newest first."""
    edges = _where(g["modifies"], path=file_path, repo_name=repo_name).withColumnRenamed("repo_name", "file_repo")
    commits = g["commit"].select("hash", "short_hash", "message", "timestamp", F.col("repo_name").alias("repo_name"))
    newest = _top(edges.join(commits, "hash"), ["file_repo", "path"], [F.desc_nulls_first("timestamp"), F.asc("hash")], limit)
    people = g["authored_by"].join(g["author"].select("email", "name", "gitlab_username"), "email")
    out = newest.join(people, "hash", "left")
    return out.select(
        F.col("file_repo"), "path", "hash", "short_hash", "message", "timestamp", "repo_name", F.coalesce("additions", F.lit(0)).alias("additions"), F.coalesce("deletions", F.lit(0)).alias("deletions"), "status",
        F.col("name").alias("author_name"), F.col("email").alias("author_email"), F.col("gitlab_username").alias("author_gitlab_username"),
    )


def function_callers(g: Graph, function_name: str | None = None, repo_name: str | None = None) -> DataFrame:
    """Functions that call a function of the name, in the same repository."""
    f = g["function"].select("repo_name", "name", "qualified_name", "file_path")
    callee = _where(f, name=function_name, repo_name=repo_name).select("repo_name", F.col("name").alias("callee_name"), F.col("qualified_name").alias("callee_qualified_name"), F.col("file_path").alias("callee_file_path"))
    caller = _where(f, repo_name=repo_name).select("repo_name", F.col("name").alias("caller_name"), F.col("qualified_name").alias("caller_qualified_name"), F.col("file_path").alias("caller_file_path"))
    calls = g["calls"].select("repo_name", F.col("caller").alias("caller_qualified_name"), F.col("callee").alias("callee_qualified_name"))
    out = calls.join(callee, ["repo_name", "callee_qualified_name"]).join(caller, ["repo_name", "caller_qualified_name"])
    return out.select("repo_name", "caller_name", "caller_qualified_name", "caller_file_path", "callee_name", "callee_qualified_name", "callee_file_path").distinct()


def class_hierarchy(g: Graph, class_name: str | None = None, repo_name: str | None = None) -> DataFrame:
    """Each class of the name itself, its ancestors and its descendants, by any number of steps."""
    classes = g["class"].select("repo_name", "qualified_name", "name", "file_path")
    selves = _where(classes, name=class_name, repo_name=repo_name).select("repo_name", F.col("qualified_name").alias("src"))
    up = g["inherits"].select("repo_name", F.col("child").alias("src"), F.col("parent").alias("dst"))
    if class_name is None:  # every class: the descendants are the same pairs read backwards
        above = closure(up)
        below = above.select("repo_name", F.col("dst").alias("src"), F.col("src").alias("dst"))
    else:
        above = closure(up, selves)
        below = closure(up.select("repo_name", F.col("dst").alias("src"), F.col("src").alias("dst")), selves)
    rows = selves.select(F.lit("self").alias("role"), "repo_name", "src", F.col("src").alias("dst"))
    for role, pairs in (("ancestor", above), ("descendant", below)):
        rows = rows.unionByName(pairs.join(selves, ["repo_name", "src"], "left_semi").select(F.lit(role).alias("role"), "repo_name", "src", "dst"))
    target = classes.withColumnRenamed("qualified_name", "dst")
    return rows.join(target, ["repo_name", "dst"]).select(F.col("src").alias("of"), "role", "name", F.col("dst").alias("qualified_name"), "file_path", "repo_name")


def file_dependencies(g: Graph, file_path: str | None = None, repo_name: str | None = None) -> DataFrame:
    """What each file imports and which files import it, both sorted."""
    files = _where(g["file"].select("repo_name", "path"), path=file_path, repo_name=repo_name)
    edges = _where(g["imports"], repo_name=repo_name)
    out = _where(edges, source=file_path).groupBy("repo_name", F.col("source").alias("path")).agg(F.sort_array(F.collect_set("target")).alias("imports"))
    back = _where(edges, target=file_path).groupBy("repo_name", F.col("target").alias("path")).agg(F.sort_array(F.collect_set("source")).alias("imported_by"))
    none = F.array().cast("array<string>")
    return files.join(out, ["repo_name", "path"], "left").join(back, ["repo_name", "path"], "left").select("repo_name", "path", F.coalesce("imports", none).alias("imports"), F.coalesce("imported_by", none).alias("imported_by"))


def author_contributions(g: Graph, author_email: str | None = None, repo_name: str | None = None) -> DataFrame:
    """Files, commits and merge requests of each author in each repository where they have any.

    Merge requests count through edges to Author; after plain ingestion CREATED_BY points to
    users, so ``link_identities`` must have run for them to show.
    """
    own = _where(g["authored_by"], email=author_email).join(_where(g["commit"].select("hash", "repo_name"), repo_name=repo_name), "hash")
    commits = own.groupBy("email", "repo_name").agg(F.sort_array(F.collect_set("hash")).alias("commit_hashes"))
    # separate aggregates: commits times files never meet
    files = own.join(g["modifies"].select("hash", "repo_name", "path"), ["hash", "repo_name"]).groupBy("email", "repo_name").agg(F.sort_array(F.collect_set("path")).alias("files_modified"))
    mrs = _where(g["created_by"].where("dst_label = 'Author'").withColumnRenamed("dst_key", "email"), email=author_email, repo_name=repo_name).groupBy("email", "repo_name").agg(F.sort_array(F.collect_set("iid")).alias("merge_request_iids"))
    keys = ["email", "repo_name"]
    text, number = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    out = commits.join(files, keys, "left").join(mrs, keys, "full_outer")
    return out.select(
        F.col("email").alias("author_email"), "repo_name", F.coalesce("files_modified", text).alias("files_modified"), F.coalesce(F.size("commit_hashes"), F.lit(0)).cast("bigint").alias("commit_count"), F.coalesce("commit_hashes", text).alias("commit_hashes"),
        F.coalesce(F.size("merge_request_iids"), F.lit(0)).cast("bigint").alias("merge_request_count"), F.coalesce("merge_request_iids", number).alias("merge_request_iids"),
    )


def _churn(g: Graph, repo_name: str | None) -> DataFrame:
    """Modifications of each file by commits of its own repository."""
    commits = _where(g["commit"].select("hash", "repo_name"), repo_name=repo_name)
    return _where(g["modifies"].select("hash", "repo_name", "path"), repo_name=repo_name).join(commits, ["hash", "repo_name"], "left_semi").groupBy("repo_name", "path").agg(F.count("*").alias("modification_count"))


def hot_files(g: Graph, repo_name: str | None = None, limit: int = 20) -> DataFrame:
    """The most often modified files of each repository; ties go to the lower path."""
    top = _top(_churn(g, repo_name), ["repo_name"], [F.desc("modification_count"), F.asc("path")], limit)
    return top.join(g["file"].select("repo_name", "path", "language"), ["repo_name", "path"]).select("repo_name", "path", "language", "modification_count")


def mr_risk_score(g: Graph, mr_iid: int | None = None, repo_name: str | None = None) -> DataFrame:
    """Risk of each merge request: files, twice the hot files among them, and five if it crosses modules."""
    hot = _top(_churn(g, repo_name), ["repo_name"], [F.desc("modification_count"), F.asc("path")], HOT_SET).select(F.col("repo_name").alias("mr_repo"), "path", F.lit(True).alias("hot"))
    paths = _mr_modifies(g, mr_iid, repo_name).select("mr_repo", "iid", "path").distinct()
    marked = paths.join(hot, ["mr_repo", "path"], "left")
    rolled = marked.groupBy("mr_repo", "iid").agg(
        F.count("path").alias("file_count"), F.sort_array(F.collect_set(F.when(F.col("hot"), F.col("path")))).alias("hot_file_paths"), F.sort_array(F.collect_set(module_root(F.col("path")))).alias("module_roots")
    )
    mrs = _where(g["merge_request"].select("iid", F.col("repo_name").alias("mr_repo")), iid=mr_iid, mr_repo=repo_name)
    none = F.array().cast("array<string>")
    out = mrs.join(rolled, ["mr_repo", "iid"], "left").select("mr_repo", "iid", F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("hot_file_paths", none).alias("hot_file_paths"), F.coalesce("module_roots", none).alias("module_roots"))
    out = out.withColumn("hot_files_touched", F.size("hot_file_paths").cast("bigint")).withColumn("distinct_module_count", F.size("module_roots").cast("bigint")).withColumn("cross_module", F.size("module_roots") > 1)
    score = F.col("file_count") + 2.0 * F.col("hot_files_touched") + F.when(F.col("cross_module"), 5.0).otherwise(0.0)
    return out.select(F.col("mr_repo").alias("repo_name"), "iid", "file_count", "hot_files_touched", "hot_file_paths", "module_roots", "distinct_module_count", "cross_module", F.round(score, 2).alias("risk_score"))


def recent_changes(g: Graph, repo_name: str | None = None, days: int = 7, limit: int = 50, as_of=None) -> DataFrame:
    """The newest commits of the last ``days`` before ``as_of`` (now by default) in each repository, with their files."""
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    commits = _where(g["commit"], repo_name=repo_name).where(F.col("timestamp") >= now - F.make_dt_interval(F.lit(days)))
    top = _top(commits.select("hash", "short_hash", "message", "timestamp", "repo_name"), ["repo_name"], [F.desc_nulls_first("timestamp"), F.asc("hash")], limit)
    top = materialize(top, "recent-commits")  # found once, and known to be few when the edges are joined
    # limit first: the files of no other commit are gathered
    files = g["modifies"].select("hash", "path").join(top.select("hash"), "hash", "left_semi").groupBy("hash").agg(F.sort_array(F.collect_set("path")).alias("files"))
    return top.join(files, "hash", "left").select("hash", "short_hash", "message", "timestamp", "repo_name", F.coalesce("files", F.array().cast("array<string>")).alias("files"))


def _symbols(g: Graph, table: str, repo_name, directory) -> DataFrame:
    return _where(g[table], repo_name=repo_name).where(in_directory(F.col("file_path"), directory))


def code_structure_classes(g: Graph, repo_name: str | None = None, directory: str | None = None) -> DataFrame:
    return _symbols(g, "class", repo_name, directory).select("repo_name", "name", "qualified_name", "file_path", "start_line", "end_line")


def code_structure_functions(g: Graph, repo_name: str | None = None, directory: str | None = None) -> DataFrame:
    return _symbols(g, "function", repo_name, directory).select("repo_name", "name", "qualified_name", "file_path", "start_line", "end_line")


def _inside(g: Graph, edges: str, ends: list[str], table: str, repo_name, directory) -> DataFrame:
    """Edges with all ``ends`` in scope."""
    out = _where(g[edges], repo_name=repo_name)
    for end in ends:
        out = out.join(_symbols(g, table, repo_name, directory).select("repo_name", F.col("qualified_name").alias(end)), ["repo_name", end], "left_semi")
    return out


def code_structure_inherits(g: Graph, repo_name: str | None = None, directory: str | None = None) -> DataFrame:
    return _inside(g, "inherits", ["child", "parent"], "class", repo_name, directory).select("repo_name", "child", "parent").distinct()


def code_structure_calls(g: Graph, repo_name: str | None = None, directory: str | None = None) -> DataFrame:
    return _inside(g, "calls", ["caller", "callee"], "function", repo_name, directory).select("repo_name", "caller", "callee").distinct()


def code_structure_imports(g: Graph, repo_name: str | None = None, directory: str | None = None) -> DataFrame:
    """Imports of the files in scope; only the importing file must be in it."""
    return _where(g["imports"], repo_name=repo_name).where(in_directory(F.col("source"), directory)).select("repo_name", F.col("source").alias("from_path"), F.col("target").alias("to_path")).distinct()


def _reorder(columns: list[str]):
    return lambda x: F.struct(*[x[k].alias(k) for k in columns])


def code_structure(g: Graph, repo_name: str, directory: str | None = None) -> DataFrame:
    """One row with the five sorted lists."""
    out = None
    for name, part, keys in (
        ("classes", code_structure_classes, ["qualified_name"]),
        ("functions", code_structure_functions, ["qualified_name"]),
        ("inherits", code_structure_inherits, ["child", "parent"]),
        ("calls", code_structure_calls, ["caller", "callee"]),
        ("imports", code_structure_imports, ["from_path", "to_path"]),
    ):
        rows = part(g, repo_name, directory).drop("repo_name")
        order = [*keys, *[c for c in rows.columns if c not in keys]]
        one = rows.agg(F.transform(F.sort_array(F.collect_list(F.struct(*order))), _reorder(rows.columns)).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def mr_commits(g: Graph, mr_iid: int | None = None, repo_name: str | None = None) -> DataFrame:
    mrs = _where(g["merge_request"].select("iid", "repo_name"), iid=mr_iid, repo_name=repo_name)
    commits = g["commit"].select("hash", "short_hash", "message", "timestamp", F.col("repo_name").alias("commit_repo"))
    return g["contains_commit"].join(mrs, ["iid", "repo_name"], "left_semi").join(commits, "hash").select("repo_name", "iid", "hash", "short_hash", "message", "timestamp", "commit_repo")


def mr_files(g: Graph, mr_iid: int | None = None, repo_name: str | None = None) -> DataFrame:
    return _mr_modifies(g, mr_iid, repo_name).select(F.col("mr_repo").alias("repo_name"), "iid", "path").distinct()


def mr_reviewers(g: Graph, mr_iid: int | None = None, repo_name: str | None = None) -> DataFrame:
    """Reviewers that are authors, one row for each e-mail and user name; approved if any of their reviews is."""
    edges = _where(g["reviewed_by"].where("dst_label = 'Author'"), iid=mr_iid, repo_name=repo_name).withColumnRenamed("dst_key", "email")
    people = edges.join(g["author"].select("email", "name", "gitlab_username"), "email").where("coalesce(email, '') <> '' OR coalesce(gitlab_username, '') <> '' OR coalesce(name, '') <> ''")
    return people.groupBy("repo_name", "iid", "email", "gitlab_username").agg(F.min("name").alias("name"), F.bool_or(F.coalesce("approved", F.lit(False))).alias("approved")).select("repo_name", "iid", "name", "email", "gitlab_username", "approved")


def mr_header(g: Graph, mr_iid: int | None = None, repo_name: str | None = None) -> DataFrame:
    return _where(g["merge_request"], iid=mr_iid, repo_name=repo_name).withColumn("notes_count", F.coalesce("notes_count", F.lit(0)))


def mr_summary(g: Graph, mr_iid: int | None = None, repo_name: str | None = None) -> DataFrame:
    """One row for each merge request: its properties, commits by hash, files, reviewers, and the number of notes."""
    key = ["repo_name", "iid"]
    header = mr_header(g, mr_iid, repo_name)
    head = header.select(*key, F.struct(*header.columns).alias("merge_request"), "notes_count")
    commits = mr_commits(g, mr_iid, repo_name).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("hash", "short_hash", "message", "timestamp", F.col("commit_repo").alias("repo_name")))).alias("commits"))
    files = mr_files(g, mr_iid, repo_name).groupBy(*key).agg(F.sort_array(F.collect_set("path")).alias("files"))
    order = F.coalesce(F.nullif("email", F.lit("")), F.nullif("gitlab_username", F.lit("")), "name", F.lit("")).alias("k")
    people = mr_reviewers(g, mr_iid, repo_name).groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, F.struct("name", "email", "gitlab_username", "approved").alias("r")))), lambda x: x["r"]).alias("reviewers"))
    out = head.join(commits, key, "left").join(files, key, "left").join(people, key, "left")
    kinds = dict(out.dtypes)
    return out.select(*key, "merge_request", *[F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in ("commits", "files", "reviewers")], "notes_count")


def _search(g: Graph, table: str, pattern: str, repo_name: str | None) -> DataFrame:
    return _where(g[table], repo_name=repo_name).where(contains_ignoring_case(F.col("name"), pattern)).select("repo_name", "name", "qualified_name", "file_path", "start_line", "end_line")


def search_functions(g: Graph, pattern: str, repo_name: str | None = None) -> DataFrame:
    return _search(g, "function", pattern, repo_name)


def search_classes(g: Graph, pattern: str, repo_name: str | None = None) -> DataFrame:
    return _search(g, "class", pattern, repo_name)
