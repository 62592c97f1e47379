"""Queries over the demo graph and, for each, the SQL that DuckDB answers from the raw tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.graph import Graph, load, save
from graphloom.operators import ingest, upsert
from graphloom.storage import new_path

from . import demo, named, recipes, samples

AS_OF = "1998-06-01 00:00:00"


def _flat(df: DataFrame) -> DataFrame:
    """Lists as comma-joined strings and times as text, so that results compare across engines."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("array<"):
            c = F.array_join(c.cast("array<string>"), ",")
        elif kind.startswith("timestamp"):
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def _graph(build: Callable, *args, **kwargs) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _flat(build(demo.graph(spark, sf_dir), *args, **kwargs))


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """A stored table without its bookkeeping columns."""
    return lambda spark, sf_dir: _flat(demo.graph(spark, sf_dir)[name].drop("updated_at_sync", *([] if name == "merge_request" else ["updated_at"])))


def _linked(build: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _flat(build(ingest.link_identities(demo.graph(spark, sf_dir))))


def _cte() -> str:
    """The raw derivation and every graph table as common table expressions."""
    names = [*demo.TABLES, *demo.SOURCES]
    parts = []
    for name, text in demo.SOURCES.items():
        for other in names:
            text = text.replace("{" + other + "}", other if other in demo.TABLES else f"s_{other}")
        parts.append(f"s_{name} AS ({text})")
    last = lambda key, order, source: f"SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"
    more = {
        "commit_": "SELECT hash, substr(hash, 1, 8) AS short_hash, message, ts, branch, repo_name FROM s_commits",
        "people": """SELECT author_email AS email, author_name AS name, repo_name, pos // 500 AS b, 0 AS role, pos FROM s_commits
            UNION ALL SELECT committer_email, committer_name, repo_name, pos // 500, 1, pos FROM s_commits""",
        "author": f"SELECT email, name FROM ({last('email', 'repo_name DESC, b DESC, role DESC, pos DESC', 'people')})",
        "modifies": f"SELECT hash, repo_name, path, status, additions, deletions FROM ({last('hash, repo_name, path', 'l_linenumber DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_shipdate DESC, status DESC', 's_changes')})",
        "imports_": f"SELECT repo_name, source, target, imported_name, alias FROM ({last('repo_name, source, target', 'pos DESC, k DESC', 's_imports')})",
        "file": """SELECT repo_name, path, max(language) AS language, max(size) AS size FROM (SELECT repo_name, path, language, size FROM s_files
            UNION ALL SELECT repo_name, path, NULL, NULL FROM modifies UNION ALL SELECT repo_name, target, NULL, NULL FROM imports_) GROUP BY repo_name, path""",
        "class_": "SELECT * FROM s_classes",
        "function_": last("qualified_name, repo_name", "pos DESC", "s_functions"),
        "inherits": "SELECT DISTINCT c.repo_name, c.qualified_name AS child, b.qualified_name AS parent FROM s_classes c JOIN s_classes b ON b.name = c.base AND b.repo_name = c.repo_name",
        "called": "SELECT repo_name, qualified_name, call_a AS name FROM s_functions WHERE call_a IS NOT NULL UNION SELECT repo_name, qualified_name, call_b FROM s_functions WHERE call_b IS NOT NULL",
        "calls": "SELECT DISTINCT c.repo_name, c.qualified_name AS caller, f.qualified_name AS callee FROM called c JOIN function_ f ON f.name = c.name AND f.repo_name = c.repo_name",
        "mr_mod": "SELECT m.repo_name AS mr_repo, m.iid, x.* FROM s_mr_commits m JOIN modifies x ON x.hash = m.hash",
        "churn": "SELECT repo_name, path, count(*) AS modification_count FROM modifies GROUP BY repo_name, path",
    }
    return "WITH RECURSIVE " + ",\n".join([*parts, *[f"{k} AS ({v})" for k, v in more.items()]]) + "\n"


CTE = _cte()
_AGG = "coalesce(string_agg({0}, ',' ORDER BY {0}), '')"
_MRS_FILES = """SELECT mr_repo, iid, m.repo_name, m.path, f.language, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions,
  (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT unnest(list(status)) AS s)) AS statuses, string_agg(DISTINCT hash, ',' ORDER BY hash) AS commit_hashes, count(DISTINCT hash) AS commit_touch_count
  FROM mr_mod m JOIN file f ON f.path = m.path AND f.repo_name = m.repo_name GROUP BY ALL"""
_MRS_FILES = _MRS_FILES.replace("(SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT unnest(list(status)) AS s))", "string_agg(DISTINCT status, ',' ORDER BY status)")
_CLOSURE = """, reach AS (SELECT repo_name, child AS a, parent AS b FROM inherits UNION SELECT r.repo_name, r.a, i.parent FROM reach r JOIN inherits i ON i.child = r.b AND i.repo_name = r.repo_name)
"""

#: name -> (query, SQL after the common table expressions; None where SQL has no counterpart)
_ENTRIES: dict[str, tuple[Callable, str | None]] = {
    "hot_files": (
        _graph(named.hot_files),
        "SELECT c.repo_name, c.path, f.language, modification_count FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY modification_count DESC, path) AS r FROM churn) c JOIN file f ON f.path = c.path AND f.repo_name = c.repo_name WHERE r <= 20",
    ),
    "files_changed_all_mrs": (_graph(named.files_changed_in_mr), _MRS_FILES),
    "commit_history": (
        _graph(named.commit_history),
        """SELECT m.repo_name AS file_repo, m.path, c.hash, c.short_hash, c.message, CAST(c.ts AS VARCHAR) AS timestamp, c.repo_name, additions, deletions, status, a.name AS author_name, a.email AS author_email, CAST(NULL AS VARCHAR) AS author_gitlab_username
        FROM (SELECT m.*, row_number() OVER (PARTITION BY m.repo_name, path ORDER BY ts DESC, m.hash) AS r FROM modifies m JOIN commit_ USING (hash)) m JOIN commit_ c ON c.hash = m.hash JOIN s_commits s ON s.hash = c.hash JOIN author a ON a.email = s.author_email WHERE r <= 50""",
    ),
    "function_callers": (
        _graph(named.function_callers),
        """SELECT DISTINCT k.repo_name, a.name AS caller_name, a.qualified_name AS caller_qualified_name, a.file_path AS caller_file_path, b.name AS callee_name, b.qualified_name AS callee_qualified_name, b.file_path AS callee_file_path
        FROM calls k JOIN function_ a ON a.qualified_name = k.caller AND a.repo_name = k.repo_name JOIN function_ b ON b.qualified_name = k.callee AND b.repo_name = k.repo_name""",
    ),
    "class_hierarchy": (
        _graph(named.class_hierarchy),
        _CLOSURE
        + """SELECT x.a AS "of", x.role, c.name, c.qualified_name, c.file_path, c.repo_name FROM (SELECT 'self' AS role, repo_name, qualified_name AS a, qualified_name AS b FROM class_
        UNION ALL SELECT 'ancestor', repo_name, a, b FROM reach UNION ALL SELECT 'descendant', repo_name, b, a FROM reach) x JOIN class_ c ON c.qualified_name = x.b AND c.repo_name = x.repo_name""",
    ),
    "file_dependencies": (
        _graph(named.file_dependencies),
        f"""SELECT f.repo_name, f.path, coalesce(o.l, '') AS imports, coalesce(i.l, '') AS imported_by FROM file f
        LEFT JOIN (SELECT repo_name, source AS path, {_AGG.format("target")} AS l FROM imports_ GROUP BY 1, 2) o ON o.path = f.path AND o.repo_name = f.repo_name
        LEFT JOIN (SELECT repo_name, target AS path, {_AGG.format("source")} AS l FROM imports_ GROUP BY 1, 2) i ON i.path = f.path AND i.repo_name = f.repo_name""",
    ),
    "author_contributions": (
        _graph(named.author_contributions),
        f"""SELECT c.author_email, c.repo_name, coalesce(f.l, '') AS files_modified, n AS commit_count, h AS commit_hashes, CAST(0 AS BIGINT) AS merge_request_count, '' AS merge_request_iids
        FROM (SELECT author_email, repo_name, count(*) AS n, {_AGG.format("hash")} AS h FROM s_commits GROUP BY 1, 2) c
        LEFT JOIN (SELECT author_email, c.repo_name, string_agg(DISTINCT path, ',' ORDER BY path) AS l FROM s_commits c JOIN modifies m ON m.hash = c.hash GROUP BY 1, 2) f ON f.author_email = c.author_email AND f.repo_name = c.repo_name""",
    ),
    "mr_risk_all": (
        _graph(named.mr_risk_score),
        """, hot AS (SELECT repo_name, path FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY modification_count DESC, path) AS r FROM churn) WHERE r <= 50),
        p AS (SELECT DISTINCT m.mr_repo, m.iid, m.path, h.path IS NOT NULL AS is_hot FROM mr_mod m LEFT JOIN hot h ON h.repo_name = m.mr_repo AND h.path = m.path),
        t AS (SELECT mr_repo, iid, count(*) AS file_count, count(*) FILTER (is_hot) AS hot_files_touched, coalesce(string_agg(path, ',' ORDER BY path) FILTER (is_hot), '') AS hot_file_paths,
          string_agg(DISTINCT split_part(path, '/', 1), ',' ORDER BY split_part(path, '/', 1)) AS module_roots, count(DISTINCT split_part(path, '/', 1)) AS n FROM p GROUP BY 1, 2)
        SELECT m.repo_name, m.iid, coalesce(file_count, 0) AS file_count, coalesce(hot_files_touched, 0) AS hot_files_touched, coalesce(hot_file_paths, '') AS hot_file_paths, coalesce(module_roots, '') AS module_roots, coalesce(n, 0) AS distinct_module_count,
          coalesce(n, 0) > 1 AS cross_module, round(CAST(coalesce(file_count, 0) + 2 * coalesce(hot_files_touched, 0) + CASE WHEN coalesce(n, 0) > 1 THEN 5 ELSE 0 END AS DOUBLE), 2) AS risk_score
        FROM s_mrs m LEFT JOIN t ON t.mr_repo = m.repo_name AND t.iid = m.iid""",
    ),
    "recent_changes": (
        _graph(named.recent_changes, days=30, limit=50, as_of=AS_OF),
        f"""SELECT c.hash, substr(c.hash, 1, 8) AS short_hash, message, CAST(ts AS VARCHAR) AS timestamp, c.repo_name, coalesce(l, '') AS files
        FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY ts DESC, hash) AS r FROM s_commits WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY) c
        LEFT JOIN (SELECT hash, string_agg(DISTINCT path, ',' ORDER BY path) AS l FROM modifies GROUP BY 1) m ON m.hash = c.hash WHERE r <= 50""",
    ),
    "code_structure_classes": (_graph(named.code_structure_classes), "SELECT repo_name, name, qualified_name, file_path, start_line, end_line FROM class_"),
    "code_structure_functions": (_graph(named.code_structure_functions), "SELECT repo_name, name, qualified_name, file_path, start_line, end_line FROM function_"),
    "code_structure_inherits": (_graph(named.code_structure_inherits), "SELECT repo_name, child, parent FROM inherits"),
    "code_structure_calls": (_graph(named.code_structure_calls), "SELECT repo_name, caller, callee FROM calls"),
    "code_structure_imports": (_graph(named.code_structure_imports), "SELECT repo_name, source AS from_path, target AS to_path FROM imports_"),
    "code_structure_directory": (
        _graph(named.code_structure_functions, directory="brand_11/"),
        "SELECT repo_name, name, qualified_name, file_path, start_line, end_line FROM function_ WHERE file_path = 'brand_11' OR starts_with(file_path, 'brand_11/')",
    ),
    "mr_summary_header": (
        _table("merge_request"),
        """SELECT m.iid, m.repo_name, m.title, CAST(NULL AS VARCHAR) AS description, m.state, m.source_branch, m.target_branch, m.author_name, m.author_username, CAST(m.created_at AS VARCHAR) AS created_at, CAST(m.updated_at AS VARCHAR) AS updated_at,
        CAST(NULL AS VARCHAR) AS merged_at, CAST(NULL AS VARCHAR) AS closed_at, CAST(NULL AS VARCHAR) AS web_url, CAST(NULL AS VARCHAR) AS labels, coalesce(n, 0) AS notes_count FROM s_mrs m LEFT JOIN (SELECT iid, count(*) AS n FROM s_notes GROUP BY 1) x ON x.iid = m.iid""",
    ),
    "mr_summary_commits": (_graph(named.mr_commits), "SELECT m.repo_name, m.iid, c.hash, c.short_hash, c.message, CAST(c.ts AS VARCHAR) AS timestamp, c.repo_name AS commit_repo FROM s_mr_commits m JOIN commit_ c ON c.hash = m.hash"),
    "mr_summary_files": (_graph(named.mr_files), "SELECT DISTINCT mr_repo AS repo_name, iid, path FROM mr_mod"),
    "mr_summary_reviewers": (
        _linked(named.mr_reviewers),
        "SELECT r.repo_name, r.iid, a.name, a.email, r.username AS gitlab_username, r.approved FROM s_reviews r JOIN author a ON a.email = r.email",
    ),
    "search_functions": (_graph(named.search_functions, "BLUE"), "SELECT repo_name, name, qualified_name, file_path, start_line, end_line FROM function_ WHERE contains(lower(name), 'blue')"),
    "search_classes": (_graph(named.search_classes, "sS1"), "SELECT repo_name, name, qualified_name, file_path, start_line, end_line FROM class_ WHERE contains(lower(name), 'ss1')"),
    "upsert_author_last_wins": (_table("author"), "SELECT email, name, CAST(NULL AS VARCHAR) AS gitlab_username FROM author"),
    "upsert_modifies_last_wins": (_table("modifies"), "SELECT hash, repo_name, path, status, CAST(NULL AS VARCHAR) AS old_path, additions, deletions FROM modifies"),
    "commit_nodes": (_table("commit"), "SELECT hash, short_hash, message, CAST(ts AS VARCHAR) AS timestamp, branch, repo_name FROM commit_"),
    "file_nodes_with_phantoms": (_table("file"), "SELECT repo_name, path, language, size FROM file"),
    "directory_nodes": (_table("directory"), "SELECT DISTINCT repo_name, unnest([regexp_extract(path, '^[^/]+'), regexp_extract(path, '^[^/]+/[^/]+')]) AS path FROM s_files"),
    "directory_chain": (_table("child_of"), "SELECT DISTINCT repo_name, regexp_extract(path, '^[^/]+') AS parent, regexp_extract(path, '^[^/]+/[^/]+') AS child FROM s_files"),
    "contains_file": (_table("contains_file"), "SELECT repo_name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, path FROM s_files"),
    "edge_authored_by": (_table("authored_by"), "SELECT hash, author_email AS email FROM s_commits"),
    "edge_committed_by": (_table("committed_by"), "SELECT hash, committer_email AS email FROM s_commits WHERE committer_email <> author_email"),
    "edge_parent_of": (_table("parent_of"), "SELECT parent, hash AS child FROM s_commits WHERE parent IS NOT NULL"),
    "edge_has_commit": (_table("has_commit"), "SELECT repo_name, hash FROM s_commits"),
    "edge_has_branch": (_table("has_branch"), "SELECT repo_name, name AS branch FROM s_branches"),
    "edge_contains_class": (_table("contains_class"), "SELECT repo_name, file_path AS path, qualified_name FROM s_classes"),
    "edge_contains_function": (_table("contains_function"), "SELECT DISTINCT repo_name, file_path AS path, qualified_name FROM s_functions"),
    "edge_has_method": (_table("has_method"), "SELECT DISTINCT f.repo_name, c.qualified_name AS class, f.qualified_name AS function FROM s_functions f JOIN s_classes c ON c.name = f.class_name AND c.repo_name = f.repo_name"),
    "edge_inherits": (_table("inherits"), "SELECT repo_name, child, parent FROM inherits"),
    "edge_calls": (_table("calls"), "SELECT repo_name, caller, callee FROM calls"),
    "edge_imports": (_table("imports"), "SELECT repo_name, source, target, imported_name, alias FROM imports_"),
    "edge_created_by": (_table("created_by"), "SELECT iid, repo_name, 'User' AS dst_label, author_username AS dst_key FROM s_mrs"),
    "edge_sources": (_table("sources"), "SELECT iid, repo_name, source_branch AS branch FROM s_mrs"),
    "edge_targets": (_table("targets"), "SELECT iid, repo_name, target_branch AS branch FROM s_mrs"),
    "edge_contains_commit": (_table("contains_commit"), "SELECT iid, repo_name, hash FROM s_mr_commits"),
    "edge_reviewed_by": (_table("reviewed_by"), "SELECT iid, repo_name, 'User' AS dst_label, username AS dst_key, approved, CAST(created_at AS VARCHAR) AS created_at FROM s_reviews"),
    "edge_has_merge_request": (_table("has_merge_request"), "SELECT repo_name, iid FROM s_mrs"),
    "mr_notes": (_table("mr_note"), "SELECT iid, repo_name, CAST(pos AS BIGINT) AS pos, author_username, author_name, body, CAST(created_at AS VARCHAR) AS created_at, is_system, noteable_type FROM s_notes"),
    "branch_nodes": (
        _table("branch"),
        "SELECT b.repo_name, b.name, b.is_default, h.hash AS head_commit_hash FROM s_branches b LEFT JOIN (SELECT repo_name, branch, arg_max(hash, (ts, o_orderkey)) AS hash FROM s_commits GROUP BY 1, 2) h ON h.branch = b.name AND h.repo_name = b.repo_name",
    ),
    "repository_nodes": (_table("repository"), "SELECT r_name AS name, concat('https://git.example.com/', lower(r_name)) AS url, b.name AS default_branch FROM region JOIN s_branches b ON b.repo_name = r_name AND is_default"),
    "user_nodes": (
        _table("user"),
        """, w AS (SELECT author_username AS username, author_name AS name, repo_name, 0 AS role, pos FROM s_mrs UNION ALL SELECT username, name, repo_name, 1, pos FROM s_reviews)
        SELECT u.username, u.name, m.email FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY username ORDER BY repo_name DESC, role DESC, pos DESC, name DESC) = 1) u
        LEFT JOIN (SELECT username, any_value(email) AS email FROM s_reviews GROUP BY 1) m ON m.username = u.username""",
    ),
    "author_contributions_linked": (
        _linked(lambda g: named.author_contributions(g).select("author_email", "repo_name", "commit_count", "merge_request_count", "merge_request_iids")),
        """, u AS (SELECT DISTINCT username, email FROM s_reviews), a AS (SELECT email, repo_name, count(*) AS n, string_agg(CAST(iid AS VARCHAR), ',' ORDER BY iid) AS l FROM s_mrs JOIN u ON username = author_username WHERE email IN (SELECT email FROM author) GROUP BY 1, 2),
        c AS (SELECT author_email AS email, repo_name, count(*) AS n FROM s_commits GROUP BY 1, 2)
        SELECT coalesce(c.email, a.email) AS author_email, coalesce(c.repo_name, a.repo_name) AS repo_name, coalesce(c.n, 0) AS commit_count, coalesce(a.n, 0) AS merge_request_count, coalesce(a.l, '') AS merge_request_iids
        FROM c FULL JOIN a ON a.email = c.email AND a.repo_name = c.repo_name""",
    ),
}

_ENTRIES |= {
    "hub_functions": (
        _graph(recipes.hub_functions),
        "SELECT repo_name, callee, callers FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY callers DESC, callee) AS r FROM (SELECT repo_name, callee, count(DISTINCT caller) AS callers FROM calls WHERE caller <> callee GROUP BY 1, 2)) WHERE r <= 10",
    ),
    "file_owners": (
        _graph(recipes.file_owners),
        """, w AS (SELECT m.repo_name, path, author_email, count(*) AS n FROM modifies m JOIN s_commits c ON c.hash = m.hash GROUP BY ALL)
        SELECT repo_name, path, author_email AS owner, round(n / commits, 4) AS share, CAST(commits AS BIGINT) AS commits FROM (SELECT *, sum(n) OVER (PARTITION BY repo_name, path) AS commits, row_number() OVER (PARTITION BY repo_name, path ORDER BY n DESC, author_email) AS r FROM w) WHERE r = 1""",
    ),
    "mr_overlaps": (
        _graph(recipes.mr_overlaps),
        """, f AS (SELECT DISTINCT mr_repo, iid, path FROM mr_mod WHERE iid % 4 = 0)
        SELECT a.mr_repo AS repo_name, a.iid, b.iid AS other_iid, count(*) AS shared_files FROM f a JOIN f b ON b.mr_repo = a.mr_repo AND b.path = a.path AND a.iid < b.iid GROUP BY ALL""",
    ),
}


def _approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("dev"), F.col("o_custkey").cast("string")).alias("username"), F.col("o_orderstatus").alias("name"), F.lit(None).cast("string").alias("email"), F.col("o_orderdate").cast("timestamp").alias("created_at"), "o_orderstatus")
    rows = ingest.merge_approvals(o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("o_orderstatus <> 'F'").drop("o_orderstatus"))
    return _flat(rows.select("username", "approved", "created_at"))


def _schema_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of the stored graph, and how many rows of how many tables it was held against."""
    g = demo.stored(spark, sf_dir)
    g.write([t for t in schema.NODES if t in g])
    found = schema.verify({t: g[t] for t in schema.NODES if t != "sync_state"})
    return spark.createDataFrame([(k, v) for k, v in found.items() if "sync_state" not in k], "rule string, holds boolean")


_REPO = "ASIA"


def _bound(build: Callable, table: str, column: str, argument: str, greatest: bool = False, **more) -> Callable[[SparkSession, str], DataFrame]:
    """A named query for one subject: the least (or greatest) ``column`` of a table in one repository."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = demo.graph(spark, sf_dir)
        rows = g[table].where(F.col("repo_name") == _REPO)
        subject = rows.agg((F.max if greatest else F.min)(column)).head()[0]
        return _flat(build(g, **{argument: subject}, repo_name=_REPO, **more))

    return run


def _author_of_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = demo.graph(spark, sf_dir)
    email = g["authored_by"].join(g["commit"].where(F.col("repo_name") == _REPO).select("hash"), "hash").agg(F.min("email")).head()[0]
    return _flat(named.author_contributions(g, email, _REPO))


def _one_row_summary(g, **bound) -> DataFrame:
    one = named.mr_summary(g, **bound)
    return one.select(
        "repo_name", "iid", F.col("merge_request.state").alias("state"), F.transform("commits", lambda c: c["hash"]).alias("commits"), F.col("files"), F.transform("reviewers", lambda r: r["email"]).alias("reviewers"), "notes_count",
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of texts as one text, with its place: partition and batch."""
    part = TaskContext.get().partitionId()
    for k, batch in enumerate(batches):
        found = [x for x in batch.column(0).to_pylist() if x is not None]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([k], pa.int64()), pa.array([",".join(found)], pa.string())], names=["part", "k", "text"])


def _one_row_of_texts(lists: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """One row with a comma-joined text for each name: the rows of its frame in the order of the columns, each as those columns joined by ``>``.

    Rows are sorted and joined by all tasks; the last one only puts the pieces in a row, which must fit into its memory.
    """
    pieces = None
    for name, (rows, order) in lists.items():
        one = rows.orderBy(*order).select(F.concat_ws(">", *order) if len(order) > 1 else F.col(order[0])).mapInArrow(_chunks, "part bigint, k bigint, text string").withColumn("name", F.lit(name))
        pieces = one if pieces is None else pieces.unionByName(one)
    whole = lambda name: F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.when(F.col("name") == name, F.struct("part", "k", "text")))), lambda x: x["text"]))
    return pieces.agg(*[whole(name).alias(name) for name in lists])


def _one_row_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = demo.graph(spark, sf_dir)
    lists = {"classes": ("qualified_name",), "functions": ("qualified_name",), "inherits": ("child", "parent"), "calls": ("caller", "callee"), "imports": ("from_path", "to_path")}
    texts = _one_row_of_texts({name: (getattr(named, f"code_structure_{name}")(g, _REPO), list(order)) for name, order in lists.items()})
    inside = named.code_structure_functions(g, _REPO, "brand_1").agg(F.count("*").alias("in_directory"))
    return texts.crossJoin(F.broadcast(inside)).select("in_directory", *lists)  # the count goes to the texts


#: Tables that a load of the newer half after the older half must leave as one load of all does.
_SYNCED = {"commit": "commit_", "author": "author", "modifies": "modifies", "parent_of": "s_parents", "authored_by": "s_commits", "has_commit": "s_commits"}


def _differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: ``n``, the rows of ``a``, and ``differences``, the rows that either has more often than the other. Each is read and shuffled once."""
    both = a.withColumn("__side", F.lit(1)).unionByName(b.withColumn("__side", F.lit(-1)))
    each = both.groupBy(*[F.col(f"`{c}`") for c in a.columns]).agg(F.sum("__side").alias("more"), F.count_if(F.col("__side") == 1).alias("of_a"))
    return each.agg(F.coalesce(F.sum("of_a"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.abs("more")), F.lit(0)).alias("differences"))


def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each table: rows of the full load, and rows that a load of the older commits followed by the newer ones has otherwise."""
    r = demo.records(spark, sf_dir)
    repos = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_name").alias("name"), F.lit("u").alias("url"), F.lit("b").alias("default_branch"))
    start = ingest.ingest_repository(Graph(spark), repos)

    def loaded(g: Graph, when: Callable[[Column], Column] | None) -> Graph:
        commits, changes, parents = demo.commit_records(r, when)
        return ingest.ingest_commits(g, commits, changes, parents, all_changes=changes)

    full = loaded(start, None)
    half = lambda ts: ts < F.lit("1995-06-01")
    root = new_path(spark, "prefix")
    save(loaded(start, half), root)
    parts = loaded(load(spark, root), lambda ts: ~half(ts))
    out = None
    for table in _SYNCED:
        a, b = (g[table].drop("updated_at", *(["name"] if table == "author" else [])) for g in (full, parts))  # a name is the last one by load order
        one = _differences(a, b).select(F.lit(table).alias("table_name"), "n", "differences")
        out = one if out is None else out.unionAll(one)
    return out


def _upsert_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the stored table, suppliers of the same number as the incoming one."""
    old = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    new = spark.read.parquet(f"{sf_dir}/supplier.parquet").select((F.col("s_suppkey") * 2).alias("k"), F.col("s_acctbal").alias("balance"))
    return upsert.upsert(old, new, ["k"])


_ENTRIES |= {
    "map_change_type": (samples.change_types, samples.change_types_sql()),
    "mr_labels_state_normalise": (samples.labels_and_states, samples.labels_and_states_sql()),
    "approvals_merge": (
        _approvals,
        "SELECT username, approved, CAST(max(created_at) AS VARCHAR) AS created_at FROM (SELECT concat('dev', CAST(o_custkey AS VARCHAR)) AS username, o_orderstatus = 'F' AS approved, o_orderdate AS created_at FROM orders) QUALIFY approved = max(approved) OVER (PARTITION BY username) GROUP BY 1, 2",
    ),
    "schema_verify": (_schema_verify, "SELECT rule, true AS holds FROM (VALUES " + ", ".join([f"('unique:{t}')" for t in schema.NODES if t != "sync_state"] + [f"('sorted:{t}.{c}')" for t, c in schema.SORTED.items()]) + ") v(rule)"),
    "upsert_full_outer": (_upsert_prices, "SELECT coalesce(c_custkey, s_suppkey * 2) AS k, c_name AS name, CASE WHEN s_suppkey IS NULL THEN c_acctbal ELSE s_acctbal END AS balance FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 2"),
}
_ENTRIES["approvals_merge"] = (
    _approvals,
    """SELECT username, a AS approved, CAST(max(created_at) AS VARCHAR) AS created_at FROM (SELECT *, bool_or(approved) OVER (PARTITION BY username) AS a FROM (SELECT concat('dev', CAST(o_custkey AS VARCHAR)) AS username, o_orderstatus = 'F' AS approved, o_orderdate AS created_at FROM orders))
    WHERE approved = a GROUP BY 1, 2""",
)


_OF = lambda column, table, how="min", where="": f"(SELECT {how}({column}) FROM {table} WHERE repo_name = '{_REPO}'{where})"
_IID = _OF("iid", "s_mrs")


def _limited(name: str, condition: str) -> str:
    """The SQL of the whole-table form, for one subject."""
    text = _ENTRIES[name][1].lstrip()
    head, body = (text, None) if not text.startswith(",") else _split(text)
    return f"{body}SELECT * FROM ({head}) WHERE {condition}" if body else f"SELECT * FROM ({head}) WHERE {condition}"


def _split(text: str) -> tuple[str, str]:
    """The final SELECT of a text that begins with more common table expressions, and those."""
    depth, at = 0, 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if depth == 0 and text.startswith("SELECT", k):
            at = k
            break
    return text[at:], text[:at]


_ENTRIES |= {
    "hot_files_top_k": (_graph(named.hot_files, limit=3), _ENTRIES["hot_files"][1].replace("r <= 20", "r <= 3")),
    "files_changed_one_mr": (_bound(named.files_changed_in_mr, "merge_request", "iid", "mr_iid"), _limited("files_changed_all_mrs", f"mr_repo = '{_REPO}' AND iid = {_IID}")),
    "commit_history_one_file": (_bound(named.commit_history, "modifies", "path", "file_path", limit=5), _limited("commit_history", f"file_repo = '{_REPO}' AND path = {_OF('path', 'modifies')}").replace("r <= 50", "r <= 5")),
    "function_callers_one": (_bound(named.function_callers, "calls", "callee", "function_name", greatest=True), _limited("function_callers", f"repo_name = '{_REPO}' AND callee_name = {_OF('callee', 'calls', 'max')}")),
    "class_hierarchy_one": (_bound(named.class_hierarchy, "inherits", "child", "class_name", greatest=True), _limited("class_hierarchy", f"""repo_name = '{_REPO}' AND "of" = {_OF("child", "inherits", "max")}""")),
    "class_ancestors_all": (
        lambda spark, sf_dir: named.class_hierarchy(demo.graph(spark, sf_dir)).where("role = 'ancestor'").select("repo_name", "of", F.col("qualified_name").alias("ancestor")),
        _CLOSURE + 'SELECT repo_name, a AS "of", b AS ancestor FROM reach',
    ),
    "file_dependencies_one": (_bound(named.file_dependencies, "imports", "source", "file_path"), _limited("file_dependencies", f"repo_name = '{_REPO}' AND path = {_OF('source', 'imports_')}")),
    "author_contributions_one": (_author_of_repo, _limited("author_contributions", f"repo_name = '{_REPO}' AND author_email = {_OF('author_email', 's_commits')}")),
    "mr_risk_one": (_bound(named.mr_risk_score, "merge_request", "iid", "mr_iid"), _limited("mr_risk_all", f"repo_name = '{_REPO}' AND iid = {_IID}")),
    "recent_changes_one": (_graph(named.recent_changes, repo_name=_REPO, days=60, limit=5, as_of=AS_OF), _limited("recent_changes", f"repo_name = '{_REPO}'").replace("INTERVAL 30 DAY", "INTERVAL 60 DAY").replace("r <= 50", "r <= 5")),
    "mr_summary_one_row": (
        lambda spark, sf_dir: _bound(lambda g, **b: _one_row_summary(ingest.link_identities(g), **b), "merge_request", "iid", "mr_iid")(spark, sf_dir),
        f"""SELECT m.repo_name, m.iid, m.state, (SELECT string_agg(c.hash, ',' ORDER BY c.hash) FROM s_mr_commits c WHERE c.iid = m.iid) AS commits, (SELECT coalesce(string_agg(DISTINCT path, ',' ORDER BY path), '') FROM mr_mod x WHERE x.iid = m.iid AND x.mr_repo = m.repo_name) AS files,
        (SELECT coalesce(string_agg(r.email, ',' ORDER BY r.email), '') FROM s_reviews r JOIN author a ON a.email = r.email WHERE r.iid = m.iid) AS reviewers, (SELECT count(*) FROM s_notes n WHERE n.iid = m.iid) AS notes_count FROM s_mrs m WHERE m.repo_name = '{_REPO}' AND m.iid = {_IID}""",
    ),
    "code_structure_one_row": (
        _one_row_structure,
        f"""SELECT (SELECT count(*) FROM function_ WHERE repo_name = '{_REPO}' AND starts_with(file_path, 'brand_1/')) AS in_directory, (SELECT {_AGG.format("qualified_name")} FROM class_ WHERE repo_name = '{_REPO}') AS classes, (SELECT {_AGG.format("qualified_name")} FROM function_ WHERE repo_name = '{_REPO}') AS functions,
        (SELECT coalesce(string_agg(concat(child, '>', parent), ',' ORDER BY child, parent), '') FROM inherits WHERE repo_name = '{_REPO}') AS inherits, (SELECT coalesce(string_agg(concat(caller, '>', callee), ',' ORDER BY caller, callee), '') FROM calls WHERE repo_name = '{_REPO}') AS calls,
        (SELECT coalesce(string_agg(concat(source, '>', target), ',' ORDER BY source, target), '') FROM imports_ WHERE repo_name = '{_REPO}') AS imports""",
    ),
    "sync_incremental_equals_full": (
        _incremental,
        " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n, CAST(0 AS BIGINT) AS differences FROM {s if t != 'parent_of' else 's_commits WHERE parent IS NOT NULL'}" for t, s in _SYNCED.items()),
    ),
}
_ENTRIES |= {f"parse_{language}": (lambda spark, sf_dir, language=language: samples.parse(spark, sf_dir, language), samples.parse_sql(language)) for language in samples.LANGUAGES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in _ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: CTE + s.lstrip() for k, (_, s) in _ENTRIES.items() if s}
