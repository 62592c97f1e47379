"""Upserts, ingestion, closure and queries on hand-made graphs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from graphloom import graph as store
from graphloom import schema
from graphloom.api import RepoAPI, serialize
from graphloom.graph import Graph
from graphloom.operators import closure, ingest, upsert
from graphloom.plans import named

T = dt.datetime(2024, 6, 1, 12, 0)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def api(spark):
    g = Graph(spark)
    g = ingest.ingest_repository(g, spark.createDataFrame([("r", "u", "main")], "name string, url string, default_branch string"))
    g = ingest.ingest_branches(g, spark.createDataFrame([("r", "main", True, "c3"), ("r", "dev", False, "c1"), ("other", "x", True, "h")], "repo_name string, name string, is_default boolean, head_commit_hash string"))
    who = lambda n: (f"{n}@x", n)
    commits = [("r", 0, "c3", "c3", "m3", T, "main", *who("ann"), *who("bob")), ("r", 1, "c2", "c2", "m2", T - dt.timedelta(days=1), "main", *who("ann"), *who("ann")), ("r", 2, "c1", "c1", "m1", None, "main", "", None, "", None)]
    c = spark.createDataFrame(commits, "repo_name string, pos long, hash string, short_hash string, message string, timestamp timestamp, branch string, author_email string, author_name string, committer_email string, committer_name string")
    changes = [("r", "c3", 0, "src/a.py", None, "modified", 1, 0), ("r", "c3", 1, "src/a.py", None, "added", 7, 2), ("r", "c2", 0, "src/a.py", None, "modified", 3, None), ("r", "c2", 1, "src2/b.py", None, "added", 1, 1), ("r", "c1", 0, "top.md", None, "added", 1, 0)]
    d = spark.createDataFrame(changes, "repo_name string, hash string, k int, path string, old_path string, status string, additions long, deletions long")
    parents = spark.createDataFrame([("c3", "c2"), ("c2", "c1"), ("c1", "gone")], "hash string, parent string")
    g = ingest.ingest_commits(g, c, d, parents)
    files = [
        ("r", 0, "src/a.py", "python", 10, [("A", "A", "src/a.py", 1, 9, ["A", "B"], [("run", "A.run", "src/a.py", 2, 3, ["self"], None, True, "A", ["go", "m.go", "run"])])], [("go", "go", "src/a.py", 5, 6, [], None, False, None, [])], [("src/a.py", "os", "os.path", None), ("src/a.py", "b", "src2/b.py", "x"), ("src/a.py", "n", "", None)]),
        ("r", 1, "src2/b.py", "python", 20, [("B", "B", "src2/b.py", 1, 2, ["C"], []), ("C", "C", "src2/b.py", 4, 5, ["B"], [])], [("go", "go", "src2/b.py", 9, 9, ["q"], None, False, None, ["A.run"])], []),
    ]
    f = spark.createDataFrame(files, "repo_name string, pos long, path string, language string, size long, classes array<struct<name:string,qualified_name:string,file_path:string,start_line:bigint,end_line:bigint,bases:array<string>,methods:array<struct<name:string,qualified_name:string,file_path:string,start_line:bigint,end_line:bigint,parameters:array<string>,return_type:string,is_method:boolean,class_name:string,calls:array<string>>>>>, functions array<struct<name:string,qualified_name:string,file_path:string,start_line:bigint,end_line:bigint,parameters:array<string>,return_type:string,is_method:boolean,class_name:string,calls:array<string>>>, imports array<struct<source_file:string,imported_name:string,module_path:string,alias:string>>")
    g = ingest.ingest_files(g, *ingest.flatten_files(f))
    mrs = spark.createDataFrame([(42, "r", "t", "weird", "dev", "main", "Ann", "ann", T, T, 0), (43, "r", "empty", "opened", "no", "main", "Bob", "bob", T, T, 1)], "iid long, repo_name string, title string, state string, source_branch string, target_branch string, author_name string, author_username string, created_at timestamp, updated_at timestamp, pos long")
    held = spark.createDataFrame([(42, "r", "c3"), (42, "r", "c2"), (42, "r", "nope")], "iid long, repo_name string, hash string")
    reviews = spark.createDataFrame([(42, "r", "bob", "Bob", "bob@x", False, T, 0), (42, "r", "bob", "Bob", "bob@x", True, T, 1), (42, "r", "ann", "Ann", "ann@x", False, T, 2)], "iid long, repo_name string, username string, name string, email string, approved boolean, created_at timestamp, pos long")
    notes = spark.createDataFrame([(42, "r", 0, "bob", "Bob", "hi", T, False, "MergeRequest")], schema.DETAILS["mr_note"][0])
    g = ingest.ingest_merge_requests(g, mrs, held, reviews, notes)
    from graphloom.storage import new_path

    path = new_path(spark, "test-graph")
    store.save(g, path)
    return RepoAPI.open(spark, path, "r")


def test_last_wins_and_upsert(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 0), ("b", 3, 0)], "k string, v int, seq int")
    assert rows(upsert.last_wins(df, ["k"], ["seq"]).select("k", "v")) == [("a", 1), ("b", 3)]
    old = spark.createDataFrame([("a", 1, "x"), (None, 2, "y")], "k string, v int, w string")
    new = spark.createDataFrame([("a", None), ("c", 5), (None, 9)], "k string, v int")
    assert {r.k: (r.v, r.w) for r in upsert.upsert(old, new, ["k"]).collect()} == {"a": (None, "x"), "c": (5, None), None: (9, "y")}
    assert {r.k: r.v for r in upsert.upsert(old, new, ["k"], keep_old_if_null=True).collect()} == {"a": 1, "c": 5, None: 9}


def test_closure_survives_cycles(spark):
    e = spark.createDataFrame([("r", "a", "a"), ("r", "b", "c"), ("r", "c", "b"), ("r", "c", "d"), ("s", "b", "z")], "repo_name string, src string, dst string")
    assert rows(closure.closure(e).where("repo_name = 'r'").select("src", "dst")) == [("a", "a"), ("b", "b"), ("b", "c"), ("b", "d"), ("c", "b"), ("c", "c"), ("c", "d")]
    assert rows(closure.closure(e, spark.createDataFrame([("s", "b")], "repo_name string, src string"))) == [("s", "b", "z")]
    assert closure.closure(e.where("false")).count() == 0


def test_edges(api):
    g = api.graph
    assert rows(g["has_branch"]) == [("r", "dev"), ("r", "main")]  # no repository, no edge
    assert rows(g["parent_of"]) == [("c1", "c2"), ("c2", "c3")]
    assert rows(g["committed_by"]) == [("c3", "bob@x")]
    assert rows(g["modifies"].where("hash = 'c3'").select("status", "additions")) == [("added", 7)]  # the last change of a file wins
    assert rows(g["file"].select("path", "language").na.fill("-")) == [("os.path", "-"), ("src/a.py", "python"), ("src2/b.py", "python"), ("top.md", "-")]
    assert rows(g["inherits"].select("child", "parent")) == [("A", "A"), ("A", "B"), ("B", "C"), ("C", "B")]
    assert rows(g["calls"].select("caller", "callee")) == [("A.run", "A.run"), ("A.run", "go")]  # dotted calls don't resolve
    assert rows(g["contains_function"].select("path", "qualified_name")) == [("src/a.py", "A.run"), ("src/a.py", "go"), ("src2/b.py", "go")]
    assert rows(g["function"].where("name = 'go'").select("file_path")) == [("src2/b.py",)]  # namesakes collapse, the last wins
    assert rows(g["has_method"].select("class", "function")) == [("A", "A.run")]
    assert rows(g["contains_file"].select("directory", "path")) == [("src", "src/a.py"), ("src2", "src2/b.py")]
    assert rows(g["sources"].select("iid", "branch")) == [(42, "dev")]
    assert rows(g["contains_commit"].select("iid", "hash")) == [(42, "c2"), (42, "c3")]
    assert rows(g["reviewed_by"].select("dst_key", "approved")) == [("ann", False), ("bob", True)]
    assert rows(g["author"].select("email")) == [("",), ("ann@x",), ("bob@x",)]


def test_queries(api):
    changed = api.query("files-changed-in-mr", mr_iid=42)
    assert [(c["path"], c["additions"], c["deletions"], c["commit_touch_count"]) for c in changed] == [("src/a.py", 10, 2, 2), ("src2/b.py", 1, 1, 1)]
    assert [h["hash"] for h in api.commit_history("src/a.py")] == ["c3", "c2"] and [h["hash"] for h in api.commit_history("src/a.py", 1)] == ["c3"]
    assert api.commit_history("none") == [] and api.files_changed_in_mr(7) == []
    assert [c["caller_qualified_name"] for c in api.function_callers("go")] == ["A.run"]
    assert [(r["role"], r["qualified_name"]) for r in api.class_hierarchy("A")] == [("self", "A"), ("ancestor", "A"), ("ancestor", "B"), ("ancestor", "C"), ("descendant", "A")]
    assert api.file_dependencies("src/a.py") == {"imports": ["os.path", "src2/b.py"], "imported_by": []}
    assert api.file_dependencies("zzz") == {"imports": [], "imported_by": []}
    mine = api.author_contributions("ann@x")
    assert mine["commit_count"] == 2 and mine["files_modified"] == ["src/a.py", "src2/b.py"] and mine["merge_request_count"] == 0
    assert api.author_contributions("nobody")["commit_hashes"] == []
    assert [(h["path"], h["modification_count"]) for h in api.hot_files(2)] == [("src/a.py", 2), ("src2/b.py", 1)]
    risk = api.mr_risk_score(42)
    assert risk["file_count"] == 2 and risk["module_roots"] == ["src", "src2"] and risk["risk_score"] == 2 + 4 + 5
    assert api.mr_risk_score(43)["risk_score"] == 0.0 and api.mr_risk_score(99)["cross_module"] is False
    assert [c["hash"] for c in api.recent_changes(1, as_of=T)] == ["c3", "c2"] and [c["hash"] for c in api.recent_changes(0, as_of=T)] == ["c3"]
    part = api.code_structure("src/")
    assert [c["name"] for c in part["classes"]] == ["A"] and part["inherits"] == [{"child": "A", "parent": "A"}]
    assert part["imports"] == [{"from_path": "src/a.py", "to_path": "os.path"}, {"from_path": "src/a.py", "to_path": "src2/b.py"}]
    summary = api.mr_summary(42)
    assert summary["merge_request"]["state"] == "closed" and summary["notes_count"] == 1 and [c["hash"] for c in summary["commits"]] == ["c2", "c3"] and summary["reviewers"] == []
    assert api.mr_summary(5) == {} and api.mr_summary(43)["files"] == []
    assert [f["name"] for f in api.search_functions("GO")] == ["go"] and api.search_classes("%") == []
    with pytest.raises(ValueError, match="hot_files"):
        api.query("nope")


def test_linked_identities(api):
    g = ingest.link_identities(api.graph)
    linked = RepoAPI(g, "r")
    assert linked.author_contributions("bob@x")["merge_request_iids"] == [43]
    assert [(r["gitlab_username"], r["approved"]) for r in linked.mr_summary(42)["reviewers"]] == [("ann", False), ("bob", True)]


def test_loading_twice_changes_nothing(spark, api):
    g = api.graph
    before = {t: g[t].count() for t in ("commit", "file", "modifies", "inherits")}
    c = g["commit"].selectExpr("repo_name", "0L pos", "hash", "short_hash", "message", "timestamp", "branch", "'' author_email", "'x' author_name", "'' committer_email", "'x' committer_name")
    d = g["modifies"].selectExpr("repo_name", "hash", "0 k", "path", "old_path", "status", "additions", "deletions")
    again = ingest.ingest_commits(g, c, d, g["parent_of"].selectExpr("child hash", "parent"))
    assert {t: again[t].count() for t in before} == before


def test_schema(spark, api):
    assert all(schema.verify(api.graph).get(f"unique:{t}", False) for t in ("commit", "file", "class"))
    assert schema.quote("a`b") == "`a``b`"
    from graphloom.storage import new_path

    g = store.initialize(spark, new_path(spark, "init"))
    assert all(schema.verify(g).values()) and len(g) == len(schema.TABLES)


def test_verify_finds_faults(spark, api):
    """A table out of order or with repeated keys isn't passed."""
    from graphloom.storage import new_path

    path = new_path(spark, "faults")
    authors = api.graph["author"]
    authors.orderBy("name").coalesce(1).write.parquet(f"{path}/good")
    authors.unionAll(authors).orderBy(F.desc("name")).coalesce(1).write.parquet(f"{path}/bad")
    good, bad = (Graph(spark, {"author": spark.read.parquet(f"{path}/{k}")}) for k in ("good", "bad"))
    for g, want in ((good, True), (bad, False)):
        found = schema.verify(g)
        assert found["unique:author"] is want and found["sorted:author.name"] is want and found["unique:file"] is False
    assert schema.verify(Graph(spark, {"author": authors.limit(3)}))["sorted:author.name"] in (True, False)


def test_closure_doubles(spark):
    """A path of 100 edges in eight rounds, equal to the seeded form."""
    e = spark.createDataFrame([("r", f"n{k:03d}", f"n{k + 1:03d}") for k in range(100)], "repo_name string, src string, dst string")
    whole = closure.closure(e, max_rounds=8)
    assert whole.count() == 5050 and rows(whole.where("src = 'n090'")) == rows(closure.closure(e, spark.createDataFrame([("r", "n090")], "repo_name string, src string")))


def test_snapshots_are_never_missing(spark, tmp_path):
    """Between any two steps of a save a reader finds the old snapshot or the new one; of two writers one fails."""
    root = f"{tmp_path}/g"
    names = lambda g: rows(g["repository"].select("name"))
    repo = lambda n: spark.createDataFrame([(n, "u", "main", T)], schema.TABLES["repository"][0])
    assert len(store.load(spark, root)) == 0 and store.current_version(spark, root) is None
    assert store.save(Graph(spark, {"repository": repo("a"), "author": schema.empty(spark, "author")}), root) == 1
    one, other = store.load(spark, root), store.load(spark, root)
    (tmp_path / "g/pointers/000000000002.json").write_text("")  # a writer that is not done yet
    assert names(store.load(spark, root)) == [("a",)]
    (tmp_path / "g/pointers/000000000002.json").unlink()
    (tmp_path / "g/pointers/.000000000002.json.crc").unlink(missing_ok=True)
    assert store.save(one.with_tables(repository=repo("b")), root) == 2
    assert names(store.load(spark, root)) == [("b",)] and names(store.load(spark, root, 1)) == [("a",)] and names(one) == [("a",)]
    with pytest.raises(store.ConflictError):
        store.save(other.with_tables(repository=repo("c")), root)
    assert names(store.load(spark, root)) == [("b",)]
    # what didn't change isn't written again
    assert store.load(spark, root).base.places["author"] == one.base.places["author"] != store.load(spark, root).base.places["repository"]
    assert len(store.vacuum(spark, root, keep=1)) == 0  # the author table's folder is still in use
    store.save(store.load(spark, root).with_tables(author=schema.empty(spark, "author")), root)
    assert len(store.vacuum(spark, root, keep=1)) == 1 and names(store.load(spark, root)) == [("b",)]
    for p in (tmp_path / "g/pointers").glob("*.json"):
        p.write_text("")
    with pytest.raises(RuntimeError, match="no complete snapshot"):
        store.load(spark, root)


def test_serialize():
    assert serialize({"t": T, "l": [dt.timedelta(days=1)], "d": T.date()}) == {"t": "2024-06-01T12:00:00", "l": ["1 day, 0:00:00"], "d": "2024-06-01"}


def test_whole_table_forms(api):
    assert named.hot_files(api.graph).count() == 3 and named.mr_summary(api.graph).count() == 2
