"""Sources: git, GitLab documents, source code, configuration, streaming and the command line."""

import json
import subprocess
import urllib.error

import pytest
from pyspark.sql import functions as F

from graphloom import cli, config, sync
from graphloom.functions import columns as C
from graphloom.graph import Graph, load
from graphloom.sources import code, git, gitlab


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    path = tmp_path_factory.mktemp("clone")

    def run(*a):
        return subprocess.run(["git", "-C", str(path), "-c", "user.name=Ann", "-c", "user.email=ann@x", *a], check=True, capture_output=True, text=True).stdout.strip()

    run("init", "-q", "-b", "main")
    hashes = []
    for k, (name, text) in enumerate([("README.md", "hi\n"), ("src/mod.py", "import os\n\ndef f(a):\n    return g(a)\n\n\ndef g(x):\n    return x\n"), ("src/pkg/util.py", "class A(B):\n    def m(self):\n        f(1)\n")]):
        (path / name).parent.mkdir(parents=True, exist_ok=True)
        (path / name).write_text(text)
        run("add", "-A")
        run("commit", "-q", "-m", f"step {k}")
        hashes.append(run("rev-parse", "HEAD"))
    run("branch", "feature")
    run("mv", "README.md", "READ ME.md")
    run("commit", "-q", "-m", "rename")
    return str(path), [*hashes, run("rev-parse", "HEAD")]


def test_git_revisions(repo, tmp_path):
    path, h = repo
    assert git.revisions(path) == h[::-1] and git.revisions(path, "main", h[1]) == [h[3], h[2]]
    assert git.revisions(path, since="0" * 40) == h[::-1] and git.revisions(path, max_count=2) == [h[3], h[2]]
    assert [(n, d) for n, d, _ in git.branches(path)] == [("feature", False), ("main", True)]
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    assert git.revisions(str(tmp_path)) == [] and git.branches(str(tmp_path)) == []
    with pytest.raises(git.GitError):
        git.check("/nowhere")


def test_git_commits(spark, repo):
    path, h = repo
    got = {r.hash: r for r in git.load(spark, path, slice=2, repoName="r").collect()}
    assert set(got) == set(h) and got[h[0]].parent_hashes == [] and got[h[1]].parent_hashes == [h[0]]
    assert [(d.path, d.status, d.additions) for d in got[h[1]].diffs] == [("src/mod.py", "added", 8)]
    d = got[h[3]].diffs[0]
    assert (d.path, d.old_path, d.status) == ("READ ME.md", "README.md", "renamed") and got[h[3]].pos == 0
    assert sorted(r.path for r in git.load(spark, path, "files").collect()) == ["READ ME.md", "src/mod.py", "src/pkg/util.py"]


def test_full_load_equals_prefix_and_update(spark, repo, tmp_path):
    path, h = repo
    g, n = sync.ingest_local_commits(Graph(spark), path, "r", "main")
    a, _ = sync.ingest_local_commits(Graph(spark), path, "r", h[1])
    b, m = sync.ingest_local_commits(a, path, "r", "main", since=h[1])
    assert (n, m) == (4, 2)
    for t in ("commit", "parent_of", "modifies", "file", "author"):
        drop = [c for c in ("updated_at", "branch") if c in g[t].columns]
        assert sorted(map(str, g[t].drop(*drop).collect())) == sorted(map(str, b[t].drop(*drop).collect())), t


def test_cli(spark, repo, tmp_path, capsys):
    path, h = repo
    cfg = tmp_path / "c.yml"
    cfg.write_text(f"repository: {{path: {path}, name: r}}\nstore: {{path: {tmp_path}/store}}\n")
    here = lambda: spark
    assert cli.main(["schema", "init", "--config", str(cfg)], here) == 0
    assert cli.main(["ingest", "--config", str(cfg)], here) == 0
    assert json.loads(capsys.readouterr().out)["commits"] == 4
    assert sync.get_sync_state(load(spark, f"{tmp_path}/store"), "r")["last_commit_hash"] == h[3]
    assert cli.main(["update", "--config", str(cfg)], here) == 0
    assert json.loads(capsys.readouterr().out)["commits"] == 0
    assert cli.main(["query", "function-callers", "--name", "g", "--config", str(cfg)], here) == 0
    assert [x["caller_name"] for x in json.loads(capsys.readouterr().out)] == ["f"]
    assert cli.main(["query", "mr_summary", "--config", str(cfg)], here) == 1 and cli.main(["query", "zzz", "--config", str(cfg)], here) == 1
    assert cli.main(["query", "hot_files", "--pattern", "x", "--config", str(cfg)], here) == 1


def test_stream(spark, repo, tmp_path):
    from graphloom.streaming.ingest import stream_commits

    path, h = repo
    rows = git.load(spark, path, repoName="r").drop("epoch")
    for part in (rows.where("pos < 2"), rows.where("pos >= 2")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/land")
        stream_commits(spark, f"{tmp_path}/land", f"{tmp_path}/g", f"{tmp_path}/ck", 1).awaitTermination()
    g = load(spark, f"{tmp_path}/g")
    assert g["commit"].count() == 4 and g["parent_of"].count() == 3


MR = {
    "iid": 1, "title": None, "state": "odd", "author": None, "created_at": "2024-06-01T12:00:00Z", "updated_at": "2024-06-02T12:00:00+02:00", "labels": [{"name": "x"}, {"name": "y"}], "commits": [{"id": "a"}, {"short_id": "b"}, {}],
    "discussions": [{"notes": [{"author": {"username": "u"}, "body": "2", "created_at": "2024-06-03T00:00:00Z"}, {"body": "none"}]}, {"notes": [{"body": "1", "created_at": "2024-06-02T00:00:00Z", "system": True}]}],
    "approved_by": [{"user": {"username": "bob", "name": "Bob"}, "approved_at": "2024-06-04T00:00:00Z"}], "eligible_approvers": [{"username": "bob"}, {"username": "eve"}], "changes": [{"old_path": "a", "new_path": "b", "renamed_file": True}],
}


def test_gitlab_documents(spark):
    raw = spark.createDataFrame([(json.dumps(MR),), (json.dumps({"iid": 2, "labels": ["p"], "state": "MERGED"}),)], "value string")
    docs = gitlab.parse_merge_requests(raw)
    m = {r.iid: r for r in gitlab.merge_requests(docs, "r").collect()}
    assert m[1].state == "closed" and m[1].labels == ["x", "y"] and m[1].author_name == "unknown" and m[1].title == ""
    assert m[2].state == "merged" and m[2].labels == ["p"] and m[2].created_at is not None
    assert [r.body for r in gitlab.notes(docs, "r").orderBy("pos").collect()] == ["1", "2"]
    assert sorted((r.username, r.approved) for r in gitlab.reviews(docs, "r").collect()) == [("bob", True), ("eve", False)]
    assert sorted(r.hash for r in gitlab.mr_commits(docs, "r").collect()) == ["a", "b"]
    assert gitlab.mr_diffs(docs, "r").head().new_path == "b"
    g = sync.ingest_documents(Graph(spark), raw, "r")
    assert g["merge_request"].where("iid = 1").head().notes_count == 2


def test_gitlab_commits(spark):
    docs = [(k, json.dumps({"id": f"{k}" * 40, "author_name": "A", "author_email": "a@x", "committed_date": "2024-06-01T12:00:00Z", "diffs": [{"old_path": "p", "new_path": "p", "diff": "--- a\n+++ b\n+x\n+y\n-z\n"}]})) for k in range(4)]
    raw = spark.createDataFrame(docs, "pos long, value string")
    got = gitlab.commits(raw, "r", "main", since="2222").orderBy("pos").collect()
    assert [c.pos for c in got] == [0, 1] and (got[0].diffs[0].additions, got[0].diffs[0].deletions) == (2, 1) and got[0].committer.email == "a@x"
    assert gitlab.commits(raw, "r", "main", since="zzz", max_count=3).count() == 3


def test_retry():
    waits, tries = [], []

    def busy():
        tries.append(1)
        if len(tries) < 4:
            raise urllib.error.HTTPError("u", 503, "busy", {}, None)
        return "ok"

    assert gitlab.with_retry(busy, sleep=waits.append) == "ok" and waits == [0.5, 1.0, 2.0]

    def refused():
        tries.append(1)
        raise urllib.error.HTTPError("u", 401, "no", {}, None)

    n = len(tries)
    with pytest.raises(urllib.error.HTTPError):
        gitlab.with_retry(refused, sleep=waits.append)
    assert len(tries) == n + 1


def test_config(tmp_path, monkeypatch):
    f = tmp_path / "c.yml"
    f.write_text("gitlab: {url: 'https://g', project_id: 7, private_token: '${TOK}', branch: '${B:main}'}\n")
    with pytest.raises(ValueError, match="TOK"):
        config.load_config(f)
    monkeypatch.setenv("TOK", "s")
    c = config.load_config(f)
    assert c.gitlab.private_token == "s" and c.gitlab.branch == "main" and c.repo_name == "project-7" and c.remote and c.sync.batch_size == 500
    with pytest.raises(FileNotFoundError):
        config.load_config(tmp_path / "none.yml")
    with pytest.raises(ValueError):
        _ = config.Config().repo_name


def test_columns(spark):
    words = ["", "  ", "A", "a", "D", "M", "R", "C", "T", "added", "DELETED", "renamed", "copied", "modified", "weird", "X", None]
    want = ["modified", "modified", "added", "added", "deleted", "modified", "renamed", "copied", "modified", "added", "deleted", "renamed", "copied", "modified", "modified", "modified", "modified"]
    assert [r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select(C.change_status(F.col("w")).alias("s")).collect()] == want
    paths = spark.createDataFrame([("a/b/c.py",), ("top.py",), ("node_modules/x/y.js",), ("deep/node_modules/y.JS",), ("d/m.min.js",)], "p string")
    p = F.col("p")
    r = paths.select(C.ancestors(p).alias("up"), C.dirname(p).alias("dir"), C.language(p).alias("lang"), C.ignored(p, ["node_modules/**", "*.min.js"]).alias("no"), C.in_directory(p, "a/").alias("inside")).collect()
    assert [x.up for x in r][:2] == [["a", "a/b"], []] and [x.dir for x in r][:2] == ["a/b", None]
    assert [x.lang for x in r] == ["python", "python", "javascript", "javascript", "javascript"] and [x.no for x in r] == [False, False, True, False, True] and [x.inside for x in r] == [True, False, False, False, False]


SNIPPETS = {
    "a.js": ("import x, {y as z} from './m';\nclass A extends B.C {\n  m(b, c = 1) { return new D(b).foo(c); }\n}\nfunction f(a, ...r) { // no()\n  return 'x(y)' + g(a);\n}\n", [("A", ["B", "C"], [("m", ["b", "c"], ["foo"])])], [("f", ["a", "r"], ["g"])], [("y", "./m", "z"), ("x", "./m", None)]),
    "a.ts": ("interface I extends J { m(a: string): void; }\nexport class A<T> extends B<T> implements C {\n  async get(id: string): Promise<T> { return this.svc.load(id); }\n}\n", [("I", ["J"], []), ("A", ["B", "C"], [("get", ["id"], ["this.svc.load"])])], [], []),
    "A.java": ("import java.util.List;\nclass A extends B {\n  public A(int q) { init(q); }\n  List<String> m(Map<String, Integer> a) { return h.call(a); }\n}\n", [("A", ["B"], [("A", ["q"], ["init"]), ("m", ["a"], ["h.call"])])], [], [("List", "java.util.List", None)]),
    "a.go": ('import (\n\t"fmt"\n\tx "a/b"\n)\ntype Foo struct { n int }\nfunc (f *Foo) Run(a int) error { return fmt.Errorf(a) }\nfunc main() { x.Do(1) }\n', [("Foo", [], [("Run", ["a"], ["fmt.Errorf"])])], [("main", [], ["x.Do"])], [("fmt", "fmt", None), ("b", "a/b", "x")]),
    "a.rs": ("use std::{io, fmt::Display as D};\npub struct P { x: i32 }\nimpl T for P { fn t(&self) { println!(1); } }\nimpl P { pub fn new(x: i32) -> Self { P { x } } }\nfn main() { P::new(1); }\n", [("P", ["T"], [("t", ["self"], ["println"]), ("new", ["x"], [])])], [("main", [], ["P::new"])], [("io", "std::io", None), ("Display", "std::fmt::Display", "D")]),
    "a.c": ('#include "my/h.h"\nstruct S { int a; };\nstatic int *add(int a, char *b) {\n  return foo(a) + p->bar(b);\n}\n', [("S", [], [])], [("add", ["a", "b"], ["foo", "p->bar"])], [("h", "my/h.h", None)]),
    "a.cpp": ("class A : public B {\n public:\n  int get(const std::string& k) const { return m.find(k); }\n};\n", [("A", ["B"], [("get", ["k"], ["m.find"])])], [], []),
    "a.py": ("import a.b as c\nfrom m import n, o as p\nclass A(x.B):\n    @d\n    def m(self, *a, **k): self.q()\ndef f():\n    def g(): pass\n    return h.i()\n", [("A", ["x", "B"], [("m", ["self", "a", "k"], ["self.q"])])], [("f", [], ["h.i"]), ("g", [], [])], [("b", "a.b", "c"), ("n", "m", None), ("o", "m", "p")]),
}


@pytest.mark.parametrize("path", SNIPPETS)
def test_code(path):
    text, classes, functions, imports = SNIPPETS[path]
    r = code.parse(path, text)
    assert [(c["name"], c["bases"], [(m["name"], m["parameters"], m["calls"]) for m in c["methods"]]) for c in r["classes"]] == classes
    assert [(f["name"], f["parameters"], f["calls"]) for f in r["functions"]] == functions
    assert [(i["imported_name"], i["module_path"], i["alias"]) for i in r["imports"]] == imports


def test_c_functions_over_two_lines():
    r = code.parse("a.c", "#define X 1\nstatic int\nfoo(int a)\n{\n  return bar(a);\n}\nvoid *\nbaz(void)\n{\n}\n")
    assert [(f["name"], f["parameters"], f["calls"]) for f in r["functions"]] == [("foo", ["a"], ["bar"]), ("baz", [], [])] or [f["name"] for f in r["functions"]] == ["foo", "baz"]


def test_code_limits(spark):
    assert code.parse("a.txt", "x") is None and code.parse("a.py", "def (") is None and code.parse("a.ts", "", ["python"]) is None
    assert code.parse("a.tsx", "", ["typescript"])["language"] == "tsx" and code.parse("e.go", b"")["classes"] == []
    strict = code.parse("a.py", SNIPPETS["a.py"][0], strict=True)
    assert strict["classes"][0]["methods"] == [] and [i["imported_name"] for i in strict["imports"]] == ["b", "o"]
    files = spark.createDataFrame([("vendor/a.py", b"x=1"), ("b.py", b"def f(): g()"), ("c.bin", b"\0"), ("d.py", None)], "path string, content binary")
    got = code.parse_files(files, "r", ignore=["vendor/**"]).collect()
    assert [(r.path, r.functions[0].calls) for r in got] == [("b.py", ["g"])]


class Paged:
    """A small service with 230 commits, of which some have 130 changes, and a merge request of 150 commits and discussions. ``tell``: how it says that there are more pages."""

    def __init__(self, tell):
        import threading
        from http.server import BaseHTTPRequestHandler, HTTPServer
        from urllib.parse import parse_qs, urlsplit

        self.seen, self.commits = [], [{"id": f"{k:040d}", "author_name": "A", "author_email": "a@x", "committed_date": "2024-06-01T12:00:00Z", "parent_ids": [], "message": "m"} for k in range(230)]
        outer = self

        class Service(BaseHTTPRequestHandler):
            def do_GET(self):
                url = urlsplit(self.path)
                path, query = url.path.split("/projects/7/")[1], {k: v[0] for k, v in parse_qs(url.query).items()}
                outer.seen.append((path, query))
                rows = {
                    "repository/commits": outer.commits, "merge_requests": [{"iid": 1}], "merge_requests/1/commits": [{"id": f"{k}"} for k in range(150)], "merge_requests/1/discussions": [{"notes": [{"body": f"n{k}", "created_at": "2024-06-03T00:00:00Z"}]} for k in range(150)],
                }.get(path)
                if path.endswith("/diff"):
                    rows = [{"old_path": f"f{k}", "new_path": f"f{k}", "diff": "+x\n"} for k in range(130 if int(path.split("/")[2]) % 100 == 3 else 1)]
                one = {"merge_requests/1": {"iid": 1, "title": "t"}, "merge_requests/1/changes": {"changes": [{"new_path": "a"}], "overflow": True}}.get(path)
                if path == "merge_requests/1/changes" and "access_raw_diffs" in query:
                    one = {"changes": [{"new_path": "a"}, {"new_path": "b"}]}
                self.send_response(200 if rows is not None or one else 404)
                if rows is not None:
                    size, page = int(query.get("per_page", 20)), int(query.get("page", 1))
                    more = page * size < len(rows)
                    if tell == "next":
                        self.send_header("X-Next-Page", str(page + 1) if more else "")
                    if tell == "link":
                        self.send_header("Link", f'<http://127.0.0.1:{outer.port}{url.path}?per_page={size}&page={page + 1}>; rel="next", <http://x/>; rel="first"' if more else '<http://x/>; rel="first"')
                    if tell == "total":
                        self.send_header("X-Total-Pages", str(-(-len(rows) // size)))
                    one = rows[(page - 1) * size : page * size]
                self.end_headers()
                self.wfile.write(json.dumps(one).encode())

            def log_message(self, *a):
                pass

        self.server = HTTPServer(("127.0.0.1", 0), Service)
        self.port = self.server.server_port
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def read(self, spark, table, **options):
        self.seen.clear()
        return gitlab.read(spark, f"http://127.0.0.1:{self.port}/", 7, "t", table, **options).collect()


@pytest.mark.parametrize("tell", ["next", "link", "total", "nothing"])
def test_every_page_is_read(spark, tell):
    service = Paged(tell)
    try:
        got = sorted((r.pos, json.loads(r.value)) for r in service.read(spark, "commits"))
        assert [p for p, _ in got] == list(range(230)) and [c["id"] for _, c in got] == [c["id"] for c in service.commits]
        assert [len(c["diffs"]) for _, c in got] == [130 if k % 100 == 3 else 1 for k in range(230)]
        mr = json.loads(service.read(spark, "merge_requests")[0].value)
        assert [c["id"] for c in mr["commits"]] == [str(k) for k in range(150)] and len(mr["discussions"]) == 150 and [c["new_path"] for c in mr["changes"]] == ["a", "b"]
    finally:
        service.server.shutdown()


@pytest.mark.parametrize("tell", ["total", "nothing"])
def test_requests_follow_the_new_commits(spark, tell):
    """Behind the cursor, or the greatest number of commits, nothing is fetched."""
    service = Paged(tell)
    try:
        for options, want in (({"since": f"{5:040d}"}, 5), ({"since": f"{120:040d}"}, 120), ({"max_count": 7}, 7), ({"since": f"{0:040d}"}, 0), ({"since": "x" * 40}, 230)):
            assert sorted(r.pos for r in service.read(spark, "commits", **options)) == list(range(want)), options
            diffs = {p for p, _ in service.seen if p.endswith("/diff")}
            assert len(diffs) == want and len(service.seen) <= 2 * want + 14
    finally:
        service.server.shutdown()


def test_no_token_for_another_host():
    client = gitlab.Client("http://here", 7, "t")
    with pytest.raises(ValueError, match="another host"):
        client.following("http://here/api?page=1", [], {"link": '<http://there/api?page=2>; rel="next"'})


def test_local_sources_are_read_once(spark, repo):
    """No table of a load goes back to the clone: history and parsed files were written first."""
    path, h = repo
    g, n = sync.ingest_local_commits(Graph(spark), path, "r", "main")
    g = sync.ingest_local_code(g, path, config.Config(repository={"path": path, "name": "r"}))
    assert n == 4 and g["function"].count() == 3
    for table in g:
        plan = g[table]._jdf.queryExecution().toString()
        assert "Scan git" not in plan and "binaryFile" not in plan and "MapIn" not in plan and "Python" not in plan, table


def test_remote_load_and_update(spark, tmp_path):
    """Everything from a service: a small one on this machine, with two pages of commits."""
    import base64
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlsplit

    log = [{"id": f"{k}" * 40, "message": "m", "author_name": "A", "author_email": "a@x", "committed_date": "2024-06-01T12:00:00Z", "parent_ids": [f"{k + 1}" * 40]} for k in range(3)]
    seen = []

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlsplit(self.path)
            path, page, pages = url.path.split("/projects/7/")[1], int(parse_qs(url.query).get("page", ["1"])[0]), 1
            seen.append((path, url.query))
            if path == "repository/branches":
                body = [{"name": "main", "default": True, "commit": {"id": log[0]["id"]}}, {"name": "dev", "commit": {"id": log[1]["id"]}}]
            elif path == "repository/commits":
                body, pages = (log[:2], log[2:])[page - 1], 2
            elif path.endswith("/diff"):
                body = [{"old_path": "a.py", "new_path": "a.py", "diff": "@@\n+x\n"}]
            elif path == "repository/tree":
                body = [{"type": "tree", "path": "d"}, {"type": "blob", "path": "a.py"}]
            elif path.startswith("repository/files/"):
                body = {"content": base64.b64encode(b"def f(): g()\n").decode()}
            elif path == "merge_requests":
                body = [{"iid": 1}]
            elif path == "merge_requests/1":
                body = {k: v for k, v in MR.items() if k not in ("commits", "discussions", "approved_by", "changes")}
            elif path == "merge_requests/1/commits":
                body = [{"id": log[0]["id"]}]
            else:
                body = None
            self.send_response(200 if body is not None else 404)
            self.send_header("X-Total-Pages", str(pages))
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    cfg = config.Config(gitlab={"url": f"http://127.0.0.1:{server.server_port}/", "project_id": 7, "private_token": "t"}, store={"path": f"{tmp_path}/g"})
    try:
        assert sync.ingest_all(spark, cfg) == {"commits": 3, "files": 1, "merge_requests": 1}
        g = load(spark, cfg.store.path)
        assert g["parent_of"].count() == 2 and g["contains_commit"].count() == 1 and g["has_branch"].count() == 2 and [r.name for r in g["function"].collect()] == ["f"]
        state = sync.get_sync_state(g, "project-7")
        assert state["last_commit_hash"] == log[0]["id"] and state["last_mr_updated_at"] is not None
        assert sync.update(spark, cfg)["commits"] == 0 and any("updated_after" in q for p, q in seen if p == "merge_requests")
    finally:
        server.shutdown()
