"""Git history as a Spark data source.

``spark.read.format("git").options(path=..., table="commits").load()`` after
``register(spark)``. The driver lists the wanted revisions; each task reads one slice of
them with one ``git log``. The repository must be on a file system that all executors see.

Options: path, table (commits, branches or files), branch, since, maxCount, slice, repoName.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import functions as F

from graphloom.functions.columns import change_status

_SCHEMAS = {
    "commits": "repo_name string, pos bigint, hash string, short_hash string, message string, author struct<name:string,email:string>, committer struct<name:string,email:string>, epoch bigint, parent_hashes array<string>, "
    "diffs array<struct<path:string,old_path:string,status:string,additions:bigint,deletions:bigint>>, branch string",
    "branches": "repo_name string, name string, is_default boolean, head_commit_hash string",
    "files": "repo_name string, path string, size bigint",
}
_FORMAT = "%x1e%H%x1f%P%x1f%an%x1f%ae%x1f%cn%x1f%ce%x1f%ct%x1f%B%x1d"


class GitError(RuntimeError):
    pass


def run(path: str, *args: str, stdin: str | None = None) -> str:
    done = subprocess.run(["git", "-c", "safe.directory=*", "-c", "core.quotePath=false", "-C", path, *args], input=stdin, capture_output=True, text=True, errors="replace")
    if done.returncode:
        raise GitError(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout


def check(path: str) -> None:
    """An error unless ``path`` is a repository (bare ones are)."""
    run(path, "rev-parse", "--git-dir")


def _is_empty(path: str) -> bool:
    return not run(path, "for-each-ref", "--count=1").strip()


def revisions(path: str, branch: str | None = None, since: str | None = None, max_count: int | None = None) -> list[str]:
    """Hashes newest first: all of the branch (HEAD by default), or those since a commit; an unknown one means all."""
    check(path)
    if _is_empty(path):
        return []
    tip = branch or "HEAD"
    span = tip
    if since:
        try:
            run(path, "rev-parse", "--verify", "--quiet", f"{since}^{{commit}}")
            span = f"{since}..{tip}"
        except GitError:
            pass
    limit = [f"--max-count={int(max_count)}"] if max_count is not None else []
    return run(path, "rev-list", *limit, span, "--").split()


def branches(path: str, default: str = "main") -> list[tuple[str, bool, str]]:
    """(name, is_default, head) sorted by name; the default is the one asked for, else main, master, the checked-out one."""
    check(path)
    heads = sorted(tuple(line.split(" ", 1)) for line in run(path, "for-each-ref", "--format=%(refname:short) %(objectname)", "refs/heads").splitlines())
    names = [n for n, _ in heads]
    try:
        active = run(path, "symbolic-ref", "--short", "HEAD").strip()
    except GitError:
        active = ""
    chosen = next((n for n in (default, "main", "master", active) if n in names), None)
    return [(n, n == chosen, h) for n, h in heads]


def _changes(text: str) -> list[dict]:
    """Changes of one commit from NUL-separated raw and numstat entries."""
    parts = text.split("\0")
    found: dict[str, dict] = {}
    i = 0
    while i < len(parts):
        p = parts[i].lstrip("\n")
        if p.startswith(":"):
            letter = p.rsplit(" ", 1)[-1][:1]
            old, path = (parts[i + 1], parts[i + 2]) if letter in "RC" else (None, parts[i + 1])
            found[path] = {"path": path, "old_path": old, "letter": letter, "additions": 0, "deletions": 0}
            i += 3 if letter in "RC" else 2
        elif p.count("\t") >= 2:
            plus, minus, path = p.split("\t", 2)
            if not path:
                path, step = parts[i + 2], 3
            else:
                step = 1
            if path in found and plus != "-":
                found[path]["additions"], found[path]["deletions"] = int(plus), int(minus)
            i += step
        else:
            i += 1
    return list(found.values())


_LETTERS = {"A": "added", "D": "deleted", "R": "renamed", "C": "copied"}


def read_commits(path: str, hashes: list[str]) -> Iterator[tuple]:
    """(hash, message, author, committer, epoch, parents, changes); a merge is compared to its first parent."""
    if not hashes:
        return
    text = run(path, "log", "--no-walk=unsorted", "--stdin", f"--format={_FORMAT}", "--raw", "--numstat", "-z", "-M", "-C", "--no-abbrev", "--diff-merges=first-parent", stdin="\n".join(hashes) + "\n")
    for record in text.split("\x1e")[1:]:
        head, _, tail = record.partition("\x1d")
        sha, parents, an, ae, cn, ce, when, message = head.split("\x1f", 7)
        diffs = [(c["path"], c["old_path"] if c["old_path"] != c["path"] else None, _LETTERS.get(c["letter"], "modified"), c["additions"], c["deletions"]) for c in _changes(tail)]
        yield sha, message.strip(), (an, ae), (cn, ce), int(when), parents.split(), diffs


class _Slice(InputPartition):
    def __init__(self, start: int, hashes: list[str]):
        self.start, self.hashes = start, hashes


class GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.path = self.options.get("path") or ""
        self.table = self.options.get("table", "commits")
        self.repo = self.options.get("reponame") or self.options.get("repoName") or self.path.rstrip("/").rsplit("/", 1)[-1]

    def _option(self, name: str) -> str | None:
        return self.options.get(name) or self.options.get(name.lower())

    def partitions(self) -> list[InputPartition]:
        if self.table != "commits":
            check(self.path)
            return [_Slice(0, [])]
        most = self._option("maxCount")
        every = revisions(self.path, self._option("branch"), self._option("since"), int(most) if most else None)
        n = int(self._option("slice") or 1000)
        return [_Slice(k, every[k : k + n]) for k in range(0, len(every), n)] or [_Slice(0, [])]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        if self.table == "branches":
            yield from ((self.repo, *b) for b in branches(self.path, self._option("branch") or "main"))
        elif self.table == "files":
            if not _is_empty(self.path):
                for line in run(self.path, "ls-tree", "-r", "-l", "-z", self._option("branch") or "HEAD").split("\0"):
                    meta, _, path = line.partition("\t")
                    fields = meta.split()
                    if len(fields) == 4 and fields[1] == "blob":
                        yield self.repo, path, int(fields[3])
        else:
            branch = self._option("branch")
            for k, (sha, message, author, committer, when, parents, diffs) in enumerate(read_commits(self.path, partition.hashes)):
                yield self.repo, partition.start + k, sha, sha[:8], message, author, committer, when, parents, diffs, branch


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return _SCHEMAS[self.options.get("table", "commits")]

    def reader(self, schema) -> GitReader:
        return GitReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitSource)


def load(spark: SparkSession, path: str, table: str = "commits", **options) -> DataFrame:
    """A table of a repository; commits have the extraction record's columns."""
    register(spark)
    reader = spark.read.format("git").option("path", path).option("table", table)
    for key, value in options.items():
        if value is not None:
            reader = reader.option(key, str(value))
    df = reader.load()
    if table == "commits":
        df = df.withColumn("timestamp", F.timestamp_seconds("epoch")).drop("epoch")
    return df


__all__ = ["GitSource", "branches", "change_status", "check", "load", "read_commits", "register", "revisions"]
