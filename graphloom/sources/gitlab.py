"""Merge requests of a GitLab project: REST pages as a data source, and records from raw JSON.

Fetching and shaping are apart. ``PagesSource`` returns raw JSON documents, a task for each
page; the functions below turn such documents (from the service or from a dump of JSON
lines) into the tables that ingestion takes, with DataFrame operations only.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphloom.functions.columns import iso_timestamp, line_stats, mr_state

PAGE = 100
ATTEMPTS = 8
FIRST_WAIT, MOST_WAIT = 0.5, 30.0
_AGAIN = {429, 500, 502, 503, 504}

_USER = "STRUCT<username:STRING,name:STRING,email:STRING>"
MR_JSON = (
    f"iid BIGINT, title STRING, description STRING, state STRING, source_branch STRING, target_branch STRING, author {_USER}, created_at STRING, updated_at STRING, merged_at STRING, closed_at STRING, web_url STRING, labels STRING,"
    f" commits ARRAY<STRUCT<id:STRING,short_id:STRING>>, discussions ARRAY<STRUCT<notes:ARRAY<STRUCT<author:{_USER},body:STRING,created_at:STRING,system:BOOLEAN,noteable_type:STRING>>>>,"
    f" approved_by ARRAY<STRUCT<user:{_USER},approved_at:STRING>>, eligible_approvers ARRAY<{_USER}>, changes ARRAY<STRUCT<old_path:STRING,new_path:STRING,new_file:BOOLEAN,renamed_file:BOOLEAN,deleted_file:BOOLEAN>>"
)
COMMIT_JSON = (
    "id STRING, short_id STRING, message STRING, author_name STRING, author_email STRING, committer_name STRING, committer_email STRING, committed_date STRING, parent_ids ARRAY<STRING>,"
    " diffs ARRAY<STRUCT<old_path:STRING,new_path:STRING,new_file:BOOLEAN,renamed_file:BOOLEAN,deleted_file:BOOLEAN,diff:STRING>>"
)


def normalize_url(address: str) -> str:
    """Without slashes at the end."""
    return address.rstrip("/")


def with_retry(call: Callable, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep):
    """The call's result; connection errors and busy answers are tried again after 0.5 s, doubled up to 30 s. A refusal (401, 403) fails at once."""
    wait = FIRST_WAIT
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if e.code not in _AGAIN or attempt == attempts:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if attempt == attempts:
                raise
        sleep(wait)
        wait = min(wait * 2, MOST_WAIT)


class Client:
    """REST v4 of one project."""

    def __init__(self, address: str, project: int | str, token: str, opener: Callable | None = None):
        self.base = f"{normalize_url(address)}/api/v4/projects/{urllib.parse.quote(str(project), safe='')}"
        self.token, self.opener = token, opener or urllib.request.urlopen

    def url(self, path: str, **params) -> str:
        query = urllib.parse.urlencode({k: v for k, v in params.items() if v is not None})
        return f"{self.base}/{path}" + (f"?{query}" if query else "")

    def fetch(self, url: str) -> tuple[object, dict]:
        """Decoded JSON and headers with lower-case names."""
        request = urllib.request.Request(url, headers={"PRIVATE-TOKEN": self.token})

        def call():
            with self.opener(request, timeout=60) as answer:
                return json.loads(answer.read()), {k.lower(): v for k, v in dict(answer.headers).items()}

        return with_retry(call)

    def get(self, path: str, **params) -> tuple[object, dict]:
        return self.fetch(self.url(path, **params))

    def following(self, url: str, rows: list, headers: dict) -> str | None:
        """The next page's address, None after the last one. The service tells by a link, by the next page's number or by how many there are; where it tells nothing, a page that isn't full is the last."""
        links = dict(reversed(x) for x in re.findall(r'<([^>]*)>;\s*rel="?(\w+)"?', headers.get("link", "")))
        if "next" in links:
            if urllib.parse.urlsplit(links["next"])[:2] != urllib.parse.urlsplit(self.base)[:2]:
                raise ValueError("the next page is on another host")  # the token doesn't go there
            return links["next"]
        parts = urllib.parse.urlsplit(url)
        query = dict(urllib.parse.parse_qsl(parts.query))
        page = int(query.get("page", 1))
        if "x-next-page" in headers:
            page = int(headers["x-next-page"] or 0)
        elif headers.get("x-total-pages"):
            page = page + 1 if page < int(headers["x-total-pages"]) else 0
        else:
            page = page + 1 if len(rows) >= PAGE and "link" not in headers else 0
        return urllib.parse.urlunsplit(parts._replace(query=urllib.parse.urlencode(query | {"page": page}))) if page else None

    def walk(self, path: str, **params) -> Iterator[tuple[str, list]]:
        """(address, entries) of each page of a listing, to its end."""
        url = self.url(path, per_page=PAGE, page=1, **params)
        while url:
            rows, headers = self.fetch(url)
            yield url, rows
            url = self.following(url, rows, headers)

    def every(self, path: str, **params) -> list:
        """All entries of a listing; none if it isn't there."""
        try:
            return [row for _, rows in self.walk(path, **params) for row in rows]
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return []
            raise

    def merge_request(self, iid: int) -> dict:
        """One merge request with its commits, discussions, approvals and changes; a missing part is empty."""
        mr = dict(self.get(f"merge_requests/{iid}")[0])
        mr["commits"] = self.every(f"merge_requests/{iid}/commits")
        mr["discussions"] = self.every(f"merge_requests/{iid}/discussions")
        approvals = self.optional(f"merge_requests/{iid}/approvals", {})
        mr["approved_by"] = approvals.get("approved_by") or []
        rules = self.optional(f"merge_requests/{iid}/approval_state", {}).get("rules") or []
        mr["eligible_approvers"] = (approvals.get("suggested_approvers") or []) + [u for r in rules for u in r.get("eligible_approvers") or r.get("users") or []]
        found = self.optional(f"merge_requests/{iid}/changes", {})
        if found.get("overflow"):  # cut short: ask for all of it
            found = self.optional(f"merge_requests/{iid}/changes?access_raw_diffs=true", found)
        mr["changes"] = found.get("changes") or []
        return mr

    def head(self, branch: str | None) -> str | None:
        """The commit a branch points to, so that its listing doesn't move while it is read; the name itself if there is no such branch."""
        found = branch and self.optional(f"repository/branches/{urllib.parse.quote(branch, safe='')}", None)
        return (found or {}).get("commit", {}).get("id") or branch

    def optional(self, path: str, default):
        try:
            return self.get(path)[0]
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return default
            raise

    def file_content(self, path: str, ref: str) -> str | None:
        import base64

        found = self.optional(f"repository/files/{urllib.parse.quote(path, safe='')}?ref={urllib.parse.quote(ref)}", None)
        return None if found is None else base64.b64decode(found["content"]).decode("utf-8", "replace")


class _Page(InputPartition):
    """A page by address, the position of its first entry, and how many of its entries are wanted (None: all)."""

    def __init__(self, url: str, first: int, take: int | None):
        self.url, self.first, self.take = url, first, take


_TABLES = {"merge_requests": "value string", "commits": "pos bigint, value string", "files": "path string, content binary"}
_PATHS = {"merge_requests": "merge_requests", "commits": "repository/commits", "files": "repository/tree"}


class PagesReader(DataSourceReader):
    """A task for each page of the listing; it fetches what belongs to the page's entries.

    The driver walks the listing only where it must: to find its end if the service doesn't
    tell the number of pages, or to stop at the cursor or the greatest number of commits.
    Nothing of what lies behind is fetched.
    """

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.table = self.options.get("table", "merge_requests")

    def _client(self) -> Client:
        o = self.options
        return Client(o["url"], o.get("projectid") or o["projectId"], o["token"])

    def _params(self) -> dict:
        o = self.options
        if self.table == "commits":
            return {"ref_name": self._client().head(o.get("branch"))}
        if self.table == "files":
            return {"ref": o.get("branch"), "recursive": "true"}
        order = o.get("order_by", "updated_at")
        return {"state": o.get("state"), "updated_after": o.get("updated_after"), "target_branch": o.get("target_branch"), "order_by": order if order in ("created_at", "updated_at") else "updated_at", "sort": "desc"}

    def partitions(self) -> list[InputPartition]:
        client, path, params = self._client(), _PATHS[self.table], self._params()
        since, most = self.options.get("since"), self.options.get("max_count")
        most = int(most) if most is not None else None
        if since is None and most is None:
            total = client.get(path, per_page=PAGE, page=1, **params)[1].get("x-total-pages")
            if total:
                return [_Page(client.url(path, per_page=PAGE, page=k, **params), (k - 1) * PAGE, None) for k in range(1, int(total) + 1)]
        out: list[InputPartition] = []
        seen = 0
        for url, rows in client.walk(path, **params):
            stop = next((k for k, row in enumerate(rows) if since and str(row.get("id", "")).startswith(since)), None)
            take = len(rows) if stop is None else stop
            take = take if most is None else min(take, most - seen)
            if take:
                out.append(_Page(url, seen, take))
            seen += take
            if stop is not None or seen == most:
                break
        return out or [_Page("", 0, 0)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        client = self._client()
        rows = client.fetch(partition.url)[0] if partition.url else []
        for k, row in enumerate(rows[: partition.take]):
            if self.table == "merge_requests":
                yield (json.dumps(client.merge_request(row["iid"])),)
            elif self.table == "commits":
                yield partition.first + k, json.dumps({**row, "diffs": client.every(f"repository/commits/{row['id']}/diff")})
            elif row.get("type") == "blob":
                text = client.file_content(row["path"], self.options.get("branch") or "HEAD")
                if text is not None:
                    yield row["path"], text.encode()


class PagesSource(DataSource):
    """Options: url, projectId, token, table (merge_requests, commits or files), branch, for commits since (the cursor: a hash) and max_count, and for merge requests the filters state, updated_after, target_branch, order_by, which the service applies."""

    @classmethod
    def name(cls) -> str:
        return "gitlab"

    def schema(self) -> str:
        return _TABLES[self.options.get("table", "merge_requests")]

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagesSource)


def read(spark: SparkSession, address: str, project: int | str, token: str, table: str = "merge_requests", **options) -> DataFrame:
    """A table of the service; options that are None aren't given."""
    register(spark)
    reader = spark.read.format("gitlab").option("url", address).option("projectId", str(project)).option("token", token).option("table", table)
    for key, value in options.items():
        if value is not None:
            reader = reader.option(key, str(value))
    return reader.load()


def branches(client: Client, default: str | None = None) -> list[tuple[str, bool, str]]:
    """(name, is_default, head) sorted by name; the default is the service's own unless one is asked for."""
    found = client.every("repository/branches")
    return sorted((b["name"], b["name"] == default if default else bool(b.get("default")), b["commit"]["id"]) for b in found)


def parse_merge_requests(raw: DataFrame) -> DataFrame:
    """``value`` strings to typed documents. Labels may be strings or objects with a name, so they stay JSON here."""
    return raw.select(F.from_json("value", MR_JSON).alias("m")).select("m.*")


def _label_names(labels):
    named = F.from_json(labels, "ARRAY<STRUCT<name:STRING>>")
    plain = F.from_json(labels, "ARRAY<STRING>")
    return F.when(labels.rlike(r'^\s*\[\s*\{'), F.transform(named, lambda x: x["name"])).otherwise(F.coalesce(plain, F.array().cast("array<string>")))


def merge_requests(docs: DataFrame, repo_name: str) -> DataFrame:
    """Rows for ingestion, with pos by update time."""
    t = lambda c: iso_timestamp(F.col(c)).alias(c)
    return docs.where("iid IS NOT NULL").select(
        "iid", F.lit(repo_name).alias("repo_name"), F.coalesce("title", F.lit("")).alias("title"), "description", mr_state(F.col("state")).alias("state"), "source_branch", "target_branch", F.coalesce("author.name", F.lit("unknown")).alias("author_name"),
        F.coalesce("author.username", F.lit("unknown")).alias("author_username"), F.coalesce(iso_timestamp(F.col("created_at")), F.current_timestamp()).alias("created_at"), t("updated_at"), t("merged_at"), t("closed_at"), "web_url", _label_names(F.col("labels")).alias("labels"),
        F.coalesce(F.unix_micros(iso_timestamp(F.col("updated_at"))), F.lit(0)).alias("pos"),
    )


def mr_commits(docs: DataFrame, repo_name: str) -> DataFrame:
    return docs.select("iid", F.lit(repo_name).alias("repo_name"), F.explode("commits").alias("c")).select("iid", "repo_name", F.coalesce("c.id", "c.short_id").alias("hash")).where("hash IS NOT NULL")


def notes(docs: DataFrame, repo_name: str) -> DataFrame:
    """Notes of all discussions in order of time; one without time is dropped."""
    flat = docs.select("iid", F.posexplode("discussions").alias("i", "d")).select("iid", "i", F.posexplode("d.notes").alias("j", "n"))
    when = iso_timestamp(F.col("n.created_at"))
    from pyspark.sql import Window

    rows = flat.select("iid", "i", "j", F.col("n.author.username").alias("author_username"), F.col("n.author.name").alias("author_name"), F.col("n.body").alias("body"), when.alias("created_at"), F.coalesce("n.system", F.lit(False)).alias("is_system"), F.col("n.noteable_type").alias("noteable_type")).where("created_at IS NOT NULL")
    pos = F.row_number().over(Window.partitionBy("iid").orderBy("created_at", "i", "j")) - 1
    return rows.select("iid", F.lit(repo_name).alias("repo_name"), pos.cast("bigint").alias("pos"), "author_username", "author_name", "body", "created_at", "is_system", "noteable_type")


def reviews(docs: DataFrame, repo_name: str) -> DataFrame:
    """One row for each reviewer of a merge request: approved if among approved_by, with that list's fields."""
    yes = docs.select("iid", F.explode("approved_by").alias("a")).select("iid", "a.user.*", iso_timestamp(F.col("a.approved_at")).alias("created_at"), F.lit(True).alias("approved"))
    no = docs.select("iid", F.explode("eligible_approvers").alias("a")).select("iid", "a.*", F.lit(None).cast("timestamp").alias("created_at"), F.lit(False).alias("approved"))
    from graphloom.operators.upsert import last_wins

    rows = last_wins(yes.unionByName(no).where("username IS NOT NULL"), ["iid", "username"], ["approved", "created_at", "name", "email"])
    return rows.withColumn("repo_name", F.lit(repo_name)).withColumn("pos", F.col("iid"))


def mr_diffs(docs: DataFrame, repo_name: str) -> DataFrame:
    return docs.select("iid", F.lit(repo_name).alias("repo_name"), F.explode("changes").alias("c")).select("iid", "repo_name", "c.*")


def commits(raw: DataFrame, repo_name: str, branch: str, since: str | None = None, max_count: int | None = None) -> DataFrame:
    """Commit records from ``pos`` (newest first) and ``value``; those before ``since`` in that order, at most ``max_count``."""
    c = raw.select("pos", F.from_json("value", COMMIT_JSON).alias("c")).select("pos", "c.*")
    if since:
        stop = c.where(F.col("id").startswith(since)).agg(F.min("pos")).head()[0]
        if stop is not None:
            c = c.where(F.col("pos") < stop)
    if max_count is not None:
        c = c.orderBy("pos").limit(max_count)

    def change(d):
        plus, minus = line_stats(d["diff"])
        status = F.when(d["new_file"], "added").when(d["deleted_file"], "deleted").when(d["renamed_file"], "renamed").otherwise("modified")
        return F.struct(F.coalesce(d["new_path"], d["old_path"]).alias("path"), F.when(d["renamed_file"], d["old_path"]).alias("old_path"), status.alias("status"), plus.alias("additions"), minus.alias("deletions"))

    return c.select(
        F.lit(repo_name).alias("repo_name"), "pos", F.col("id").alias("hash"), F.substring("id", 1, 8).alias("short_hash"), "message", F.struct(F.col("author_name").alias("name"), F.col("author_email").alias("email")).alias("author"),
        F.struct(F.coalesce("committer_name", "author_name").alias("name"), F.coalesce("committer_email", "author_email").alias("email")).alias("committer"), iso_timestamp(F.col("committed_date")).alias("timestamp"), F.col("parent_ids").alias("parent_hashes"),
        F.transform("diffs", change).alias("diffs"), F.lit(branch).alias("branch"),
    )
