"""Command line: ``python -m graphloom schema|ingest|update|query``."""

from __future__ import annotations

import argparse
import sys

from . import graph as store
from . import schema, sync
from .api import SPECS, RepoAPI, to_json
from .config import load_config


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    s = commands.add_parser("schema", help="init, verify or drop the graph's tables")
    s.add_argument("action", choices=["init", "verify", "drop"])
    s.add_argument("--yes", action="store_true", help="drop without asking")
    q = commands.add_parser("query", help="run a named query and print JSON")
    q.add_argument("name")
    for option in ("file-path", "function-name", "class-name", "author-email", "directory", "pattern"):
        q.add_argument(f"--{option}")
    q.add_argument("--name", dest="short_name", help="function or class name")
    for option in ("mr-iid", "days", "limit"):
        q.add_argument(f"--{option}", type=int)
    for p in (s, q, commands.add_parser("ingest", help="full load"), commands.add_parser("update", help="load what is new")):
        p.add_argument("--config", required=True)
    return top


def fail(message: str) -> int:
    print(message, file=sys.stderr)
    return 1


def run_query(args: argparse.Namespace, cfg, session) -> int:
    name = args.name.replace("-", "_")
    if name not in SPECS:
        return fail(f"unknown query {args.name!r}; known: {', '.join(RepoAPI.QUERIES)}")
    options = {k: v for k, v in vars(args).items() if k not in ("command", "config", "name", "short_name") and v is not None}
    for k in SPECS[name].needs:
        if k in ("function_name", "class_name") and not options.get(k) and args.short_name:
            options[k] = args.short_name
    missing = [k for k in SPECS[name].needs if options.get(k) in (None, "")]
    if missing:
        return fail(f"query {name!r} needs: {', '.join(missing)}")
    api = RepoAPI.open(session(), cfg.store.path, cfg.repo_name)
    try:
        print(to_json(api.query(name, **options)))
    except (TypeError, ValueError) as e:
        return fail(f"query {name!r}: {e}")
    return 0


def main(argv: list[str] | None = None, session=None) -> int:
    args = parser().parse_args(argv)
    cfg = load_config(args.config)
    if session is None:
        from pyspark.sql import SparkSession

        session = lambda: SparkSession.builder.appName("graphloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "query":
        return run_query(args, cfg, session)
    spark = session()
    if args.command == "schema":
        if args.action == "init":
            store.initialize(spark, cfg.store.path)
            return 0
        if args.action == "verify":
            found = schema.verify(store.load(spark, cfg.store.path))
            print(to_json(found))
            return 0 if all(found.values()) else 1
        if not args.yes and input("Drop the graph's views? [y/N] ").strip().lower() not in ("y", "yes"):
            return 1
        store.drop_catalog(spark)
        return 0
    try:
        done = sync.ingest_all(spark, cfg) if args.command == "ingest" else sync.update(spark, cfg)
    except (ValueError, RuntimeError) as e:
        return fail(str(e))
    print(to_json(done))
    return 0
