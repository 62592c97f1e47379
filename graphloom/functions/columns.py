"""Column expressions shared by sources, ingestion and queries."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIRST = {"A": "added", "D": "deleted", "M": "modified", "R": "renamed", "C": "copied", "T": "modified"}


def change_status(raw: Column) -> Column:
    """Status of a change by the first letter of its raw word or code; empty and unknown ones are 'modified'."""
    letters = F.create_map(*[F.lit(x) for kv in _FIRST.items() for x in kv])
    return F.coalesce(F.try_element_at(letters, F.upper(F.substring(F.trim(raw), 1, 1))), F.lit("modified"))


def short_hash(h: Column) -> Column:
    return F.substring(h, 1, 8)


def parts(path: Column) -> Column:
    """Non-empty segments of a path."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def ancestors(path: Column) -> Column:
    """Directories above a file from the outermost in; empty for a top-level file."""
    seg = parts(path)
    return F.when(F.size(seg) > 1, F.transform(F.sequence(F.lit(1), F.size(seg) - 1), lambda k: F.array_join(F.slice(seg, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def dirname(path: Column) -> Column:
    """All but the last segment; null for a top-level file."""
    seg = F.split(path, "/")
    return F.when(F.size(seg) > 1, F.array_join(F.slice(seg, 1, F.greatest(F.size(seg) - 1, F.lit(1))), "/"))


def module_root(path: Column) -> Column:
    return F.when((path.isNotNull()) & (path != ""), F.split(path, "/").getItem(0))


def in_directory(path: Column, directory: str | None) -> Column:
    """Whether a path is a directory or below it; one trailing slash of the directory is ignored, and none means all."""
    if not directory:
        return F.lit(True)
    p = re.sub("/$", "", directory)
    return (path == p) | path.startswith(p + "/")


def contains_ignoring_case(text: Column, pattern: str) -> Column:
    return F.lower(text).contains(pattern.lower())


def iso_timestamp(text: Column) -> Column:
    """ISO 8601 with Z or an offset; without one it is UTC (the session's zone)."""
    return F.try_to_timestamp(text)


def glob_regex(patterns: list[str]) -> str:
    """A regular expression that matches a full path or base name by any of the globs; ``*`` crosses slashes."""
    return "|".join(f"(?:^{fnmatch.translate(p).replace(chr(92) + 'Z', '$').replace(chr(92) + 'z', '$')})" for p in patterns) or "(?!)"


def ignored(path: Column, patterns: list[str]) -> Column:
    rx = glob_regex(patterns)
    return path.rlike(rx) | F.element_at(F.split(path, "/"), -1).rlike(rx)


_ENDINGS = {
    "python": "py",
    "javascript": "js mjs cjs",
    "typescript": "ts",
    "tsx": "tsx",
    "java": "java",
    "go": "go",
    "rust": "rs",
    "c": "c h",
    "cpp": "cpp cc cxx hpp hh hxx h++ inl ipp",
}
LANGUAGES = {f".{e}": name for name, endings in _ENDINGS.items() for e in endings.split()}


def language(path: Column) -> Column:
    """Language by the lower-cased ending, null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)))


def line_stats(diff: Column) -> tuple[Column, Column]:
    """Added and deleted lines of a unified diff, without its header lines."""
    lines = F.split(F.coalesce(diff, F.lit("")), "\n")
    plus = F.size(F.filter(lines, lambda x: x.startswith("+") & ~x.startswith("+++"))).cast("bigint")
    minus = F.size(F.filter(lines, lambda x: x.startswith("-") & ~x.startswith("---"))).cast("bigint")
    return plus, minus


MR_STATES = ["opened", "closed", "merged", "locked"]


def mr_state(raw: Column) -> Column:
    """A known state in lower case; any other is 'closed'."""
    low = F.lower(F.trim(raw))
    return F.when(low.isin(MR_STATES), low).otherwise("closed")
