"""Extraction inputs made from the test tables: source files of nine languages and merge-request documents, with the records that they must give.

A template has ``{k}``, a part's number. The SQL side never sees a source file: it states what
the parser must find in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.columns import change_status
from graphloom.sources import code, gitlab

#: language -> (ending, source, what is in it as (kind, name, bases or parameters, calls or module))
LANGUAGES: dict[str, tuple[str, str, list[tuple[str, str, str, str]]]] = {
    "python": (
        "py",
        "import lib{k}.sub as s\n\nclass C{k}(Base{k}):\n    def m{k}(self, a):\n        return g{k}(a)\n\ndef f{k}(x, y):\n    return h{k}(x)\n",
        [("class", "C{k}", "Base{k}", ""), ("method", "C{k}.m{k}", "self,a", "g{k}"), ("function", "f{k}", "x,y", "h{k}"), ("import", "sub", "s", "lib{k}.sub")],
    ),
    "javascript": (
        "js",
        "import {a{k}} from './m{k}';\nclass C{k} extends Base{k} {\n  m{k}(a) { return g{k}(a); }\n}\nfunction f{k}(x, y) { // not{k}()\n  return 'no{k}(1)' + h{k}(x);\n}\n",
        [("class", "C{k}", "Base{k}", ""), ("method", "C{k}.m{k}", "a", "g{k}"), ("function", "f{k}", "x,y", "h{k}"), ("import", "a{k}", "", "./m{k}")],
    ),
    "typescript": (
        "ts",
        "export class C{k} extends Base{k} {\n  m{k}(a: number): number { return g{k}(a); }\n}\nfunction f{k}(x: string, y: string): void { h{k}(x); }\n",
        [("class", "C{k}", "Base{k}", ""), ("method", "C{k}.m{k}", "a", "g{k}"), ("function", "f{k}", "x,y", "h{k}")],
    ),
    "tsx": ("tsx", "function f{k}(x: string): string { return h{k}(x); }\n", [("function", "f{k}", "x", "h{k}")]),
    "java": (
        "java",
        "import lib{k}.Sub;\nclass C{k} extends Base{k} {\n  public int m{k}(int a) { return g{k}(a); }\n}\n",
        [("class", "C{k}", "Base{k}", ""), ("method", "C{k}.m{k}", "a", "g{k}"), ("import", "Sub", "", "lib{k}.Sub")],
    ),
    "go": (
        "go",
        "type C{k} struct { n int }\nfunc (c *C{k}) M{k}(a int) int { return g{k}(a) }\nfunc F{k}(x int) int { return h{k}(x) }\n",
        [("class", "C{k}", "", ""), ("method", "C{k}.M{k}", "a", "g{k}"), ("function", "F{k}", "x", "h{k}")],
    ),
    "rust": (
        "rs",
        "use std::io{k};\npub struct C{k} { n: i32 }\nimpl C{k} { fn m{k}(&self, a: i32) -> i32 { g{k}(a) } }\nfn f{k}(x: i32) -> i32 { h{k}(x) }\n",
        [("class", "C{k}", "", ""), ("method", "C{k}.m{k}", "self,a", "g{k}"), ("function", "f{k}", "x", "h{k}"), ("import", "io{k}", "", "std::io{k}")],
    ),
    "c": ("c", '#include "my/h{k}.h"\nstatic int\nf{k}(int x, char *y)\n{\n  return h{k}(x);\n}\n', [("function", "f{k}", "x,y", "h{k}"), ("import", "h{k}", "", "my/h{k}.h")]),
    "cpp": (
        "cpp",
        "class C{k} : public Base{k} {\n public:\n  int m{k}(int a) const { return g{k}(a); }\n};\nint f{k}(int x) { return h{k}(x); }\n",
        [("class", "C{k}", "Base{k}", ""), ("method", "C{k}.m{k}", "a", "g{k}"), ("function", "f{k}", "x", "h{k}")],
    ),
}


FILES_PER_TASK, MOST_TASKS = 5000, 10_000


def parse(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    """(path, kind, name, list, other) of all symbols in one file for each part."""
    ending, source, _ = LANGUAGES[language]
    key = F.col("p_partkey").cast("string")
    before, *rest = source.split("{k}")
    text = F.concat(F.lit(before), *[x for piece in rest for x in (key, F.lit(piece))])
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    # the table is a few MB, which Spark reads in one task or two: as many as the files are worth
    parts = parts.repartition(min(MOST_TASKS, parts.count() // FILES_PER_TASK + 1), "p_partkey")
    files = parts.select(F.concat(F.lit("src/d"), key, F.lit(f".{ending}")).alias("path"), text.cast("binary").alias("content"))
    r = code.parse_files(files, "r")
    joined = lambda c: F.array_join(c, ",")
    none = F.lit("")
    row = lambda kind, name, items, other: F.struct(F.lit(kind).alias("kind"), name.alias("name"), items.alias("list"), other.alias("other"))
    as_row = lambda kind: lambda f: row(kind, f["qualified_name"], joined(f["parameters"]), joined(f["calls"]))
    # all kinds in one list: as a union of four frames each file would be parsed four times
    found = F.concat(
        F.transform("classes", lambda c: row("class", c["qualified_name"], joined(c["bases"]), none)), F.transform(F.flatten(F.transform("classes", lambda c: c["methods"])), as_row("method")), F.transform("functions", as_row("function")),
        F.transform("imports", lambda i: row("import", i["imported_name"], F.coalesce(i["alias"], none), i["module_path"])),
    )
    return r.select("path", F.explode(found).alias("x")).select("path", "x.*")


def parse_sql(language: str) -> str:
    ending, _, found = LANGUAGES[language]
    values = ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in found)
    fill = lambda c: f"replace({c}, '{{k}}', CAST(p_partkey AS VARCHAR)) AS {c}"
    return f"""SELECT concat('src/d', CAST(p_partkey AS VARCHAR), '.{ending}') AS path, kind, {fill("name")}, {fill("list")}, {fill("other")} FROM part, (VALUES {values}) v(kind, name, list, other)"""


WORDS = ["", "  ", "A", "a", "D", "M", "R", "C", "T", "added", "DELETED", "renamed", "copied", "modified", "weird", "X"]
STATUSES = ["modified", "modified", "added", "added", "deleted", "modified", "renamed", "copied", "modified", "added", "deleted", "renamed", "copied", "modified", "modified", "modified"]


def change_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every raw word of a change and the status it means, over the parts."""
    word = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("p_partkey") % len(WORDS) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(word.alias("word")).agg(F.count("*").alias("n")).select("word", change_status(F.col("word")).alias("status"), "n")


def change_types_sql() -> str:
    values = ", ".join(f"({k}, '{w}', '{s}')" for k, (w, s) in enumerate(zip(WORDS, STATUSES)))
    return f"SELECT word, status, count(*) AS n FROM part JOIN (VALUES {values}) v(k, word, status) ON p_partkey % {len(WORDS)} = k GROUP BY 1, 2"


#: raw state -> normalised; a null state is none of them
STATES = {"opened": "opened", "MERGED": "merged", " Closed ": "closed", "locked": "locked", "reopened": "closed", "": "closed"}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge-request documents as the service gives them, one for each customer: labels as strings, as objects, or none."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    state = F.element_at(F.array(*map(F.lit, STATES)), (k % len(STATES) + 1).cast("int"))
    segment = F.lower("c_mktsegment")
    labels = F.when(k % 3 == 0, F.concat(F.lit('["'), segment, F.lit('","b"]'))).when(k % 3 == 1, F.concat(F.lit('[{"name":"'), segment, F.lit('"},{"name":"b"}]'))).otherwise(F.lit("[]"))
    value = F.concat(F.lit('{"iid":'), k.cast("string"), F.lit(',"state":"'), state, F.lit('","labels":'), labels, F.lit(',"created_at":"2024-06-01T12:00:00Z"}'))
    return c.select(value.alias("value"))


def labels_and_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    mrs = gitlab.merge_requests(gitlab.parse_merge_requests(documents(spark, sf_dir)), "r")
    return mrs.select("iid", "state", F.array_join("labels", ",").alias("labels"))


def labels_and_states_sql() -> str:
    values = ", ".join(f"({k}, '{s}')" for k, s in enumerate(STATES.values()))
    return f"SELECT c_custkey AS iid, state, CASE WHEN c_custkey % 3 = 2 THEN '' ELSE concat(lower(c_mktsegment), ',b') END AS labels FROM customer JOIN (VALUES {values}) v(k, state) ON c_custkey % {len(STATES)} = k"
