"""The entry module: queries and their SQL agree, with and without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or v != v:
        return ""
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


def test_every_graph_query_equals_its_sql(spark):
    if not Path(SF).exists():
        pytest.skip("no test tables")
    from graphloom.plans import registry

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = registry.oracle_sql()
    for name, query in registry.queries().items():
        got = query(spark, SF)
        want = con.execute(sql[name])
        columns = [d[0] for d in want.description]
        assert sorted(got.columns) == sorted(columns), name
        a = sorted(tuple(_plain(r[c]) for c in sorted(columns)) for r in got.collect())
        b = sorted(tuple(_plain(dict(zip(columns, r))[c]) for c in sorted(columns)) for r in want.fetchall())
        assert a == b, name


def test_entry_without_llm(tmp_path):
    """A copy without the subpackage imports and registers the other queries."""
    import shutil

    shutil.copytree(ROOT / "graphloom", tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hot_files' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_entry_with_a_broken_subpackage(tmp_path):
    """A fault inside the subpackage isn't taken for its absence."""
    import shutil

    shutil.copytree(ROOT / "graphloom", tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "graphloom/llm").mkdir()
    (tmp_path / "graphloom/llm/__init__.py").write_text("")
    (tmp_path / "graphloom/llm/queries.py").write_text("import no_such_module\n")
    (tmp_path / "corpus_pipeline.py").write_text("")
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode and "no_such_module" in done.stderr


def test_flagship(spark):
    if not Path(SF).exists():
        pytest.skip("no test tables")
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["repo_name", "path", "language", "modification_count"] and df.count() == 100
