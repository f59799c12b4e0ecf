"""The driver contract: queries against their SQL on the smallest tables, and the entry without the llm subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tessera.plans.queries import ORACLE_SQL, QUERIES

SMALL, ROOT = "/root/testdata/sf0.001", Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def norm(names, rows) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([round(float(r[i]), 6) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else str(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got, cursor = df.collect(), duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert norm(df.columns, got) == norm(names, cursor.fetchall())


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_llm_parts(tmp_path):
    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'weekly_series' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, check=True, timeout=120)


def test_entry_with_llm_parts_that_do_not_import(tmp_path):
    """A missing library of the text operators takes only their queries away."""
    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "tessera" / "llm").mkdir()
    (tmp_path / "tessera" / "llm" / "__init__.py").write_text("")
    (tmp_path / "tessera" / "llm" / "queries.py").write_text("import a_library_that_is_not_there")
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'weekly_series' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, check=True, timeout=120)
