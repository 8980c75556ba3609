"""Every registered query of the engine equals its SQL on the smallest tables, and the entry module works without optional parts."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from kinfold.plans import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def rounded(rows):
    return sorted([tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows], key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, duck, name):
    df = Q.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = rounded(tuple(r) for r in df.select(*columns).collect())
    sql = Q.oracle_sql().get(name)
    if sql:
        rel = duck.sql(sql)
        assert sorted(rel.columns) == columns
        assert got == rounded(rel.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry_imports_without_the_optional_parts(tmp_path):
    here = Path(__file__).resolve().parents[1]
    for name in ("__spark_entry__.py", "kinfold"):
        (tmp_path / name).symlink_to(here / name) if name != "kinfold" else None
    package = tmp_path / "kinfold"
    package.mkdir()
    for p in (here / "kinfold").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (package / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q_scan' in q and not any(k.startswith('op') for k in q), q; e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
