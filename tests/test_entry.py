"""Registered queries against their SQL, and the guard for removed training-data operators."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from folium.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in cursor.fetchall()), key=repr)


def test_flagship(spark):
    assert entry.entry(spark).columns == ["doc_id", "section_index", "title", "startline", "endline", "content"]


def test_entry_without_the_training_data_operators(tmp_path):
    root = Path(entry.__file__).resolve().parent
    for part in ("__spark_entry__.py", "folium"):
        (tmp_path / part).symlink_to(root / part) if part.endswith(".py") else None
    code = "import shutil, sys; shutil.copytree(sys.argv[1] + '/folium', 'folium', ignore=shutil.ignore_patterns('llm', '__pycache__')); shutil.copy(sys.argv[1] + '/__spark_entry__.py', 'e.py'); sys.path[:0] = ['.']; import e; q = e.queries(); assert 'sections' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert e.oracle_sql().keys() <= q.keys()"
    subprocess.run([sys.executable, "-c", code, str(root)], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"})
