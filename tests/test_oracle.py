"""Every registered query against its SQL in another engine, on the smallest tables."""

import datetime
import decimal
import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat().replace("+00:00", "")
    return v


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query_matches_its_sql(spark, duck, name):
    found = entry_module.queries()[name](spark, SF)
    columns = sorted(found.columns)
    result = duck.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert ours == theirs


def test_flagship(spark):
    assert entry_module.entry(spark).count() == 8


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "lodestream", tmp_path / "lodestream", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; names = e.queries(); assert 'vec_topk' in names and 'pipeline' not in names and not any(n.startswith('op') for n in names)"
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
