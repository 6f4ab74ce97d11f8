"""Every registered query against its SQL, on the smallest tables; and the entry file without the optional subpackage."""

import datetime
import decimal
import math
import os
import subprocess
import sys

import duckdb
import pytest

from gristmill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sql, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if name not in catalog.oracle_sql():
        assert got
        return
    r = sql.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name, source", [("sort_natural_whole", "customer"), ("sort_nulls_turned_whole", "events")])
def test_whole_sorts_return_every_row(spark, sql, name, source):
    (n,) = sql.execute(f"select count(*) from {source}").fetchone()
    assert sorted(r.place for r in catalog.queries()[name](spark, SF).collect()) == list(range(1, n + 1))


def test_entry_without_the_optional_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("gristmill.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert "flagship" in e.queries() and "pipeline" not in e.queries() and not any(k.startswith("op") and k[2].isdigit() for k in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
