"""Every registered query of the byte-stream operators against its SQL, and the driver's contract."""

import importlib
import math
import sys
from pathlib import Path

import duckdb
import pytest

from bytelake.plans import queries as plans

ROOT = Path(__file__).resolve().parents[2]


def same(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return round(x, 6)
    return bytes(x) if isinstance(x, (bytes, bytearray)) else x


@pytest.fixture(scope="session")
def tables(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf_dir, tables, name):
    got = plans.QUERIES[name](spark, sf_dir)
    rows = sorted((tuple(same(r[c]) for c in sorted(got.columns)) for r in got.collect()), key=str)
    assert rows
    if name in plans.SQL:
        found = tables.execute(plans.SQL[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(got.columns)
        order = sorted(range(len(columns)), key=columns.__getitem__)
        assert rows == sorted((tuple(same(r[i]) for i in order) for r in found.fetchall()), key=str)


def test_contract(spark):
    sys.path.insert(0, str(ROOT))
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries()) >= set(plans.QUERIES)
    assert entry.entry(spark).count() == 1
