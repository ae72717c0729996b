"""Every query of the library with an SQL twin, on the smallest tables, against DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from gleanline.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    one = lambda v: None if v is None else round(float(v), 6) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    found = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    assert plain(got.select(*names).collect()) == plain([tuple(r[columns.index(c)] for c in names) for r in found.fetchall()])
