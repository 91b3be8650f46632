"""Every query with SQL gives DuckDB's rows, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from paperloom.plans.queries import QUERIES, SQL

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.skipif(not SF.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    got = QUERIES[name](spark, str(SF))
    names = sorted(got.columns)
    want = db.execute(SQL[name]).fetchdf()
    assert sorted(want.columns) == names
    show = lambda v: "null" if v is None or v != v else repr(v.item() if hasattr(v, "item") else v)
    a = sorted(tuple(show(r[c]) for c in names) for r in got.toPandas().to_dict("records"))
    b = sorted(tuple(show(r[c]) for c in names) for r in want.to_dict("records"))
    number = lambda x: x.removesuffix(".0")  # noqa: E731  pandas turns whole columns with nulls into floats
    assert [tuple(map(number, r)) for r in a] == [tuple(map(number, r)) for r in b]


@pytest.mark.skipif(not SF.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(SF)).count() > 0
