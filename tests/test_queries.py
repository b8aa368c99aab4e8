"""Every query with SQL against DuckDB on the small tables, and every other query for rows of a stable schema."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestack.plans import catalog
from tests.conftest import DATA


def plain(rows):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, bool):
            return str(v)
        return repr(round(v + 0.0, 6)) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.execute(f"select {', '.join(columns)} from ({catalog.oracle_sql()[name].rstrip(';')}) as q").fetchall()
    assert plain(got.select(*columns).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    got = catalog.queries()[name](spark, DATA)
    assert len(set(got.columns)) == len(got.columns) and got.count() > 0


def test_store_listing_is_whole(spark, duck):
    got = [r.workspace_id for r in catalog.queries()["op171_store_listing_whole"](spark, DATA).collect()]
    assert got == [w for (w,) in duck.execute("select workspace_id from workspaces order by 1").fetchall()] and len(got) > 20


def test_listing_by_size_is_whole(spark, tmp_path):
    rows = [(i, "x" * (i % 7) if i % 50 else None) for i in range(150)]
    spark.createDataFrame(rows + rows[:9], "raw_id long, textcontent string").write.parquet(str(tmp_path / "raw_documents.parquet"))
    got = [(r.raw_id, r.size) for r in catalog.queries()["op87_listing_by_size_whole"](spark, str(tmp_path)).collect()]
    want = sorted(((i, None if t is None else len(t)) for i, t in rows), key=lambda x: (-1 if x[1] is None else x[1]) * -1000 + x[0])
    assert got == want


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) % 4 == 0 and {r.place for r in rows} == {1, 2, 3, 4} and all(r.query_id % 20 == 0 for r in rows)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
