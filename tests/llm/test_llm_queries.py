"""Every pN_ query over the small tables: its columns, no repeated rows, and SQL where there is one."""

import os

import duckdb
import pytest

from lodestack.llm import queries
from tests.conftest import DATA

COLUMNS = {
    "p1_found": "chat_id bigint, defect_type string", "p2_found": "run_id string, field_name string", "p3_found": "table_name string, first_key string, second_key string", "p4_found": "raw_id bigint",
    "p5_found": "table_name string, record_key string, pii_type string, start_pos bigint", "p7_found": "doc_id bigint, item_id bigint", "p8_found": "doc_id bigint, subject_area string",
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, DATA).cache()
    if name in COLUMNS:
        assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == COLUMNS[name]
    assert df.count() == df.distinct().count() > 0
    if name in queries.oracle_sql():
        c = duckdb.connect()
        for f in os.listdir(DATA):
            c.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
        assert sorted(map(tuple, df.select(*sorted(df.columns)).collect())) == sorted(c.execute(f"select {', '.join(sorted(df.columns))} from ({queries.oracle_sql()[name]})").fetchall())
