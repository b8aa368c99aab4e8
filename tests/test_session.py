"""Tables kept in the shared folder."""

import os

from lodestack.session import keep, release
from pyspark.sql import functions as F


def test_kept_tables_are_read_by_column_and_released(spark):
    df = spark.range(10).select("id", F.lit("x").alias("text"), F.array("id").alias("a"))
    table = keep(df)
    folder = table.lodestack_folder.removeprefix("file:")
    assert os.path.isdir(folder) and table.schema.simpleString() == df.schema.simpleString() and table.agg(F.sum("id")).first()[0] == 45
    assert "ReadSchema: struct<id:bigint>" in table.select("id")._jdf.queryExecution().executedPlan().toString()
    assert keep(df.limit(0)).count() == 0
    release(table)
    assert not os.path.exists(folder)
    release(table)
    release(df)
