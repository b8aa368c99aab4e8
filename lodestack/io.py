"""Reading the engine's tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables; timestamps without zone are taken as UTC."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    ntz = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(f"`{c}`").cast("timestamp") for c in ntz}) if ntz else df


class Tables:
    """The tables of one folder, read on first use: ``Tables(spark, folder).orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder, self._read = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._read:
            self._read[name] = load(self._spark, self._folder, name)
        return self._read[name]

    def register(self, *names: str) -> None:
        """Temporary views for SQL pass-through; without names, every table of a local folder."""
        if not names:
            names = tuple(sorted(f[:-8] for f in os.listdir(self._folder) if f.endswith(".parquet")))
        for name in names:
            getattr(self, name).createOrReplaceTempView(name)
