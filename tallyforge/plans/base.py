"""The register of queries, and rounding that both engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r5(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1e5 + 0.5 + 1e-4) / 1e5 + F.lit(0.0)


def R5(c: str) -> str:
    return f"(floor(({c}) * 1e5 + 0.5 + 1e-4) / 1e5 + 0.0::DOUBLE)"


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r5(c) for c in cols})
