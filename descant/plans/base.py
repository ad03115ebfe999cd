"""The register of queries. A query is named after its operator; `sql` is the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """A table dealt by rows, three parts a core at least: the work on its texts is dear, the texts are few. The number of
    splits does not tell how even they are, as a row group goes to one split, and a file may be a single one."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(3 * cores, rows.rdd.getNumPartitions()))
