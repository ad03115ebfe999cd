"""A library in a stored order: files by ranges of the sort key, so that a page reads the files it lies in.

`store` sorts once: rows are dealt by ranges of the key, sorted inside, and written with their place in the file. A
small table names each file's number of rows. `stored_page` finds a page's files from the running sum of these numbers,
at most two where a file holds more than a page, and reads the places wanted from them; the files' statistics
leave out the other row groups. `after` gives the rows behind a given key, for paging without numbers.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

FILE_ROWS = 1_000_000


def store(rows: DataFrame, order: list[str], root: str, file_rows: int = FILE_ROWS) -> None:
    """Write rows in the order of the columns `order`, nulls first; the last one should tell equal rows apart."""
    n = max(1, -(-rows.count() // file_rows))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the number of a row in its partition is the low part of this id
    placed = dealt.withColumn("__place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).withColumn("__file", F.spark_partition_id())
    placed.write.partitionBy("__file").parquet(f"{root}/rows")
    held = rows.sparkSession.read.schema(placed.schema).parquet(f"{root}/rows")
    first = F.min_by(F.struct(*order), "__place")
    held.groupBy("__file").agg(F.count("*").alias("n"), first.alias("first")).coalesce(1).write.parquet(f"{root}/files")
    rows.sparkSession.createDataFrame([(placed.schema.json(),)], "schema string").coalesce(1).write.parquet(f"{root}/shape")


def _files(spark: SparkSession, root: str) -> list:
    """One row per file, in order."""
    return spark.read.parquet(f"{root}/files").orderBy("__file").collect()


def _read(spark: SparkSession, root: str, files: list[tuple[int, int]]) -> DataFrame:
    """Rows of files (number, rows before it) with their position from 1."""
    base = F.lit(0)
    for number, before in files:
        base = F.when(F.col("__file") == number, before).otherwise(base)
    paths = [f"{root}/rows/__file={number}" for number, _ in files]
    schema = StructType.fromJson(json.loads(spark.read.parquet(f"{root}/shape").first()[0]))
    held = spark.read.schema(schema).option("basePath", f"{root}/rows").parquet(*paths) if paths else spark.createDataFrame([], schema)
    return held.withColumn("position", base + F.col("__place") + 1)


def stored_page(spark: SparkSession, root: str, number: int, size: int = 100) -> DataFrame:
    """Page `number` (from 1), with `position`."""
    low, high, before, files, places = (number - 1) * size, number * size, 0, [], F.lit(False)
    for f in _files(spark, root):
        if before < high and before + f["n"] > low:
            files.append((f["__file"], before))
            places = places | ((F.col("__file") == f["__file"]) & (F.col("__place") >= low - before) & (F.col("__place") < high - before))
        before += f["n"]
    return _read(spark, root, files).where(places).drop("__place", "__file")


def after(spark: SparkSession, root: str, order: list[str], key: tuple, size: int = 100) -> DataFrame:
    """The next `size` rows behind the key (values of `order`, none of them null), with `position`."""
    files, before, left = [], 0, None
    held = _files(spark, root)
    for k, f in enumerate(held):
        nxt = held[k + 1]["first"] if k + 1 < len(held) else None
        if left is not None and left < size or left is None and (nxt is None or _less(key, tuple(nxt))):
            left = 0 if left is None else left + f["n"]
            files.append((f["__file"], before))
        before += f["n"]
    behind, equal = F.lit(False), F.lit(True)
    for name, value in zip(order, key, strict=True):
        behind = behind | (equal & (F.col(name) > value))
        equal = equal & (F.col(name) == value)
    return _read(spark, root, files).where(behind).orderBy(*order).limit(size).drop("__place", "__file")


def _less(a: tuple, b: tuple) -> bool:
    """Spark's order: nulls first, strings by their bytes."""
    for x, y in zip(a, b, strict=True):
        x, y = (v.encode() if isinstance(v, str) else v for v in (x, y))
        if x != y:
            return y is not None and (x is None or x < y)
    return False
