"""Substring search by an index of three-character runs.

`store` writes which rows hold which runs of three characters of the lower-cased text, dealt into buckets by run and
sorted by it, and how many rows each run has. A query's rows hold all of its runs: those of its RAREST runs are
read, from their buckets alone, intersected by counting, and confirmed by the text itself. So the result equals a
scan with `contains`; queries of fewer than three characters are such a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS, RAREST = 64, 6


def grams(text: Column) -> Column:
    """The distinct runs of three characters of the lower-cased text."""
    low = F.lower(text)
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))))


def store(rows: DataFrame, key: str, text: str, root: str, buckets: int = BUCKETS) -> None:
    """Postings (gram, key) and counts (gram, n) below root. A run that all rows have is dealt by key as well, as its
    bucket is one of `buckets` folders with any number of files."""
    held = rows.select(F.col(key).alias("key"), F.explode(grams(F.col(text))).alias("gram"))
    placed = held.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    n = placed.sparkSession.sparkContext.defaultParallelism
    dealt = placed.repartition(max(n, buckets), "bucket", F.pmod(F.xxhash64("key"), F.lit(max(1, n // 2)))).sortWithinPartitions("bucket", "gram")
    dealt.write.partitionBy("bucket").parquet(f"{root}/postings")
    counts = placed.groupBy("bucket", "gram").agg(F.count("*").alias("n"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{root}/counts")
    placed.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{root}/shape")


def search(rows: DataFrame, key: str, text: str, root: str, query: str) -> DataFrame:
    """Rows whose lower-cased text contains the lower-cased query."""
    spark, hit = rows.sparkSession, F.lower(text).contains(query.lower())
    low = query.lower()
    if len(low) < 3:
        return rows.where(hit)
    wanted = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    buckets = spark.read.parquet(f"{root}/shape").first()[0]
    runs = _of(spark, f"{root}/counts", wanted, buckets).orderBy("n", "gram").select("gram").collect()
    if len(runs) < len(wanted):  # no row has one of the runs
        return rows.where("false")
    rare = [r[0] for r in runs[:RAREST]]
    found = _of(spark, f"{root}/postings", rare, buckets).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(rare))
    return rows.join(found.select(F.col("key").alias(key)), key, "left_semi").where(hit)


def _of(spark: SparkSession, path: str, runs: list[str], buckets: int) -> DataFrame:
    """Rows of the runs: only their buckets are listed, and the files' statistics leave out other runs."""
    places = [r[0] for r in spark.createDataFrame([(g,) for g in runs], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int")).distinct().collect()]
    return spark.read.parquet(path).where(F.col("bucket").isin(places) & F.col("gram").isin(runs))
