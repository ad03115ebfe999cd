"""Song packs: round trip, partitions by bytes, appends, failed tasks."""

import os

import pytest
from pyspark.sql import functions as F

from descant.sources import packs

SCHEMA = "stem string, kind string, body string"


def texts(df):
    return sorted(map(str, map(tuple, df.select("stem", "kind", "body").collect())))


def stored(tmp_path):
    return sorted(f for _, _, files in os.walk(tmp_path / "p" / "data") for f in files)


def test_round_trip_and_splits(spark, tmp_path):
    rows = [(f"s{k}", "lrc", f"[0:0{k % 10}.00] é{k}\n" * (k % 7)) for k in range(60)] + [("empty", "srt", ""), ("none", None, None), (None, "srt", "x"), ("s1", "lrc", "again"), ("long", "ass", "y" * 100_000)]
    songs = spark.createDataFrame(rows, SCHEMA).withColumn("other", F.lit(1)).repartition(3)
    packs.write_packs(songs, f"file://{tmp_path}/p")
    got = packs.read_packs(spark, f"{tmp_path}/p")
    assert texts(got) == sorted(map(str, rows))
    small = spark.read.format("songpack").option("split", "50").load(f"{tmp_path}/p")
    assert texts(small) == sorted(map(str, rows)) and small.rdd.getNumPartitions() > 20
    assert len([f for f in stored(tmp_path) if f.endswith(".pack")]) <= 3


def test_append_overwrite_and_empty(spark, tmp_path):
    at = f"{tmp_path}/p"
    one = lambda s: spark.createDataFrame([(s, "k", s * 3)], SCHEMA).coalesce(1)
    packs.write_packs(one("a"), at)
    packs.write_packs(one("b"), at)
    assert texts(packs.read_packs(spark, at)) == texts(one("a").union(one("b")))
    packs.write_packs(one("c"), at, "overwrite")
    assert texts(packs.read_packs(spark, at)) == texts(one("c")) and len(stored(tmp_path)) == 2
    packs.write_packs(one("c").limit(0), at, "overwrite")
    assert packs.read_packs(spark, at).count() == 0
    with pytest.raises(Exception, match="missing"):
        spark.range(1).write.format("songpack").mode("append").save(at)


def test_packs_without_the_wanted_stems_are_not_opened(spark, tmp_path):
    at = f"{tmp_path}/p"
    songs = spark.createDataFrame([(f"s{k:03d}", "k", "x") for k in range(100)], SCHEMA).repartitionByRange(5, "stem")
    packs.write_packs(songs, at)
    got = packs.read_packs(spark, at, ["s007", "s099", "zzz"])
    assert texts(got) == ["('s007', 'k', 'x')", "('s099', 'k', 'x')"] and got.rdd.getNumPartitions() == 2


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    at = f"{tmp_path}/p"
    packs.write_packs(spark.createDataFrame([("a", "k", "before")], SCHEMA), at)
    before = stored(tmp_path)
    broken = spark.range(100, numPartitions=4).select(F.col("id").cast("string").alias("stem"), F.lit("k").alias("kind"), F.when(F.col("id") == 70, F.raise_error(F.lit("no"))).otherwise("x").alias("body"))
    with pytest.raises(Exception, match="no"):
        packs.write_packs(broken, at)
    assert texts(packs.read_packs(spark, at)) == ["('a', 'k', 'before')"]
    assert stored(tmp_path) == before
