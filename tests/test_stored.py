"""Exact medians, pages in a stored order, the index for substrings."""

import math
import random

import pytest
from pyspark.sql import functions as F

from descant.operators import grams, ordered_pages as P, ranks, songs as S


def test_medians_equal_sparks_whatever_is_small(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([rng.gauss(0, 1e3), rng.gauss(0, 1e-9), float(rng.randrange(-3, 4)), -0.0, 0.0, 1e300, -1e300, None])) for _ in range(4000)]
    rows += [("one", 5.0), ("two", 1.0), ("two", 2.0), ("none", None), ("inf", math.inf), ("inf", -math.inf), ("inf", math.inf), ("nan", math.nan), ("nan", 1.0), ("nan", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    want = {r.k: (r.n, r.m) for r in df.groupBy("k").agg(F.count("v").alias("n"), F.median("v").alias("m")).collect()}
    for small in (0, 2, 10**6):
        got = {r.k: (r.n, r.median) for r in ranks.medians(df, "k", "v", small).collect()}
        assert got == want
    pairs = df.where("k IN ('a', 'b', 'two')")
    a, b = ({r.k: (r.n, r.median, r.mad) for r in S.robust_offset(pairs, "k", "v", small).collect()} for small in (5, 10**6))
    assert a == b and len(a) == 3


def test_no_task_holds_a_hot_key(spark):
    hot = spark.range(200_000, numPartitions=4).select(F.lit("k").alias("k"), (F.col("id") * 7919 % 200_001).cast("double").alias("v"))
    got = ranks.medians(hot, "k", "v", 1000).first()
    values = sorted(i * 7919 % 200_001 for i in range(200_000))
    assert (got.n, got.median) == (200_000, (values[99_999] + values[100_000]) / 2)


def test_pages_read_at_most_two_files(spark, tmp_path):
    rng = random.Random(3)
    names = [rng.choice(["Zoë", "abc", "ärger", "b"]) + str(rng.randrange(50)) for _ in range(2000)]
    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string").repartition(3)
    root = f"file://{tmp_path}/p"
    P.store(rows, ["name", "id"], root, file_rows=150)
    want = sorted(((n.encode(), i) for i, n in enumerate(names)))
    for number in (1, 2, 7, 20, 21):
        got = P.stored_page(spark, root, number, 100)
        assert sorted((r.position, r.id) for r in got.collect()) == [(k + 1, want[k][1]) for k in range((number - 1) * 100, min(number * 100, 2000))]
        assert len(got.inputFiles()) <= 2 or number == 21
    for k in (0, 99, 1234, 1995, 1999):
        got = P.after(spark, root, ["name", "id"], (want[k][0].decode(), want[k][1]), 30)
        assert [(r.position, r.id) for r in got.collect()] == [(j + 1, want[j][1]) for j in range(k + 1, min(k + 31, 2000))]
        assert len(got.inputFiles()) <= 3
    P.store(rows.limit(0), ["name", "id"], f"{root}-empty")
    assert P.stored_page(spark, f"{root}-empty", 1).count() == 0


def test_search_equals_a_scan(spark, tmp_path):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abÄß .") for _ in range(rng.randrange(12))) for _ in range(500)] + [None, "", "common run", "Common Run"] * 20
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    root = f"file://{tmp_path}/g"
    grams.store(rows, "id", "text", root, buckets=8)
    for q in ["", "a", "ab", "abÄ", "ÄSS", "mmon ru", "COMMON RUN", "zzz", "ab.a", "a b", "commonx"]:
        got = sorted(r.id for r in grams.search(rows, "id", "text", root, q).collect())
        assert got == sorted(r.id for r in rows.where(F.lower("text").contains(q.lower())).collect()), q


@pytest.mark.parametrize("text,want", [("abcab", ["abc", "bca", "cab"]), ("AAAA", ["aaa"]), ("ab", None), (None, None)])
def test_grams(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(grams.grams(F.col("t")).alias("g")).first().g == want
