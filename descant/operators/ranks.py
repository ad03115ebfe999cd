"""Exact medians of keys of any size, without a task that holds a key's values.

Keys of at most `small` values take Spark's median, whose buffer they bound. For the others the two middle values are
selected by digits: a number's bits, made to order as it does, are read from the top in DIGITS digits. A round
counts per key and digit how many values continue the prefix that is known so far, map-side first, and takes
the digit in which the wanted rank falls. A key sends at most 2**16 counts per task and rank in a round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType, LongType

from ..session import cut, release

SMALL = 100_000
DIGITS, BITS = 4, 16
_LOW = np.int64((1 << 63) - 1)


@F.pandas_udf(LongType())
def sortable(values: pd.Series) -> pd.Series:
    """Whole numbers in the order of the values; -0.0 is 0.0, NaN is above all."""
    v = values.to_numpy(np.float64) + 0.0
    bits = np.where(np.isnan(v), np.float64("nan"), v).view(np.int64)
    return pd.Series(bits ^ ((bits >> 63) & _LOW))


@F.pandas_udf(DoubleType())
def value_of(order: pd.Series) -> pd.Series:
    bits = order.to_numpy(np.int64)
    return pd.Series((bits ^ ((bits >> 63) & _LOW)).view(np.float64))


def selected(rows: DataFrame, wanted: DataFrame, key: str, value: str) -> DataFrame:
    """(key, rank, value) for wanted (key, rank), ranks from 0: the value at that place of the key's sorted values."""
    held = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("__key"), sortable(F.col(value).cast("double")).alias("__v"))
    state = wanted.select(F.col(key).alias("__k"), F.col("rank").cast("long").alias("rank"), F.lit(None).cast("long").alias("__prefix"), F.col("rank").cast("long").alias("__left"))
    before: DataFrame | None = None
    for k in range(DIGITS):
        low = BITS * (DIGITS - 1 - k)
        digit = F.shiftright("__v", low)
        known = F.lit(True) if k == 0 else F.shiftright("__v", low + BITS) == F.col("__prefix")
        counts = held.join(state, F.col("__key").eqNullSafe(F.col("__k"))).where(known).select("__k", "rank", "__left", digit.alias("__prefix")).groupBy("__k", "rank", "__left", "__prefix").agg(F.count("*").alias("__n"))
        w = W.partitionBy("__k", "rank").orderBy("__prefix")
        upto = F.sum("__n").over(w)
        found = counts.withColumn("__upto", upto).where((F.col("__upto") > F.col("__left")) & (F.col("__upto") - F.col("__n") <= F.col("__left")))
        state = cut(found.select("__k", "rank", "__prefix", (F.col("__left") - F.col("__upto") + F.col("__n")).alias("__left")))
        release(before)
        before = state
    return state.select(F.col("__k").alias(key), "rank", value_of("__prefix").alias("value"))


def medians(rows: DataFrame, key: str, value: str, small: int = SMALL) -> DataFrame:
    """(key, n, median) of the values that are not null; null for a key without any."""
    sizes = cut(rows.groupBy(key).agg(F.count(value).alias("n")))
    large = sizes.where(F.col("n") > small)
    own = rows.select(F.col(key).alias("__key"), F.col(value).alias("__v"))
    few = own.join(sizes.where(F.col("n") <= small), F.col("__key").eqNullSafe(F.col(key))).groupBy(F.col("__key").alias(key)).agg(F.max("n").alias("n"), F.median(F.col("__v").cast("double")).alias("median"))
    if large.isEmpty():
        return few
    middle = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    found = selected(rows, large.select(key, F.explode(middle).alias("rank")), key, value)
    many = found.groupBy(key).agg(F.sum(F.col("value") * 0.5).alias("__sum"), F.count("*").alias("__k"), F.max("value").alias("__top"))
    mid = F.when(F.col("__k") == 1, F.col("__top")).otherwise(F.col("__sum"))
    joined = many.withColumn("median", mid).alias("m").join(large.alias("s"), F.col("m." + key).eqNullSafe(F.col("s." + key)))
    return few.unionByName(joined.select(F.col("s." + key).alias(key), "n", "median"))
