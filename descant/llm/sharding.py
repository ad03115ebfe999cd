"""K-d tree partitioning of documents into shards of nearly equal bytes.

Equal texts form a unit with the metadata dimensions size (log scale), source and language, each in
0 .. 2**BITS - 1; a name's place is the logarithm of its bytes, so that sources of like weight are
neighbours. A node of the tree is split at the weighted median (weights are bytes) along its widest
dimension, the one with the largest weighted variance; ties along it are broken by a hash of the text, so
that any boundary can be met. Medians are found by distributed histograms: each round sums bytes in BINS
bins per node and zooms into the bin with the boundary, all nodes of a level at once. Nodes are rows of a
table, so that neither driver nor plan grows with the number of shards.

A unit of more than SPLIT of a shard's target cannot be kept whole and balanced: it is dealt into parts of
at most LIGHT of a target by the hash of its documents' ids, so a hot group of copies cannot unbalance
shards. Smaller units stay in one shard. Those above LIGHT stand at the ends of a node's order, at which
one a bit of their hash says, so that the median falls among light units and shards come out even. Slots
are numbered inside (shard, bucket) with offsets per bucket, so no task holds a shard.

Edge cases: a null text counts 0 bytes and so has size 1, and crc32 0; null source or language is the
empty string; repeated rows get slots of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import bounded, cut, release

SPLIT, LIGHT = 0.3, 0.01
BITS, TIE_BITS = 20, 39  # a key has one bit more along its dimension: BITS + 1 + TIE_BITS is a multiple of ZOOM
ZOOM = 10  # bits a round
COARSE = 6  # bits of a dimension in its variance
ROWS, LEAST_BUCKETS = 20_000, 64
DIMENSIONS = ("d_size", "d_source", "d_lang")


def _log_place(size: Column) -> Column:
    return F.least(F.floor(F.log2(size.cast("double")) * (1 << (BITS - 6))), F.lit((1 << BITS) - 1)).cast("long")


def _light(docs: DataFrame, id_col: str, text: str, source: str, lang: str) -> DataFrame:
    raw = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    size = F.octet_length(raw).cast("long") + 1
    return docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("group"), name(source).alias("source"), name(lang).alias("lang"))


def _placed(groups: DataFrame, light: DataFrame, name: str) -> DataFrame:
    """groups with the place of their source or language: by its bytes, equal ones by a hash."""
    sums = cut(light.groupBy(name).agg(F.sum("size").alias("bytes")))
    own = F.shiftleft(F.shiftright(_log_place(F.col("bytes")), COARSE), COARSE) + F.pmod(F.crc32(F.col(name).cast("binary")), F.lit(1 << COARSE))
    return groups.join(bounded(sums.select(name, own.alias(f"d_{name}")), 64), name).drop(name)


def _split(units: DataFrame, level: int) -> DataFrame:
    """units (first, share, DIMENSIONS, tie, heavy, weight, ...) of nodes with several shards, each node named by
    its first shard: halved, the left half with the smaller count of shards."""
    coarse = lambda d: F.shiftright(d, BITS - COARSE)
    big = lambda c: c.cast("decimal(38,0)")
    sums = units.groupBy("first", "share").agg(F.sum("weight").alias("w"), *(F.sum(F.col("weight") * x).alias(f"{d}_{n}") for d in DIMENSIONS for n, x in ((1, coarse(d)), (2, coarse(d) * coarse(d)))))
    spreads = F.array(*((big(F.col("w")) * big(F.col(f"{d}_2")) - big(F.col(f"{d}_1")) * big(F.col(f"{d}_1"))).cast("double") for d in DIMENSIONS))
    left = F.floor(F.col("share") / 2)
    nodes = cut(sums.select("first", F.array_position(spreads, F.array_max(spreads)).cast("int").alias("dim"), F.floor(big(F.col("w")) * left / F.col("share")).cast("long").alias("goal")))
    along = F.element_at(F.array(*(F.col(d) for d in DIMENSIONS)), F.col("dim")) + 1
    end = F.when(F.getbit("tie", F.lit(level % TIE_BITS)) == 1, F.lit((2 << BITS) - 1)).otherwise(0)
    key = F.shiftleft(F.when(F.col("heavy"), end).otherwise(along).cast("long"), TIE_BITS) + F.col("tie")
    keyed = cut(units.join(nodes.select("first", "dim"), "first").withColumn("key", key).drop("dim"))
    bounds = nodes.select("first", "goal", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("below"))
    running = W.partitionBy("first").orderBy("bin")  # a node's bins, 2**ZOOM at most
    for shift in range(BITS + 1 + TIE_BITS - ZOOM, -1, -ZOOM):
        inside = keyed.select("first", "key", "weight").join(bounds, "first").where(F.shiftright("key", shift + ZOOM) == F.shiftright("low", shift + ZOOM))
        bins = inside.groupBy("first", "goal", "below", F.shiftright("key", shift).alias("bin")).agg(F.sum("weight").alias("w"))
        past = bins.withColumn("upto", F.col("below") + F.sum("w").over(running)).where("upto > goal")
        bounds = past.groupBy("first", "goal").agg(F.min(F.struct("bin", "w", "upto")).alias("b")).select("first", "goal", F.shiftleft("b.bin", shift).alias("low"), (F.col("b.upto") - F.col("b.w")).alias("below"), F.col("b.upto").alias("upto"))
    # the boundary's own key goes to the side that is then nearer to its share
    cuts = bounds.select("first", (F.col("low") + F.when(F.col("upto") - F.col("goal") < F.col("goal") - F.col("below"), 1).otherwise(0)).alias("cut"))
    right = F.col("key") >= F.col("cut")
    half = keyed.join(cuts, "first").select(
        (F.col("first") + F.when(right, left).otherwise(0)).cast("int").alias("first"), F.when(right, F.col("share") - left).otherwise(left).cast("int").alias("share"), *(c for c in units.columns if c not in ("first", "share"))
    )
    out = cut(half)
    release(nodes, keyed)
    return out


def tree(units: DataFrame, leaves: int) -> DataFrame:
    """units (DIMENSIONS, tie, heavy, weight, ...) with `shard`."""
    done: list[DataFrame] = []
    open_, level, most = units.withColumns({"first": F.lit(0), "share": F.lit(leaves)}), 0, leaves
    while most > 1:
        both = _split(open_, level)
        done.append(both.where("share = 1"))
        open_, level, most = both.where("share > 1"), level + 1, most - most // 2
    done.append(open_) if leaves == 1 else None
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumnRenamed("first", "shard").drop("share")


def units_of(light: DataFrame, leaves: int, total: int) -> tuple[DataFrame, DataFrame]:
    """(rows of light with group and part, units (group, part, DIMENSIONS, tie, heavy, weight))."""
    groups = light.groupBy("group", F.col("size").alias("one")).agg(F.sum("size").alias("weight"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    target = total / leaves
    for name in ("source", "lang"):
        groups = _placed(groups, light, name)
    parts = F.when(F.col("weight") > SPLIT * target, F.ceil(F.col("weight") / max(1.0, LIGHT * target))).otherwise(1)
    groups = cut(groups.withColumn("d_size", _log_place(F.col("one"))).withColumn("parts", parts))
    split = groups.where("parts > 1").select("group", F.col("one").alias("size"), "parts")
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id"), F.col("parts"))).otherwise(0).cast("long")
    rows = cut(light.join(split, ["group", "size"], "left").select("doc_id", "size", "text_crc32", "group", part.alias("part")))
    sums = rows.groupBy("group", "size", "part").agg(F.sum("size").alias("weight"))
    tie = F.shiftrightunsigned(F.xxhash64("group", "part", "size"), 64 - TIE_BITS)
    units = sums.join(groups.select("group", F.col("one").alias("size"), *DIMENSIONS, "parts"), ["group", "size"]).withColumn("tie", tie)
    units = cut(units.withColumn("heavy", (F.col("parts") == 1) & (F.col("weight") > LIGHT * target)).drop("parts"))
    release(groups)
    return rows, units


def shard(docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None, id_col: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) per row of docs; as many shards as are asked for, or
    as target_bytes needs."""
    light = cut(_light(docs, id_col, text, source, lang))
    head = light.agg(F.sum("size"), F.count("*")).first()
    total, n_rows = head[0] or 0, head[1] or 0
    leaves = shards or max(1, -(-total // (target_bytes or 1)))
    rows, units = units_of(light, leaves, total)
    home = tree(units, leaves).select("group", "size", "part", "shard")
    placed = cut(rows.join(home, ["group", "size", "part"]).select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard")))
    buckets = LEAST_BUCKETS
    while buckets * leaves * ROWS < n_rows:
        buckets *= 2
    return slots(placed, buckets).select("doc_id", "size", "text_crc32", "shard", "slot")


def slots(placed: DataFrame, buckets: int) -> DataFrame:
    """Adds `slot`: numbers from 0 without gaps in each shard, in an order shuffled by id."""
    order = F.xxhash64("doc_id", "text_crc32", "size")
    held = placed.withColumn("order", order).withColumn("bucket", F.pmod("order", F.lit(buckets)).cast("int"))
    counts = held.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("order", "doc_id"))
    return held.withColumn("inside", inside).join(base, ["shard", "bucket"]).withColumn("slot", F.col("base") + F.col("inside") - 1).drop("base", "inside", "bucket", "order")
