"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

1. Targets: the mix has `share` times all words. Source i of weight w_i gets level * w_i words, but at
   most `most` times its own; the level is where the targets sum up (the fixed point of resharing the
   excess by weight).
2. Streams: each source's documents stand in an order shuffled by a hash of their id and text; their
   words, end to end, are cut into blocks of `block` words, or of 1/PARTS of the source's words if that
   is less (the last may be shorter), so that a slot is a small part of any source.
3. Schedule: slot i takes the point frac((i + 0.5) * golden ratio); the source whose interval of the
   cumulative targets, in its own blocks, holds the point owns the slot. A source's k-th slot takes its block
   k modulo the number of its blocks, for at most `most` rounds.
4. A document's taken words are its words in taken blocks, repeats counted.

Offsets within a source come from sums per hash bucket, a running sum over the buckets and one inside
each bucket, so that no task holds a source. Joins are on (source, block) or (source, bucket).

Edge cases: a null or wordless text has size 0 and takes 0; the null source is a source and comes
last; repeated rows are documents of their own; an empty table gives an empty result; a source
without words gets no slot. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut

WEIGHTS, SHARE, MOST, BLOCK, PARTS = (5, 2, 1), 1.5, 2, 256, 64
#: Buckets of the shuffled order per source: as many as keep a bucket near ROWS rows.
ROWS, LEAST_BUCKETS = 20_000, 256
GOLDEN = 0.6180339887498949


def n_words(text: Column) -> Column:
    """Runs of anything but white space, without building the words."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sources (source, source_size): adds rank, weight and target. One row per source."""
    ordered = W.orderBy(F.col("source").isNull(), "source")
    cycle = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("rank", F.row_number().over(ordered) - 1).withColumn("weight", cycle)
    full = ranked.withColumn("cap", most * F.col("source_size").cast("double"))
    # in the order of cap / weight a source is capped if the level that would suit the rest is above its ratio
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).orderBy("rank")).cast("double") * share
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # the first uncapped source has the level; capped ones come before it
    own = full.withColumn("own_level", level)
    free = F.when(F.col("own_level") * F.col("weight") <= F.col("cap"), F.col("own_level"))
    everyone = W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return own.withColumn("level", F.max(free).over(everyone)).select(
        "source", "source_size", "rank", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target")
    )


def offsets(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (rank, order, size, ...): adds `begin`, the words before the row in its source's stream."""
    placed = docs.withColumn("bucket", F.shiftrightunsigned("order", 64 - (buckets - 1).bit_length()).cast("int"))
    sums = placed.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    before = W.partitionBy("rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select("rank", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("rank", "bucket").orderBy("order", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    own = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return own.join(base, ["rank", "bucket"]).withColumn("begin", F.col("base") + F.col("inside")).drop("base", "inside", "bucket")


def schedule(goals: DataFrame, n_slots: int, most: int = MOST) -> DataFrame:
    """(rank, block_no, times): how often the schedule takes each block of each source. goals (rank, source_size, target, block)."""
    spark = goals.sparkSession
    running = W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    n = F.col("target") / F.col("block")
    total = F.sum(n).over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    bounds = goals.withColumn("upto", F.sum(n).over(running) / total).withColumn("from", F.coalesce(F.lag("upto").over(W.orderBy("rank")), F.lit(0.0)))
    bounds = bounds.where(F.col("target") > 0).select("rank", "from", F.when(F.col("rank") == F.max("rank").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), 1.0).otherwise(F.col("upto")).alias("upto"), F.ceil(F.col("source_size") / F.col("block")).alias("n_blocks"))
    # intervals meet points in 1024 bins of [0, 1): an equi-join, whatever the number of sources
    bins = bounds.withColumn("bin", F.explode(F.sequence(F.floor(F.col("from") * 1024), F.least(F.floor(F.col("upto") * 1024), F.lit(1023)))))
    slots = spark.range(n_slots).select("id", ((F.col("id") + 0.5) * GOLDEN).alias("x")).select("id", (F.col("x") - F.floor("x")).alias("point"))
    owned = slots.withColumn("bin", F.floor(F.col("point") * 1024)).join(bins, "bin").where((F.col("point") >= F.col("from")) & (F.col("point") < F.col("upto")))
    # slots in order are ranked per source by ranges of ids, as documents are by buckets
    width = max(1, n_slots // 1024)
    ranges = owned.withColumn("range", F.floor(F.col("id") / width))
    counts = ranges.groupBy("rank", "range").agg(F.count("*").alias("n"))
    base = counts.select("rank", "range", F.coalesce(F.sum("n").over(W.partitionBy("rank").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    place = F.col("base") + F.row_number().over(W.partitionBy("rank", "range").orderBy("id")) - 1
    ranked = ranges.join(base, ["rank", "range"]).withColumn("place", place).where(F.col("place") < most * F.col("n_blocks"))
    return ranked.groupBy("rank", (F.col("place") % F.col("n_blocks")).alias("block_no")).agg(F.count("*").alias("times"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, row_key) per row of docs. row_key tells
    repeated rows' groups: rows with the same key are the same document."""
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text))
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), key.alias("order")))
    sums = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")).select("source", "source_size", "n_rows"), weights, share, most).join(sized.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n_rows")), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("block", F.greatest(F.least(F.ceil(F.col("source_size") / PARTS), F.lit(block)), F.lit(1)).cast("long")))
    head = sums.agg(F.max("n_rows"), F.sum(F.col("target") / F.col("block"))).first()
    buckets = LEAST_BUCKETS
    while buckets * ROWS < (head[0] or 0):
        buckets *= 2
    n_slots = int(round(head[1] or 0))
    known = sized.join(sums.select(F.col("source").alias("s"), "rank", "source_size", "target", "block"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    streams = offsets(known, buckets)
    taken = schedule(sums, n_slots, most)
    pieces = streams.where("size > 0").withColumn("block_no", F.explode(F.sequence(F.floor(F.col("begin") / F.col("block")), F.floor((F.col("begin") + F.col("size") - 1) / F.col("block")))))
    inside = F.least(F.col("begin") + F.col("size"), (F.col("block_no") + 1) * F.col("block")) - F.greatest(F.col("begin"), F.col("block_no") * F.col("block"))
    blocks = pieces.select("doc_id", "order", "begin", "size", "source_size", "target", "source", "rank", "block_no", inside.alias("words")).join(taken, ["rank", "block_no"], "left")
    full = blocks.groupBy("doc_id", "order", "begin", "size", "source_size", "target", "source").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
    empty = known.where("size = 0").select("doc_id", "order", F.lit(0).cast("long").alias("begin"), "size", "source_size", "target", "source", F.lit(0).cast("long").alias("taken"))
    return full.unionByName(empty).select("doc_id", "size", "source_size", "target", "taken", "source", F.col("order").alias("row_key"))


def materialise(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:  # noqa: ANN003
    """The rows of docs as often as the mix takes them: round(taken / size) times, 0 to `most`."""
    found = mix(docs, id_col, text, source, **options)
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    counts = cut(found.where("size > 0").select(F.col("row_key").alias("__key"), F.col("source").alias("__source"), times.alias("__times"), F.lit(1).alias("__one")).groupBy("__key", "__source").agg(F.sum("__times").alias("__times"), F.sum("__one").alias("__rows")))
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text))
    marked = docs.withColumn("__mix_key", key).join(counts, (F.col("__mix_key") == F.col("__key")) & F.col(source).cast("string").eqNullSafe(F.col("__source")))
    # equal rows share their sum: the mean, rounded, for each
    mean = F.floor(F.col("__times") / F.col("__rows") + 0.5).cast("int")
    return marked.withColumn("__times", mean).where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)
