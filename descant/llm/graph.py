"""Verified links from colliding keys, and connected components, without all pairs of a group.

`link` gets (id, key) rows; two ids are candidates if they share a key. Each key has one pivot, the member
that collides most over all its keys (the original of edited copies collides more than the copies do), and
a pivot with all members of its keys is a star. Every candidate pair lies inside a star, and a member's bag
(the sorted hashes of its shingles) travels once to each of its stars.

Stars of at most STAR members and ELEMENTS hashes are settled where they meet, one at a time and exactly:
members are compared with the pivot, and those that are not similar to it (the open ones) with every other
member. The hashes that two members share are counted for all members at once: hashes of at least one member
in 64 are bits of a row of words, the others have lists of their members. What goes out is one link a member,
to the smallest one of its component, not the pairs.

Larger stars are dealt into blocks of that size, and each pair of blocks, and each block alone, is settled
like a small star by a task of its own; a pair of blocks compares open members with those of the other block.
So all pairs but those of members similar to one pivot are compared in one step, whatever the edits have in
common, and no task holds more than two blocks. The members of a star of k blocks travel k times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded, cut, release

STAR, ELEMENTS = 8_192, 1 << 20
#: Bytes of a hash in a bag. Two bags of 20,000 hashes have one in common by chance once in 700,000 pairs.
WIDTH = 6


def pack(hashes: np.ndarray) -> bytes:
    """A bag: distinct hashes in order, cut to the upper WIDTH bytes of 64 bits."""
    short = np.unique(hashes >> np.uint64(64 - 8 * WIDTH))
    return short.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :].tobytes()


def unpack(bag: memoryview | bytes) -> np.ndarray:
    raw = np.frombuffer(bag, np.uint8).reshape(-1, WIDTH)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 8 - WIDTH :] = raw
    return out.view(">u8").ravel().astype(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of the ids of edges (a, b); the label is the smallest id of the component. Minimum
    label propagation with pointer jumping; every round is one job, written and read back."""
    both = cut(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct())
    labels = cut(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("dst"), F.col("label").alias("n")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("n").alias("near"))
        far = labels.select(F.col("id").alias("old"), F.col("label").alias("far"))
        step = labels.select("id", F.col("label").alias("old")).join(near, "id").join(far, "old")
        after = cut(step.select("id", F.least("near", "far").alias("label"), "old"))
        done = after.where("label <> old").isEmpty()
        release(labels)
        labels = after
        if done:
            release(both)
            out = labels.select("id", "label")
            out._descant_path = labels._descant_path
            return out


def star_links(ids: list, pivot: int | None, bags: list[np.ndarray], least: float, side: np.ndarray | None = None) -> list[tuple]:
    """Links (id, smallest id of its component) of what is similar among the members; bags are sorted and
    distinct. Rows of one id hang together. No pivot: the member that shares most. With sides, pairs of one
    side are left to the task that has that side alone."""
    n = len(bags)
    size = np.array([len(b) for b in bags])
    first = np.cumsum(size) - size
    known: dict = {}
    label = np.array([known.setdefault(x, k) for k, x in enumerate(ids)])
    values, code, counts = np.unique(np.concatenate(bags), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    own = lambda k: code[first[k] : first[k] + size[k]]

    def join(x: int, common: np.ndarray, among: np.ndarray | bool = True) -> None:
        """x with those of `among` that have enough of the `common` hashes with it."""
        like = (common >= least * (size + size[x] - common)) & (label != label[x]) & among
        if like.any():
            label[np.isin(label, label[like])] = label[x]

    def found() -> list[tuple]:
        least_of: dict[int, object] = {}
        for k, i in zip(label.tolist(), ids, strict=True):
            least_of[k] = min(i, least_of.get(k, i))
        return list({(i, least_of[k]) for k, i in zip(label.tolist(), ids, strict=True) if i != least_of[k]})

    if pivot is None:
        pivot = int(np.argmax(np.bincount(owner, counts[code], n)))
    mark = np.zeros(len(values), bool)
    mark[own(pivot)] = True
    join(pivot, np.bincount(owner, mark[code], n))
    open_ = np.flatnonzero(label != label[pivot])
    if not len(open_) or n == 2:
        return found()

    often = (counts > 1) & (counts * 64 >= n)
    few = (counts > 1) & ~often
    at = np.flatnonzero(often[code])
    column = (np.cumsum(often) - 1)[code[at]]
    wide = (int(often.sum()) + 63) // 64
    bits = np.zeros(n * wide, np.uint64)
    if len(at):  # in the order of member and hash, so that the bits of a word stand together
        word = owner[at] * wide + (column >> 6)
        edge = np.flatnonzero(np.diff(word, prepend=-1))
        bits[word[edge]] = np.bitwise_or.reduceat(np.uint64(1) << (column & 63).astype(np.uint64), edge)
    bits = np.ascontiguousarray(bits.reshape(n, wide).T)
    at = np.flatnonzero(few[code])
    lists = owner[at][np.argsort(code[at], kind="stable")]
    ends = np.cumsum(counts * few)
    for x in open_.tolist():
        common = np.bitwise_count(bits & bits[:, x, None]).sum(0, dtype=np.int64)
        if len(mine := own(x)[few[own(x)]]):
            common += np.bincount(np.concatenate([lists[e - c : e] for e, c in zip(ends[mine].tolist(), counts[mine].tolist(), strict=True)]), minlength=n)
        join(x, common, True if side is None else side != side[x])
    return found()


def _settle(least: float, kind: pa.DataType):  # noqa: ANN202
    """Rows (id, p, i, j, own, bag), those of a pair (i, j) of blocks of a star one after the other, to links
    (a, b); own is the row's block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, ids, blocks, bags = None, [], [], []
        found: list[tuple] = []

        def done() -> None:
            if len(ids) > 1 and (star[1] == star[2] or len(set(blocks)) > 1):
                pivot = ids.index(star[0]) if star[0] in ids else None
                found.extend(star_links(ids, pivot, bags, least, np.array(blocks) if star[1] < star[2] else None))

        for batch in batches:
            for i, p, low, high, own, bag in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5), strict=True):
                if (p, low, high) != star:
                    done()
                    star, ids, blocks, bags = (p, low, high), [], [], []
                ids.append(i)
                blocks.append(own)
                bags.append(unpack(bag.as_buffer()))
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in zip(*found, strict=True)], names=["a", "b"])
                found.clear()
        done()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c in zip(*found, strict=True)], names=["a", "b"])

    return run


def large_stars(rows: DataFrame) -> DataFrame:
    """(p, parts) of the stars that take several blocks, written."""
    parts = F.ceil(F.greatest(F.count("*") / STAR, F.sum(F.octet_length("bag")) / (ELEMENTS * WIDTH))).cast("int")
    return cut(rows.groupBy("p").agg(parts.alias("parts")).where("parts > 1"))


def dealt(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Rows (id, p, bag) to (id, p, i, j, own, bag): a small star is one block, a row of a larger one stands in
    its block's pairs (i, j), i <= j, with each block."""
    # of several bags of one id each is dealt by itself
    own = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id", "bag"), F.col("parts"))).otherwise(0).cast("int")
    each = rows.join(bounded(large, 64), "p", "left").withColumn("own", own)
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    return each.select("id", "p", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "bag")


def stars(keys: DataFrame) -> DataFrame:
    """(id, ps) of the ids that share a key: the pivots of its keys, one of them itself if it is a pivot."""
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # the keys of one id are as many as there are bands, or as its text has differences
    mine = cut(keys.join(sizes, "key").groupBy("id").agg(F.sum("n").alias("score"), F.collect_set("key").alias("keys")))
    each = mine.select("id", "score", F.explode("keys").alias("key"))
    pivots = each.groupBy("key").agg(F.max_by("id", F.struct("score", "id")).alias("p"))
    out = cut(each.select("id", "key").join(pivots, "key").groupBy("id").agg(F.collect_set("p").alias("ps")))
    release(mine)
    return out


def link(keys: DataFrame, ship: Callable[[DataFrame], DataFrame], least: float) -> DataFrame | None:
    """Labels (id, label) of the components of ids that share a key and have similar bags; None if no two
    are similar. keys (id, key), each pair once. ship(wanted) adds `bag` to the written table wanted
    (id, ps) from the texts."""
    kind = keys.schema["id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "binary": pa.binary()}[kind]
    wanted = stars(keys)
    if wanted.isEmpty():
        return None
    bags = cut(ship(wanted))
    rows = bags.select("id", F.explode("ps").alias("p"), "bag")
    large = large_stars(rows)
    links = cut(dealt(rows, large).repartition("p", "i", "j").sortWithinPartitions("p", "i", "j").mapInArrow(_settle(least, arrow), f"a {kind}, b {kind}"))
    out = None if links.isEmpty() else components(links)
    release(bags, wanted, large, links)
    return out
