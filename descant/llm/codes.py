"""Vector code compression: one small codebook for each part of the vectors (product quantisation).

Components become integers, floor(scale * x), so that results do not depend on the order of sums. A
vector is cut into equal consecutive parts; each part position has a codebook of `entries` vectors that
starts from the rows of the smallest ids. In every round a kd-tree per codebook is broadcast, each part
finds its nearest entry by branch and bound, tasks send sums and counts per entry and component (their
number depends on the codebooks only), and an entry becomes the floor of its parts' mean.

The search keeps a tight box per node. A child is visited if its box is as near as the best entry so far,
or nearer: a box just as near can hold an entry at the same distance with a lower index, and the lowest
index wins ties. All rows of an Arrow batch walk the tree together, each to its nearer child first.

Edge cases: a row is dropped if its vector is null or empty or holds a null or a component that is not finite.
All vectors have the width of the kept row with the smallest id; rows of other widths are dropped. A width
that is no multiple of the number of parts is filled up with zeros. Null ids come last; equal ids are ordered
by vector. With fewer rows than entries the codebooks are smaller. Scaled components are held to +-2**62,
errors and their sums to 2**63 - 1. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded, bounded_batches, cut

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Entries of a leaf.
LEAF = 2
_LONGEST = (1 << 63) - 1
_HELD = 1 << 62


@dataclass
class Node:
    """A box around some entries of a codebook, cut in two at the median of its widest component."""

    low: np.ndarray
    high: np.ndarray
    members: list[int]
    left: Node | None = None
    right: Node | None = None


def kd_tree(entries: np.ndarray, members: list[int] | None = None) -> Node:
    members = list(range(len(entries))) if members is None else members
    inside = entries[members]
    node = Node(inside.min(0, initial=_LONGEST), inside.max(0, initial=-_LONGEST), members)
    widths = (node.high - node.low).tolist()
    if len(members) > LEAF and any(widths):
        widest = widths.index(max(widths))
        order = sorted(members, key=lambda e: (entries[e][widest], e))
        half = len(order) // 2
        node.left, node.right = kd_tree(entries, sorted(order[:half])), kd_tree(entries, sorted(order[half:]))
    return node


def _away(node: Node, x: np.ndarray) -> np.ndarray:
    """Squared distances of x to the node's box."""
    d = x - np.clip(x, node.low, node.high)
    return (d * d).sum(1)


def nearest(tree: Node, entries: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of each row of x; the lowest index wins ties."""
    found = np.full(len(x), len(entries), np.int64)
    best = np.full(len(x), 1 << 200, object) if x.dtype == object else np.full(len(x), _LONGEST, np.int64)

    def visit(node: Node, rows: np.ndarray) -> None:
        here = x[rows]
        if node.left is None:
            for e in node.members:
                d = here - entries[e]
                d = (d * d).sum(1)
                won = ((d < best[rows]) | ((d == best[rows]) & (e < found[rows]))).astype(bool)
                best[rows[won]], found[rows[won]] = d[won], e
            return
        to_left, to_right = _away(node.left, here), _away(node.right, here)
        left_first = (to_left <= to_right).astype(bool)
        for child, away, turn in ((node.left, to_left, left_first), (node.right, to_right, ~left_first), (node.right, to_right, left_first), (node.left, to_left, ~left_first)):
            go = rows[turn & (away <= best[rows]).astype(bool)]
            if len(go):
                visit(child, go)

    if len(x) and len(entries):
        visit(tree, np.arange(len(x)))
    return found, best


def scaled(values: np.ndarray, scale: float) -> np.ndarray:
    whole = np.floor(values.astype(np.float64) * scale)
    if len(whole) and np.abs(whole).max() >= _HELD:
        return np.array([max(-_HELD, min(_HELD, int(v))) for v in whole.tolist()], np.int64)
    return whole.astype(np.int64)


def _matrix(column: pa.Array, width: int, parts: int, scale: float) -> np.ndarray:
    """Rows, parts, components of a part; Python's whole numbers where squares could leave 64 bits."""
    flat = scaled(column.flatten().to_numpy(zero_copy_only=False), scale).reshape(-1, width)
    each = -(-width // parts)
    if each * parts != width:
        flat = np.pad(flat, ((0, 0), (0, each * parts - width)))
    return flat.reshape(-1, parts, each)


def _exact(x: np.ndarray, codebooks: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    largest = max([int(np.abs(a).max(initial=0)) for a in (x, *codebooks)])
    if (2 * largest) ** 2 * max(1, x.shape[1] * x.shape[2]) < _LONGEST:
        return x, codebooks
    return x.astype(object), [c.astype(object) for c in codebooks]


def _seeds(kept: DataFrame, vec_id: str, vector: str, entries: int) -> list[list[float]]:
    take = lambda rows: [r[0] for r in rows.orderBy(F.col(vec_id).asc_nulls_last(), vector).limit(entries).select(vector).collect()]
    seeds = take(kept)
    if len({len(s) for s in seeds}) > 1:
        seeds = take(kept.where(F.size(vector) == len(seeds[0])))
    return seeds


def _sums(rows: DataFrame, model, width: int, parts: int, scale: float) -> dict[tuple[int, int], tuple[int, list[int]]]:  # noqa: ANN001
    """(part, entry) -> count and sums, added up per task, then by Spark; entries times width numbers arrive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = None, None
        for batch in batches:
            books, trees = model.value
            x, books = _exact(_matrix(batch.column(0), width, parts, scale), books)
            if totals is None:
                totals = np.full((parts, len(books[0]), x.shape[2]), 0, object)
                counts = np.zeros((parts, len(books[0])), np.int64)
            for p in range(parts):
                found, _ = nearest(trees[p], books[p], x[:, p])
                part = np.zeros(totals[p].shape, x.dtype)
                np.add.at(part, found, x[:, p])
                totals[p] += part
                counts[p] += np.bincount(found, minlength=len(books[p]))
        if totals is not None:
            p, e, c = (a.ravel() for a in np.indices(totals.shape))
            used = counts[p, e] > 0
            names = ["part", "entry", "at", "total", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(p[used], pa.int32()), pa.array(e[used], pa.int32()), pa.array(c[used], pa.int32()), pa.array([Decimal(int(v)) for v in totals.ravel()[used]], pa.decimal128(38, 0)), pa.array(counts[p, e][used], pa.int64())], names=names)

    sums = rows.mapInArrow(run, "part int, entry int, at int, total decimal(38,0), n long").groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in sums.orderBy("part", "entry", "at").collect():
        out.setdefault((r["part"], r["entry"]), (r["n"], []))[1].append(int(r["total"]))
    return out


def compress(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE
) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, code, error, label_error) per kept row, and the codebook of each part."""
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits a part: at most 256 entries")
    spark = vectors.sparkSession
    bounded_batches(spark)
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    kept = vectors.select(vec_id, vector, label).where(finite & (F.size(vector) > 0))
    seeds = _seeds(kept, vec_id, vector, entries)
    width = len(seeds[0]) if seeds else 0
    kept = kept.where(F.size(vector) == width)
    first = _matrix(pa.array(seeds, pa.list_(pa.float64())), width, parts, scale) if seeds else np.zeros((0, parts, 0), np.int64)
    books = [np.ascontiguousarray(first[:, p]) for p in range(parts)]
    share = lambda: spark.sparkContext.broadcast((books, [kd_tree(b) for b in books]))
    for _ in range(rounds if seeds else 0):
        model = share()
        for (p, e), (n, totals) in _sums(kept.select(vector), model, width, parts, scale).items():
            books[p][e] = [t // n for t in totals]
        model.unpersist()
    model = share()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, trees = model.value
            x, held = _exact(_matrix(batch.column(1), width, parts, scale), held)
            found, errors = zip(*(nearest(trees[p], held[p], x[:, p]) for p in range(parts)), strict=True)
            codes = np.stack(found, 1).astype(np.uint8)
            error = [min(_LONGEST, v) for v in np.sum(errors, 0).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([c.tobytes().hex() for c in codes]), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    kind = {f.name: f.dataType.simpleString() for f in kept.schema}
    coded = cut(kept.mapInArrow(run, f"id {kind[vec_id]}, label {kind[label]}, code string, error long"))
    most = F.lit(_LONGEST).cast("decimal(38,0)")
    per_label = cut(coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error")))
    c, s = coded.alias("c"), bounded(per_label).alias("s")
    out = c.join(s, F.col("c.label").eqNullSafe(F.col("s.label"))).select(F.col("c.id").alias(vec_id), "code", "error", "label_error")
    return out, books


def fingerprint(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
