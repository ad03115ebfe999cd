"""Near-duplicate documents: BagMinHash signatures over the multiset of five-word shingles.

Weighted Jaccard similarity of multisets: sum of minima over sum of maxima of the counts. A shingle with
count w owns the interval [0, w) of a Poisson process in time of rate 1 per unit of weight. The weight
axis is cut into dyadic parts [0, 1), [1, 2), [2, 4), ...; each part has a process of its own whose points
come in order of time, seeded by shingle and part, so equal shingles have equal points whatever their
counts. Inside a part that the count covers in part only, a point counts if its place on the weight axis,
drawn in one step at full depth from the point's own seed, lies below w. A point belongs to one of M
signature components, each of which keeps its earliest time. A shingle is done once its next point is later than all of its document's components:
long documents need about one point a shingle.

Signatures are banded; documents with equal bags are one node from the start, so a group of copies costs
one row; `graph.link` verifies overlap of whole multisets and gives the components.

Edge cases: a null or wordless text has no shingles and is a class of its own; under five words the whole
text is the one shingle; an id with several texts is one node, so its copies hang together; a row with a
null id belongs to the class of the rows with its very words, if there are any; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import graph
from .common import as_long, bag_as_set, bounded, cut, mix, normal_bytes, release, shingles, slices, word_hashes

LEAST = 0.8
#: 20 bands of 5 components: a pair of similarity 0.8 shares a band with probability 0.9996.
BANDS, ROWS = 20, 5
M = BANDS * ROWS
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95), np.uint64(0xA24BAED4963EE407)


def _unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def bag_min_hash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """Signatures (n, m) of n multisets; row k of the input says that multiset owner[k] has element[k]
    weight[k] times. Infinite where a multiset is empty."""
    with np.errstate(over="ignore"):
        # dyadic parts: part 0 is [0, 1), part j is [2**(j-1), 2**j)
        rows, parts = [np.arange(len(owner))], [np.zeros(len(owner), np.int64)]
        j, left = 1, np.flatnonzero(weight > 1)
        while len(left):
            rows.append(left)
            parts.append(np.full(len(left), j))
            left = left[weight[left] > (1 << j)]
            j += 1
        row, part = np.concatenate(rows), np.concatenate(parts)
        who, w = owner[row], weight[row].astype(np.float64)
        low = np.where(part > 0, 2.0 ** (part - 1), 0.0)
        width = np.where(part > 0, 2.0 ** np.maximum(part - 1, 0), 1.0)
        seed = mix(element[row] + part.astype(np.uint64) * _C1)
        sig = np.full(n * m, np.inf)
        time = np.zeros(len(row))
        step = 0
        while len(row):
            step += 1
            h = mix(seed + np.uint64(step) * _C2)
            time = time - np.log(_unit(h)) / width
            h2 = mix(h ^ _C3)
            hit = low + width * _unit(mix(h2 + _C1)) < w  # where the point ends, followed to full depth
            slot = who * m + ((h2 >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(sig, slot[hit], time[hit])
            go = time <= sig.reshape(n, m).max(1)[who]
            row, who, w, low, width, seed, time = (x[go] for x in (row, who, w, low, width, seed, time))
    return sig.reshape(n, m)


def counted(bag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.sort(bag)
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[edge], np.diff(np.append(edge, len(h)))


def signatures(texts: list[str]) -> tuple[list[bytes | None], np.ndarray]:
    """Digest of each text's multiset (None without words) and the band keys (n, BANDS)."""
    words, first = word_hashes([normal_bytes(t) for t in texts])
    digests, owner, element, weight = [], [], [], []
    for k in range(len(texts)):
        bag = shingles(words[first[k] : first[k + 1]])
        e, w = counted(bag)
        digests.append(hashlib.blake2b(e.tobytes() + w.tobytes(), digest_size=16).digest() if len(e) else None)
        owner.append(np.full(len(e), k))
        element.append(e)
        weight.append(w)
    sig = bag_min_hash(np.concatenate(owner), np.concatenate(element), np.concatenate(weight), len(texts))
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(texts), BANDS, ROWS)
    keys = np.zeros((len(texts), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            keys = mix(keys * _C1 + bits[:, :, i])
        keys = mix(keys + np.arange(BANDS, dtype=np.uint64) * _C2)
    return digests, keys


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, texts in slices(batch.column(2)):
            digests, keys = signatures(texts)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(texts) + 1) * BANDS, BANDS), pa.int32()), pa.array(as_long(keys.ravel())))
            own = [batch.column(i).slice(begin, len(texts)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(digests, pa.binary()), flat], names=["doc_id", "mark", "digest", "keys"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, ps, text) to (id, ps, bag)."""
    for batch in batches:
        for begin, texts in slices(batch.column(2)):
            words, first = word_hashes([normal_bytes(t) for t in texts])
            bags = [graph.pack(bag_as_set(shingles(words[first[k] : first[k + 1]]))) for k in range(len(texts))]
            own = [batch.column(i).slice(begin, len(texts)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(bags, pa.binary())], names=["id", "ps", "bag"])


def _mark(id_col: str, text: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text).cast("string"))


def marked_classes(docs: DataFrame, id_col: str, text: str, least: float) -> DataFrame:
    """(doc_id, mark, class_id) per row of docs, written; mark tells rows with other ids or texts apart."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), _mark(id_col, text).alias("mark"), F.col(text).cast("string").alias("text"))
    signed = cut(plain.mapInArrow(_sign, "doc_id long, mark long, digest binary, keys array<long>"))
    nodes = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"))
    nodes = cut(nodes.where("node is not null"))
    keys = nodes.select(F.col("node").alias("id"), F.explode("keys").alias("key")).distinct()

    def ship(wanted: DataFrame) -> DataFrame:
        texts = plain.join(bounded(wanted.withColumnRenamed("id", "doc_id"), 64), "doc_id").select("doc_id", "ps", "text")
        bags = texts.mapInArrow(_bags, f"id {kind}, ps array<{kind}>, bag binary")
        return bags if once else bags.dropDuplicates(["id", "bag"])

    kind = "bigint"
    once = signed.groupBy("doc_id", "mark").count().where("count > 1").isEmpty()
    labels = graph.link(keys, ship, least)
    own = signed.join(nodes.select("digest", "node"), "digest", "left").select("doc_id", "mark", F.coalesce("node", "doc_id").alias("node"))
    if labels is not None:
        own = own.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("node", F.coalesce("label", "node"))
    out = cut(own.select("doc_id", "mark", F.col("node").alias("class_id")))
    release(signed, nodes, labels)
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, class_id) per row of docs; class_id is the smallest id of the class."""
    return marked_classes(docs, id_col, text, least).select("doc_id", "class_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """docs with one row of each class: the one with the smallest id, of several rows with that id any
    one, the same in each run. A null id counts as larger than all; rows without class are one class together
    if their texts are equal. All columns stay. Only marks of rows that go are joined with the texts."""
    found = marked_classes(docs, id_col, text, least)
    # rows without class_id have no id and no twin with one: their mark stands for the class
    known = found.select("mark", F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.struct("class_id", F.when(F.col("class_id").isNull(), F.col("mark")).alias("own")).alias("class"))
    best = known.groupBy(F.col("class").alias("of")).agg(F.min(F.struct("unnamed", "doc_id", "mark")).alias("best"))
    stays = known.join(best, F.col("class").eqNullSafe(F.col("of"))).select("mark", (F.col("mark") == F.col("best.mark")).alias("stays"))
    verdict = cut(stays.groupBy("mark").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"))
    gone = cut(verdict.where("not stays").select(F.col("mark").alias("__mark")))
    twice = cut(verdict.where("stays").select(F.col("mark").alias("__mark")))
    left = docs.withColumn("__mark", _mark(id_col, text)).join(bounded(gone), "__mark", "left_anti")
    if not twice.isEmpty():
        left = left.join(bounded(twice), "__mark", "left_anti").unionByName(left.join(bounded(twice), "__mark", "left_semi").dropDuplicates(["__mark"]))
    release(found, verdict)
    return left.select(*docs.columns)
