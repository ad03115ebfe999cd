"""Substring dedup by paragraphs: MinHash banding, exact Jaccard, components; and exact sentence runs.

Paragraphs are the lines of at least MIN_WORDS words. Their five-word shingle sets are MinHashed into
BANDS bands of ROWS rows, tuned for recall: a pair of similarity 0.8 shares a band with probability 0.998
(above 0.9999 at 0.9), and unrelated text shares none. Paragraphs of equal words are one node; `graph.link`
verifies exact Jaccard similarity and clusters. A paragraph goes if its cluster has a document with a
smaller id.

A passage that was pasted into the middle of other paragraphs is no paragraph of its own. So lines are cut
further at sentence ends: a sentence of MIN_SENTENCE words or more whose very words a document with a
smaller id holds too is a hit, and consecutive hits with MIN_WORDS words in all go. Such sentences need no
bands: sets of similarity 1 agree in all of them. Words are compared in lower case (ASCII) without ASCII
punctuation, by 128-bit BLAKE2 digests; spans are byte offsets in the original UTF-8 text.

The texts are read twice: once to cut them, once for the bags of the paragraphs that have candidates, each
cut out of one document that holds it.

Edge cases: a null or empty text has nothing to remove; rows with a null id are neither matched nor cut;
repeated ids count as one document, whose texts never remove each other's parts; repeats inside one
document stay; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import graph
from .common import NORMAL, SHINGLE, as_long, bounded, cut, hash_ranges, mix, release, shingles, slices, split_words

MIN_WORDS, MIN_SENTENCE, LEAST = 20, 6, 0.8
BANDS, ROWS = 6, 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in NORMAL)
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Cut:
    """The words, sentences and lines of some texts. Ranges are word indices."""

    def __init__(self, texts: list[str]) -> None:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        joined = b"".join(t + b"\n" for t in raw)
        self.data = np.frombuffer(joined, np.uint8)
        self.low = joined.translate(_LOWER)
        low = np.frombuffer(self.low, np.uint8)
        self.at = np.cumsum([0, *(len(t) + 1 for t in raw)])
        self.starts, self.ends = split_words(low)
        self.words = hash_ranges(low, self.starts, self.ends)
        line_end = self.data == 10
        stop = (self.data == 46) | (self.data == 33) | (self.data == 63)
        space = (self.data == 32) | ((self.data >= 9) & (self.data <= 13))
        stop[:-1] &= space[1:]
        self.lines = self._ranges(np.flatnonzero(line_end))
        self.sentences = self._ranges(np.flatnonzero(line_end | stop))

    def _ranges(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = np.searchsorted(ends, self.starts)
        edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        return edge, np.append(edge[1:], len(of)).astype(np.int64)[: len(edge)]

    def text_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, self.starts[word], side="right") - 1

    def digests(self, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
        ranges = zip(self.starts[begin].tolist(), self.ends[end - 1].tolist(), strict=True)
        return [hashlib.blake2b(b" ".join(self.low[x:y].split()), digest_size=16).digest() for x, y in ranges]


def _long(ranges: tuple[np.ndarray, np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    keep = ranges[1] - ranges[0] >= least
    return ranges[0][keep], ranges[1][keep]


def min_hashes(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Band keys (n, BANDS) of the word ranges, each of at least SHINGLE words."""
    if not len(begin):
        return np.zeros((0, BANDS), np.uint64)
    grams = shingles(words)
    n = end - begin - SHINGLE + 1
    first = np.cumsum(n) - n
    at = np.arange(n.sum()) - np.repeat(first, n) + np.repeat(begin, n)
    g = grams[at]
    least = [np.minimum.reduceat(mix(g ^ s), first) for s in _SEEDS]
    with np.errstate(over="ignore"):
        return np.stack([mix(least[ROWS * b] * np.uint64(31) + least[ROWS * b + 1] + np.uint64(b)) for b in range(BANDS)], 1)


_UNITS = "doc_id long, mark long, digest binary, begin int, end int, place int, n_words int, keys array<long>"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, mark, text) to paragraphs and sentences; only paragraphs have keys."""
    for batch in batches:
        ids, marks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for base, texts in slices(batch.column(2)):
            c = Cut(texts)
            for ranges, least in ((c.lines, MIN_WORDS), (c.sentences, MIN_SENTENCE)):
                b, e = _long(ranges, least)
                doc = c.text_of(b)
                place = np.arange(len(b)) - np.searchsorted(doc, np.arange(len(texts)))[doc]
                if least == MIN_WORDS:
                    flat = np.ascontiguousarray(min_hashes(c.words, b, e)).ravel()
                    keys = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, BANDS), pa.int32()), pa.array(as_long(flat)))
                else:
                    keys = pa.nulls(len(b), pa.list_(pa.int64()))
                numbers = (c.starts[b] - c.at[doc], c.ends[e - 1] - c.at[doc], place, e - b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[base + doc], pa.int64()), pa.array(marks[base + doc], pa.int64()), pa.array(c.digests(b, e), pa.binary()), *(pa.array(x, pa.int32()) for x in numbers), keys],
                    names=["doc_id", "mark", "digest", "begin", "end", "place", "n_words", "keys"],
                )


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (parts, text) to (id, ps, bag) of each part (id, ps, begin, end)."""
    for batch in batches:
        for begin, texts in slices(batch.column(1)):
            parts = [(p, t) for ps, t in zip(batch.column(0).slice(begin, len(texts)).to_pylist(), (t.encode("utf-8", "surrogatepass") for t in texts), strict=True) for p in ps]
            if not parts:
                continue
            c = Cut([t[p["begin"] : p["end"]].decode("utf-8", "surrogatepass") for p, t in parts])
            bags = [graph.pack(np.unique(shingles(c.words[x:y]))) for x, y in zip(*c.lines, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([p["id"] for p, _ in parts], pa.binary()), pa.array([p["ps"] for p, _ in parts], pa.list_(pa.binary())), pa.array(bags, pa.binary())], names=["id", "ps", "bag"])


def paragraph_hits(plain: DataFrame, units: DataFrame) -> DataFrame:
    """(doc_id, mark, begin, end) of the paragraphs that go."""
    rows = units.where("keys is not null").select("doc_id", "mark", F.col("digest").alias("id"), "begin", "end", "keys")
    nodes = cut(rows.groupBy("id").agg(F.first("keys").alias("keys"), F.min(F.struct("doc_id", "mark", "begin", "end")).alias("at")))
    keys = nodes.select("id", F.explode(F.array_distinct("keys")).alias("key"))
    once = plain.groupBy("doc_id", "mark").count().where("count > 1").isEmpty()

    def ship(wanted: DataFrame) -> DataFrame:
        part = F.struct("id", "ps", "at.begin", "at.end")
        places = cut(wanted.join(nodes.select("id", "at"), "id").groupBy("at.doc_id", "at.mark").agg(F.collect_list(part).alias("parts")))  # of one text
        bags = plain.join(bounded(places, 512), ["doc_id", "mark"]).select("parts", "text").mapInArrow(_bags, "id binary, ps array<binary>, bag binary")
        return bags if once else bags.dropDuplicates(["id"])

    labels = graph.link(keys, ship, LEAST)
    placed = rows.select("doc_id", "mark", "begin", "end", "id")
    if labels is not None:
        placed = placed.join(labels, "id", "left").withColumn("id", F.coalesce("label", "id")).drop("label")
    first = placed.groupBy("id").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("id", "first")
    out = cut(placed.join(first, "id").where("doc_id > first").select("doc_id", "mark", "begin", "end"))
    release(nodes, labels)
    return out


def sentence_hits(units: DataFrame) -> DataFrame:
    """(doc_id, mark, hit) of the sentences that an earlier document holds too."""
    rows = units.where("keys is null").drop("keys")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    return rows.join(first, "digest").where("doc_id > first").select("doc_id", "mark", F.struct("place", "begin", "end", "n_words").alias("hit"))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, mark, spans, hits) to removed spans: whole paragraphs, and runs of hits long enough."""
    for batch in batches:
        out = []
        for spans, hits in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            found = [(s["begin"], s["end"]) for s in spans or []]
            run: list[dict] = []
            for h in [*sorted(hits or [], key=lambda h: h["place"]), None]:
                if run and (h is None or h["place"] > run[-1]["place"] + 1):
                    if sum(x["n_words"] for x in run) >= MIN_WORDS:
                        found.append((run[0]["begin"], run[-1]["end"]))
                    run = []
                if h is not None and not (run and run[-1]["place"] == h["place"]):
                    run.append(h)
            merged: list[list[int]] = []
            for b, e in sorted(found):
                if merged and b <= merged[-1][1]:
                    merged[-1][1] = max(e, merged[-1][1])
                else:
                    merged.append([b, e])
            out.append([{"begin": b, "end": e} for b, e in merged])
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "mark", "spans"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans) per row of docs; spans are removed byte ranges."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("mark"), F.col(text).cast("string").alias("text"))
    known = plain.where("doc_id is not null")
    units = cut(known.mapInArrow(_units, _UNITS))
    none_hit, none_span = F.lit(None).cast("struct<place:int,begin:int,end:int,n_words:int>"), F.lit(None).cast("struct<begin:int,end:int>")
    paragraphs = paragraph_hits(known, units).select("doc_id", "mark", F.struct("begin", "end").alias("span"), none_hit.alias("hit"))
    sentences = sentence_hits(units).select("doc_id", "mark", none_span.alias("span"), "hit")
    # a text's hits are bounded by the text; sets, since its row may be repeated
    gathered = paragraphs.unionByName(sentences).groupBy("doc_id", "mark").agg(F.collect_set("span").alias("spans"), F.collect_set("hit").alias("hits"))
    removed = cut(gathered.mapInArrow(_merge, "doc_id long, mark long, spans array<struct<begin:bigint,end:bigint>>"))
    release(units)
    light = plain.select("doc_id", "mark", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    full = light.join(removed, ["doc_id", "mark"], "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<begin:bigint,end:bigint>>")))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return full.select("doc_id", "n_bytes", total.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "spans")
