"""Benchmark decontamination: BM25 retrieval with block-max WAND, then verified overlap.

The benchmark's items are the indexed texts, every passage of every document is a query. Passages are
windows of twice the longest item's words, half a window apart, so that any copy of an item lies inside
one window whole. An item's BM25 score is divided by its score against itself. Verification asks for
OVERLAP of an item's five-word shingles, so at most some words of an item may be missing; from that
follows the largest score that such a passage can lose, and the retrieval threshold is what remains for
the worst item: no verifiable item is missed by retrieval.

Retrieval has three steps, each an upper bound of the next: the sum of the largest impacts of a window's
words; per window and block of items the sum of the block maxima; then block-max WAND itself, document at
a time with pivots, over the windows that are left. Verification asks for OVERLAP of the shingles of the
whole item (question and answer) and ANSWER_OVERLAP of the words of its last sentence (the answer), both
inside the window.

The index is a table of the benchmark only: postings, and beside each term's postings the maxima of the
blocks that it is in. It holds a few numbers for each word of the items. If the items' text exceeds INDEX_BYTES,
they are indexed in several parts of at most that size, and each part is run over the documents: the
broadcast is bounded by some tens of MB.

Items of fewer than SHINGLE words have no shingle; documents hold them by chance. A document whose words are
just those of such an item is a leak.

Edge cases: null or empty texts on either side match nothing; repeated documents or items give repeated rows
once per (doc_id, item_id); other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SHINGLE, bounded, cut, normal_bytes, shingles, slices, word_hashes

OVERLAP, ANSWER_OVERLAP = 0.8, 0.5
K1, B = 1.2, 0.75
BLOCK_ITEMS = 8
INDEX_BYTES = 4 << 20
EXPANDED = 1 << 21  # (window, block) pairs looked at in one pass
_LAST = re.compile(r"(?<=[.!?])\s+(?=\S)|\n")


def answer_of(text: str) -> str:
    """The last sentence or line of several, else nothing."""
    parts = [p for p in _LAST.split(text.strip()) if p.strip()]
    return parts[-1] if len(parts) > 1 else ""


class Index:
    """Inverted index with normalised BM25 impacts of the items (id, text)."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids, words, answers = [], [], []
        self.short: defaultdict[bytes, list[int]] = defaultdict(list)
        for i, text in items:
            w = word_hashes([normal_bytes(text)])[0]
            if 0 < len(w) < SHINGLE:
                self.short[w.tobytes()].append(i)
            elif len(w):
                self.ids.append(i)
                words.append(w)
                answers.append(word_hashes([normal_bytes(answer_of(text))])[0])
        n = len(words)
        self.longest = max(map(len, words), default=1)
        self.grams = [np.unique(shingles(w)) for w in words]
        self.answers = [Counter(a.tolist()) for a in answers]
        df = Counter(t for w in words for t in set(w.tolist()))
        self.terms = np.array(sorted(df), np.uint64)
        at = {t: k for k, t in enumerate(self.terms.tolist())}
        mean = sum(map(len, words)) / n if n else 1
        self.postings: list[list[tuple[int, float]]] = [[] for _ in at]
        self.threshold = 1.0
        for item, w in enumerate(words):
            impact = {}
            for t, tf in Counter(w.tolist()).items():
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                impact[t] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            own = sum(impact.values())
            for t, x in impact.items():
                self.postings[at[t]].append((item, x / own))
            # a missing word breaks at least one shingle, so at most this many words may be missing
            may_miss = int((1 - OVERLAP) * max(len(w) - SHINGLE + 1, 1))
            lost = sum(sorted((x / own for x in impact.values()), reverse=True)[:may_miss])
            self.threshold = min(self.threshold, 1 - lost)
        self.threshold = max(1e-9, self.threshold - 1e-6)  # a verifiable item shares a word
        self.n_blocks = -(-max(n, 1) // BLOCK_ITEMS)
        self.blocks: list[tuple[list[int], list[float]]] = []
        for posting in self.postings:
            best: dict[int, float] = {}
            for item, x in posting:
                best[item // BLOCK_ITEMS] = max(x, best.get(item // BLOCK_ITEMS, 0.0))
            self.blocks.append((list(best), list(best.values())))
        # the same as flat arrays; the last term is for unknown words and has none
        self.first = np.cumsum([0, *(len(b) for b, _ in self.blocks), 0])
        self.flat = np.array([b for bs, _ in self.blocks for b in bs], np.int64), np.array([x for _, xs in self.blocks for x in xs])
        self.top = np.array([*(max(xs) for _, xs in self.blocks), 0.0])

    def block_max(self, term: int, block: int) -> float:
        ids, best = self.blocks[term]
        k = bisect_left(ids, block)
        return best[k] if k < len(ids) and ids[k] == block else 0.0

    def bounds(self, who: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """For n windows the largest sum of block maxima over all blocks; (who, term) are the windows' known terms."""
        out = np.zeros(n)
        if not len(who):
            return out
        counts = self.first[term + 1] - self.first[term]
        starts = np.flatnonzero(np.append(True, np.diff(who) > 0))
        piece = (np.cumsum(counts) - counts)[starts] // EXPANDED
        for part in np.split(np.arange(len(who)), starts[1:][np.diff(piece) > 0]):
            k = counts[part]
            at = np.repeat(self.first[term[part]] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            key, place = np.unique(np.repeat(who[part], k) * self.n_blocks + self.flat[0][at], return_inverse=True)
            np.maximum.at(out, key // self.n_blocks, np.bincount(place, self.flat[1][at], len(key)))
        return out

    def term_ids(self, words: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.zeros(len(words), np.int64)
        k = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[k] == words, k, len(self.terms))

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """All (item, score) of at least the threshold for a query of distinct terms: block-max WAND."""
        cursors = [[self.postings[t], 0, float(self.top[t]), t] for t in terms if self.postings[t]]
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0][c[1]][0])
            bound, pivot = 0.0, None
            for i, c in enumerate(cursors):
                bound += c[2]
                if bound >= self.threshold:
                    pivot = i
                    break
            if pivot is None:
                break
            item = cursors[pivot][0][cursors[pivot][1]][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0][cursors[pivot + 1][1]][0] == item:
                pivot += 1
            block = item // BLOCK_ITEMS
            if sum(self.block_max(c[3], block) for c in cursors[: pivot + 1]) < self.threshold - 1e-12:
                # nothing before the end of the block, or before the next term's item, can pass
                to = (block + 1) * BLOCK_ITEMS
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0][cursors[pivot + 1][1]][0])
                to = max(to, item + 1)
                moved = cursors[: pivot + 1]
            elif cursors[0][0][cursors[0][1]][0] == item:
                score = sum(c[0][c[1]][1] for c in cursors[: pivot + 1])
                if score >= self.threshold:
                    out.append((item, score))
                to, moved = item + 1, cursors[: pivot + 1]
            else:
                to, moved = item, [c for c in cursors[: pivot + 1] if c[0][c[1]][0] < item]
            for c in moved:
                while c[1] < len(c[0]) and c[0][c[1]][0] < to:
                    c[1] += 1
            cursors = [c for c in cursors if c[1] < len(c[0])]
        return out

    def verify(self, item: int, words: np.ndarray) -> tuple[float, float]:
        grams = self.grams[item]
        found = np.isin(grams, shingles(words, min(SHINGLE, len(words)))).mean()
        answer = self.answers[item]
        total = sum(answer.values())
        have = Counter(words.tolist())
        return float(found), sum(min(n, have[t]) for t, n in answer.items()) / total if total else 1.0

    def search(self, words: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[float, float, float]]:
        """Leaks among texts whose words start at `first` (one more at the end): (text, item) to
        (score, overlap, answer overlap), the best window's."""
        n = len(first) - 1
        size, step = 2 * self.longest, self.longest
        lengths = np.diff(first)
        n_windows = np.where(lengths > 0, np.maximum(-(-(lengths - size) // step), 0) + 1, 0)
        text = np.repeat(np.arange(n), n_windows)
        place = np.arange(len(text)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        begin = first[text] + place * step
        end = np.minimum(begin + size, first[text + 1])
        ids = self.term_ids(words)
        total = np.concatenate([[0.0], np.cumsum(self.top[ids], dtype=np.float64)])
        left = np.flatnonzero(total[end] - total[begin] >= self.threshold - 1e-6)
        leaks: dict[tuple[int, int], tuple[float, float, float]] = {}
        for k in np.flatnonzero((lengths > 0) & (lengths < SHINGLE)).tolist() if self.short else ():
            for item in self.short.get(words[first[k] : first[k + 1]].tobytes(), ()):
                leaks[k, item] = (1.0, 1.0, 1.0)
        for group in np.array_split(left, max(1, len(left) // 2048)) if len(left) else ():
            counts = end[group] - begin[group]
            owner = np.repeat(np.arange(len(group)), counts)
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin[group], counts)
            known = ids[at] < len(self.terms)
            pair = np.unique(owner[known] * (len(self.terms) + 1) + ids[at][known])
            who, term = np.divmod(pair, len(self.terms) + 1)
            edge = np.searchsorted(who, np.arange(len(group) + 1))
            bounds = self.bounds(who, term, len(group))
            for k in np.flatnonzero(bounds >= self.threshold - 1e-5).tolist():
                w, upto = group[k], edge[k + 1]
                for item, score in self.wand(term[edge[k] : upto].tolist()):
                    overlap, answer = self.verify(item, words[begin[w] : end[w]])
                    if overlap >= OVERLAP and answer >= ANSWER_OVERLAP:
                        key = (int(text[w]), self.ids[item])
                        leaks[key] = max(leaks.get(key, (0.0, 0.0, 0.0)), (score, overlap, answer))
        return leaks


def _parts(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in runs of at most INDEX_BYTES of text; the driver holds one run at a time."""
    part, size = [], 0
    for r in benchmark.toLocalIterator():
        n = len(r["text"].encode("utf-8", "surrogatepass"))
        if part and size + n > INDEX_BYTES:
            yield part
            part, size = [], 0
        part.append((r["item_id"], r["text"]))
        size += n
    if part:
        yield part


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, overlap, answer_overlap) for every document that holds an item."""
    schema = "doc_id long, item_id long, score double, overlap double, answer_overlap double"
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long"), F.col(text).cast("string"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id is not null and text is not null")
    out = None
    for part in _parts(items):
        index = spark.sparkContext.broadcast(Index(part))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            held = index.value
            for batch in batches:
                ids = batch.column(0)
                for begin, texts in slices(batch.column(1)):
                    words, first = word_hashes([normal_bytes(t) for t in texts])
                    found = held.search(words, first)
                    rows = [(ids[begin + k].as_py(), item, *map(float, v)) for (k, item), v in sorted(found.items())]
                    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.float64()] * 3, strict=True)], names=["doc_id", "item_id", "score", "overlap", "answer_overlap"])

        found = plain.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("score", "overlap", "answer_overlap")))


def keep(docs: DataFrame, benchmark: DataFrame, text: str = "text", **items: str) -> DataFrame:
    """The rows of docs whose text holds no item, with all their columns. Texts are judged, not ids."""
    mark = F.xxhash64(F.col(text).cast("string"))
    found = leaks(docs.select(mark.alias("doc_id"), F.col(text).alias("text")), benchmark, **items)
    gone = cut(found.select(F.col("doc_id").alias("__mark")).distinct())
    return docs.withColumn("__mark", mark).join(bounded(gone), "__mark", "left_anti").select(*docs.columns)
