"""Periodic runs of words: maximal stretches that repeat a block of words back to back.

A run is a stretch whose smallest period is q, of at least max(least, times * q) words, that no neighbouring
word extends with period q kept. Runs are found from Lyndon words: in one of the two orders of the
words (one the other reversed) the longest Lyndon word at some place of a run is one period of it. So the
next smaller suffix of every place is found by a stack scanned from right to left under both orders, and
where two longest Lyndon words of one content follow each other they are extended to both sides. Suffixes
are compared and extended by the longest common extension: a binary search over rolling hashes modulo
2**61 - 1 with a random base per process. Every run that comes out is verified word by word, at most
n / 3 words a period; no suffix array is built.

Only stretches that can hold a run are scanned: all windows of least // 3 words inside a run occur in the
text again (a run has at least 2 q of them), so runs lie whole between words that no repeated window
covers. Equal windows have equal hashes, so hashes lose none. Such a stretch is scanned with real words.

Edge cases: a null text has no words; a text of one repeated word is one run of period 1; repeated rows
are told alike, in rows of their own; other columns are ignored. A text is the work of one task (about 10
bytes a word besides the text, and 60 for words inside stretches); nothing is shuffled.
"""

from __future__ import annotations

import random
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import _P, mix, shingles, slices, word_hashes

LEAST, TIMES = 24, 3
_MOD = (1 << 61) - 1
_BASE = random.SystemRandom().randrange(1 << 32, _MOD - 1)
Run = tuple[int, int, int]
RUN = "struct<start:long,length:long,period:long>"


def extensions(s: array) -> tuple[Callable[[int, int], int], Callable[[int, int], int], Callable[[int, int, int], bool]]:
    """For i < j: the common extension of s[i:] and s[j:], that of s[:i] and s[:j] to the left, and whether
    the m words at i and at j agree, all by hashes of prefixes."""
    n = len(s)
    hashes, powers = array("Q", bytes(8 * (n + 1))), array("Q", bytes(8 * (n + 1)))
    h, p = 0, 1
    powers[0] = 1
    for k, x in enumerate(s, 1):
        h, p = (h * _BASE + x + 1) % _MOD, p * _BASE % _MOD
        hashes[k], powers[k] = h, p

    def same(i: int, j: int, m: int) -> bool:
        return (hashes[i + m] - hashes[i] * powers[m] - hashes[j + m] + hashes[j] * powers[m]) % _MOD == 0

    def longest(most: int, holds: Callable[[int], bool]) -> int:
        """The largest m up to `most` for which holds(m); it holds for all smaller ones."""
        low, step = 0, 1
        while low + step <= most and holds(low + step):
            low += step
            step *= 2
        high = min(most, low + step - 1)
        while low < high:
            middle = (low + high + 1) // 2
            if holds(middle):
                low = middle
            else:
                high = middle - 1
        return low

    def right(i: int, j: int) -> int:
        return longest(n - j, lambda m: same(i, j, m))

    def left(i: int, j: int) -> int:
        return longest(i, lambda m: same(i - m, j - m, m))

    return right, left, same


def next_smaller(s: array, sign: int, right: Callable[[int, int], int]) -> array:
    """For each place the next one whose suffix is smaller in the order of sign * s; a suffix that is a
    prefix of another is the smaller one. The longest Lyndon word at i ends there."""
    n = len(s)
    after = array("q", bytes(8 * n))
    for i in range(n - 1, -1, -1):
        a, j = s[i], i + 1
        while j < n:
            x, y = a, s[j]
            if x == y:
                m = right(i, j)
                if j + m == n:
                    break
                x, y = s[i + m], s[j + m]
            if (x > y) if sign > 0 else (x < y):
                break
            j = after[j]
        after[i] = j
    return after


def runs_of(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All runs (start, length, period) of the words, by start, then period."""
    rank = {w: k for k, w in enumerate(sorted(set(words)))}
    s = array("q", map(rank.__getitem__, words))
    n = len(s)
    right, left, same = extensions(s)
    found: set[Run] = set()
    for sign in (1, -1):
        ends = np.frombuffer(next_smaller(s, sign, right), np.int64)
        at = np.arange(n)
        size = ends - at
        follows = np.zeros(n, bool)
        inner = ends < n
        follows[inner] = size[ends[inner]] == size[inner]
        # chains of equal Lyndon words: each is extended from its first one
        twice = {i for i in np.flatnonzero(follows).tolist() if same(i, int(ends[i]), int(size[i]))}
        for i in twice:
            q = int(size[i])
            if i - q in twice and ends[i - q] == i:
                continue
            back = left(i, i + q)
            start, length = i - back, back + q + right(i, i + q)
            if length >= max(least, times * q) and (start, length, q) not in found and s[start : start + length - q] == s[start + q : start + length]:
                found.add((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(texts: list[bytes], k: int) -> list[list[tuple[int, int]]]:
    """Per text its stretches (first word, end) covered by windows of k words that the text holds twice."""
    hashes, first = word_hashes(texts)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    n = len(hashes)
    if n < k:
        return out
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    inside = text[: n - k + 1] == text[k - 1 :]
    starts = np.flatnonzero(inside)
    keys = mix(shingles(hashes, k)[starts] + text[starts].astype(np.uint64) * np.uint64(_P))
    order = np.argsort(keys)
    equal = keys[order[1:]] == keys[order[:-1]]
    again = np.zeros(n + 1, np.int64)
    hit = np.zeros(len(starts), bool)
    hit[order[1:][equal]] = True
    hit[order[:-1][equal]] = True
    again[starts[hit]] += 1
    again[starts[hit] + k] -= 1
    covered = np.cumsum(again)[:n] > 0
    for d in np.unique(text[covered]):
        a, b = first[d], first[d + 1]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], covered[a:b], [False]]).astype(np.int8)))
        out[d] = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
    return out


def best(found: list[Run]) -> Run | None:
    """The run of the greatest exact length / period; ties go to the smallest start, then period."""
    top = None
    for r in found:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    return top


def collapsed(words: list[bytes], found: list[Run]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        drop[start + period] += 1
        drop[start + length] -= 1
    return b" ".join(w for w, d in zip(words, np.cumsum(drop).tolist(), strict=False) if d == 0)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per row: (id, n_words, runs by start and period, best run, collapsed text)."""
    if least < 3 or times < 3:
        raise ValueError("least and times are 3 or more: a shorter run need not hold two whole Lyndon words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1).cast(pa.binary())
            for begin, part in slices(column):
                texts = [x or b"" for x in part]
                n_words, all_runs, tops, out = [], [], [], []
                for t, spans in zip(texts, stretches(texts, least // 3), strict=True):
                    words = t.split()
                    found = [(a + s, m, q) for a, b in spans if b - a >= least for s, m, q in runs_of(words[a:b], least, times)]
                    n_words.append(len(words))
                    all_runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                    top = best(found)
                    tops.append(top and dict(zip(("start", "length", "period"), top, strict=True)))
                    out.append(collapsed(words, found) if found else b" ".join(words))
                kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
                columns = [ids.slice(begin, len(texts)), pa.array(n_words, pa.int64()), pa.array(all_runs, pa.list_(kind)), pa.array(tops, kind), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[doc_id, "n_words", "runs", "best", "collapsed"])

    rows = docs.select(F.col(doc_id), F.col(text))
    kind = rows.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(run, f"`{doc_id}` {kind}, n_words long, runs array<{RUN}>, best {RUN}, collapsed string")
