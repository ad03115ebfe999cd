"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from descant.llm import periodic, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if w[q:] == w[: len(w) - q])


def brute(w, least, times):
    """Every stretch by its period: runs of places that agree with the place q before."""
    out = []
    for q in range(1, len(w) // times + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if j > i and length >= max(least, times * q) and smallest_period(w[start : start + length]) == q:
                out.append((start, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,letters", [(3, 2), (3, 1), (6, 2), (6, 3), (24, 2), (24, 5)])
def test_runs_equal_brute_force(least, letters):
    rng = random.Random(least * 10 + letters)
    for _ in range(150):
        w = []
        while len(w) < 90:
            block = [rng.choice("abcde"[:letters]).encode() for _ in range(rng.randrange(1, 12))]
            w += block * rng.choice([1, 1, 2, 4, 9])
            if rng.random() < 0.4:
                w += block[: rng.randrange(len(block))]
        assert periodic.runs_of(w, least, 3) == brute(w, least, 3)


def test_fibonacci_words_and_long_powers():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 800:
        a, b = b, b + a
    assert periodic.runs_of(b, 3, 3) == brute(b, 3, 3)
    assert periodic.runs_of([b"x"] * 50_000) == [(0, 50_000, 1)]
    block = [b"w%d" % k for k in range(9_000)]
    assert periodic.runs_of([b"q", *block * 4, b"w0", b"z"]) == [(1, 36_001, 9_000)]
    assert periodic.runs_of([]) == []


def expected(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute(w, 24, 3)
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for k in range(400):
        vocabulary = rng.choice([3, 40, 500])
        w = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice([0, 1, 5, 60, 300]))]
        for _ in range(rng.randrange(3)):
            at, m = rng.randrange(len(w) + 1), rng.randrange(1, 20)
            w[at:at] = w[at : at + m] * rng.randrange(1, 30)
        rows.append((k, rng.choice([" ", "\n", "\t \r"]).join(w)))
    rows += [(None, "a b c " * 30), (7, None), (7, None), (8, ""), (9, " \n\t"), (10, "ü  é  " * 40), (11, "x"), (12, "long " * 5000), (20, "long " * 5000)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"runs": F.lit("x"), "n_words": F.lit(1), "best": F.lit(None).cast("int"), "collapsed": F.lit(True)})
    frame.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["op11_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [expected(*r) for r in rows]
    assert sum(r[1] > 0 for r in want) > 80
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert periodic.find(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.find(frame, times=2)


def test_hash_clashes_of_windows_only_widen_the_scan():
    """Were all windows equal by hash, all words would be scanned, with the same runs."""
    words = [b"a%d" % (k % 7) for k in range(40)] + [b"b%d" % k for k in range(60)]
    narrow = periodic.stretches([b" ".join(words)], 8)
    assert narrow == [[(0, 40)]]
    assert periodic.runs_of(words) == periodic.runs_of(words[:40]) == [(0, 40, 7)]
