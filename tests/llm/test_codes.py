"""Vector codes: the tree against a scan of all entries, the whole against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from descant.llm import codes, registry


@pytest.mark.parametrize("spread", [2, 30, 5000])
def test_tree_finds_the_lowest_of_the_nearest(spread):
    rng = np.random.default_rng(spread)
    for width in (1, 3, 8):
        entries = rng.integers(-spread, spread + 1, (16, width))
        entries[5:8] = entries[1]  # equal entries
        x = np.concatenate([rng.integers(-2 * spread, 2 * spread + 1, (500, width)), entries, (entries[:-1] + entries[1:]) // 2])
        d = ((x[:, None] - entries[None]) ** 2).sum(2)
        for dtype in (np.int64, object):
            found, best = codes.nearest(codes.kd_tree(entries.astype(dtype)), entries.astype(dtype), x.astype(dtype))
            assert found.tolist() == d.argmin(1).tolist() and best.tolist() == d.min(1).tolist()
    same = np.zeros((16, 2), np.int64)
    assert codes.nearest(codes.kd_tree(same), same, same)[0].tolist() == [0] * 16


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], ""
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    each = -(-width // parts)
    cutup = lambda v: [(v + [0] * (each * parts - width))[p * each : (p + 1) * each] for p in range(parts)]
    kept = [(i, cutup(v), label) for i, v, label in kept]
    books = [[v[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        mine = [[[] for _ in b] for b in books]
        for _, v, _ in kept:
            for p in range(parts):
                mine[p][near(p, v[p])[1]].append(v[p])
        books = [[[sum(c) // len(m) for c in zip(*m, strict=True)] if m else books[p][e] for e, m in enumerate(mine[p])] for p in range(parts)]
    out, per = [], {}
    for i, v, label in kept:
        hits = [near(p, v[p]) for p in range(parts)]
        error = sum(h[0] for h in hits)
        per[label] = per.get(label, 0) + error
        out.append((i, "".join(f"{h[1]:02x}" for h in hits), error, label))
    most = 2**63 - 1
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(str((i, c, min(e, most), min(per[label], most))) for i, c, e, label in out), digest


def check(spark, rows, kind="double", **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"code": F.lit("x"), "error": F.lit(None).cast("int"), "part": F.lit(1), "id": F.lit(3)})
    frame = frame.withColumn("embedding", F.col("embedding").cast(f"array<{kind}>")).repartition(3)
    got, books = codes.compress(frame, **options)
    want = plain(rows, **options)
    assert sorted(str(tuple(r)) for r in got.collect()) == want[0]
    assert not want[0] or codes.fingerprint(books) == want[1]
    return want[0]


def test_codes_equal_plain_python(spark):
    rng = random.Random(3)
    grid = lambda w: [rng.randrange(-40, 40) / 32 for _ in range(w)]
    rows = [(k, grid(16), rng.choice([None, 1, 2])) for k in rng.sample(range(1000), 150)]
    rows += [(2000 + k, rows[7][1], 1) for k in range(60)]  # many copies
    rows += [(5, None, 1), (6, [], 1), (7, [1.0] * 15 + [None], 1), (8, [float("nan")] * 16, 1), (9, [float("inf")] + [0.0] * 15, None), (3000, [1.0] * 5, 1), (rows[0][0], grid(16), 1), (None, grid(16), 2), (None, grid(16), 2)]
    assert len(check(spark, rows)) == 213
    check(spark, rows, kind="float")
    check(spark, [(k, grid(11), k % 3) for k in range(40)], parts=4, entries=5, rounds=2)


def test_few_rows_and_large_numbers(spark):
    assert check(spark, []) == []
    assert check(spark, [(1, None, 1)]) == []
    check(spark, [(k, [k / 7] * 8, None) for k in range(3)])
    check(spark, [(k, [(-1) ** k * 3e5 * k + j for j in range(16)], k % 2) for k in range(30)])
    check(spark, [(k, [1e12 * k] * 8, 1) for k in range(20)])
    assert codes.scaled(np.array([1e300, -1e300]), 4096).tolist() == [2**62, -(2**62)]


def test_columns_of_the_query(spark, tmp_path):
    rows = [(k, [k / 9] * 8, 1) for k in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["op13_vector_codes"](spark, str(tmp_path))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.count() == 30
