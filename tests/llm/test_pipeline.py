"""The pipeline's stages on a small corpus with planted cases."""

import random

import corpus_pipeline as P
from descant.llm.common import cut
from tests import oracle


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    common = "the of and to in is that for it as with was on are by this be".split()
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.45 else "wo" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    clean = [(i, prose(150), "en", f"s{i % 3}", 0) for i in range(120)]
    items = [(k, prose(30)) for k in range(5)]
    copies = [(200 + i, clean[i][1], "en", "s0", 0) for i in range(10)]
    near = [(300 + i, clean[20 + i][1].replace(" the ", " THE, ", 1), "en", "s1", 0) for i in range(10)]
    leaks = [(400 + k, prose(60) + " " + items[k][1] + " " + prose(60), "en", "s2", 0) for k in range(5)]
    junk = [(500 + k, "#$% " * 100, "en", "s0", 0) for k in range(5)] + [(600, None, None, None, 0), (601, "", "en", None, 0)]
    docs = spark.createDataFrame(clean + copies + near + leaks + junk, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    kept = []
    for _, stage in P.STAGES:
        out = cut(stage(spark, docs, str(tmp_path)))
        if len(kept) < 4:
            assert out.columns == docs.columns
        kept.append(out)
        docs = out
    assert ids(kept[0]) == sorted(r[0] for r in clean + copies + near + leaks)
    assert ids(kept[1]) == sorted(r[0] for r in clean + leaks)
    assert ids(kept[2]) == list(range(120))
    mixed = ids(kept[3])
    assert set(mixed) <= set(range(120)) and max(mixed.count(i) for i in mixed) <= 2
    assert ids(kept[4]) == mixed and set(kept[4].columns) >= {"doc_id", "shard", "slot"}
    assert P.run(spark, str(tmp_path)).count() == len(mixed)
    assert [n for n, _ in P.STAGES] and P.ORACLE_SQL is None


def test_edges(spark, tmp_path):
    """Null and repeated ids are judged by what they hold; an empty table gives an empty result."""
    rng = random.Random(8)
    common = "the of and to in is that for it as with was on are by this be".split()
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.45 else "wo" + "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    item = prose(30)
    rows = [(i, prose(150), "en", "s", 0) for i in range(60)]
    leak = prose(60) + " " + item
    rows += [(7, leak, "en", "s", 0), (None, leak + " more", "en", None, 0), (None, prose(150), None, None, 0), (9, prose(20_000), "en", "s", 0), rows[3]]
    spark.createDataFrame([(1, item), (None, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = P.decontaminate_stage(spark, docs, str(tmp_path)).collect()
    assert len(left) == 63 and sum(r.doc_id == 7 for r in left) == 1 and sum(r.doc_id is None for r in left) == 1
    kept = P.near_dedup_stage(spark, docs, str(tmp_path)).collect()
    # the repeated row goes, one of the leaks, which are near copies, and one of the texts of id 7, which are one node
    assert len(kept) == len(rows) - 3
    none = docs.limit(0)
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_only_the_result_is_left(spark, tmp_path):
    """Of all tables that the stages write, what the result reads stays."""
    import glob

    top = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{top}/descant-*"))
    got = P.run(spark, oracle.SF)
    left = set(glob.glob(f"{top}/descant-*")) - before
    assert {f.removeprefix("file://").rsplit("/", 1)[0] for f in got.inputFiles()} == left and len(left) == 1
    assert got.count() > 0
