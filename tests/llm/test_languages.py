"""Language identification: parts against plain versions, the whole by its accuracy on rows held out."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from descant.llm import languages, registry

SYLLABLES = {"en": "th ing and er wh ou the", "de": "sch ung ein ver der ich zu", "nl": "ij oo gen het een aan van", "fr": "eau ou ai le que ment é", "es": "ción ado que ll ñ os la", "xx": "qq zz vv kk jj ww yy"}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(k, text(rng, lang, rng.randrange(3, 60)), lang, "s", 0) for k, lang in enumerate(rng.choices(list(SYLLABLES), [9, 3, 2, 3, 3, 1], k=1200))]
    out += [(2000 + k, out[5][1], out[5][2], "s", 0) for k in range(300)]  # copies
    out += [(3000, None, "en", "s", 0), (3001, "", "de", "s", 0), (3002, "12 34 !? _ ½²", "fr", "s", 0), (3003, text(rng, "de", 30_000), "de", "s", 0), (3004, text(rng, "fr", 50), None, None, 0), (None, text(rng, "es", 50), "en", "s", 0), (3005, "語", "en", "s", 0)]
    return out


def write(spark, rows, path):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").withColumns({"id": F.lit(1), "lang_pred": F.lit("x"), "pick": F.lit(0), "held_out": F.lit(None).cast("boolean")})
    frame.repartition(3).write.parquet(f"{path}/documents.parquet")
    return registry.queries()["op12_language_id"](spark, str(path))


def test_query(spark, rows, tmp_path):
    got = write(spark, rows, tmp_path)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = {r.doc_id: r for r in got.collect()}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found.values())
    held = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {k for k, r in found.items() if r.held_out} == {r[0] for r in held}
    told = [r for r in held if r[0] < 1200]
    assert len(told) > 200 and sum(found[r[0]].lang_pred == r[2] for r in told) >= 0.97 * len(told)
    assert all(tuple(found[k])[2:] == ("und", 0.0) for k in (3000, 3001, 3002)) and found[3005].lang_pred != "und"
    assert (found[3003].lang_pred, found[3004].lang_pred, found[None].lang_pred) == ("de", "fr", "es")
    assert len({tuple(found[k])[2:] for k in (5, *range(2000, 2300))}) == 1


def test_prediction_depends_on_the_text_alone(spark, rows, tmp_path):
    """Another lang, source or extra columns of rows held out change nothing, nor does the way rows are dealt."""
    changed = [(i, t, "zz" if i is not None and zlib.crc32(str(i).encode()) % 4 == 2 else lang, "t", 1) for i, t, lang, _, _ in rows]
    a, b = (sorted(map(str, write(spark, x, tmp_path / name).collect())) for x, name in ((rows, "a"), (changed[::-1], "b")))
    assert a == b


def test_nothing_labelled_and_one_language(spark, tmp_path):
    assert [tuple(r)[2:] for r in write(spark, [(1, "abc", None, "s", 0)], tmp_path / "a").collect()] == [("und", 0.0)]
    assert write(spark, [], tmp_path / "b").count() == 0
    one = write(spark, [(k, "abc def", "en", "s", 0) for k in range(9)], tmp_path / "c").collect()
    assert {r.lang_pred for r in one} == {"en"} and {r.score for r in one} == {1.0}


def test_counts_equal_plain_counts():
    texts = ["Äb ab!", "", "x", "hello  WORLD\n9", "b" * 300]
    got = languages.counts(texts)
    for t, row in zip(texts, got, strict=True):
        alone = languages.counts([t])[0]
        assert (alone == row).all()
        padded = b" " + b" ".join("".join(c if c.isalpha() or ord(c) > 127 else " " for c in t.lower()).encode().split()) + b"  "
        assert row.sum() == 2 * (len(padded) - 2)
    assert (languages.counts(["one two"]) == languages.counts(["ONE, two"])).all()


def test_machine_parts_two_clouds():
    rng = np.random.default_rng(0)
    y = np.where(rng.random(400) < 0.2, 1, -1).astype(np.float32)
    x = (rng.normal(size=(400, 5)) + 3 * y[:, None] * np.eye(5)[1]).astype(np.float32)
    w = languages.machine(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.99


def test_families_are_listed_once():
    names = [x for langs in languages.FAMILIES.values() for x in langs.split()]
    assert len(names) == len(set(names)) and languages.family_of("de") == languages.family_of("en") != languages.family_of("fr") and languages.family_of("qx") == "qx"
