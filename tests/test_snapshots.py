"""Bucketed snapshots: what a change rewrites, racing writers, roll-back."""

import random

import pytest

from descant.operators import catalogue as C
from descant.operators.snapshots import NotUnique, Snapshots

SCHEMA = "file_path string, state string"


@pytest.fixture
def store(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/songs", "file_path")
    s.create(rows(spark, [(f"s{k}", "new") for k in range(200)]), buckets=16)
    return s


def rows(spark, data, schema=SCHEMA):
    return spark.createDataFrame(data, schema).coalesce(1)


def paths(spark, *p):
    return rows(spark, [(x,) for x in p], "file_path string")


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_change_of_one_row_rewrites_one_bucket(spark, store):
    before = store.manifest()
    assert store.apply(upserts=rows(spark, [("s7", "ready")])) == 2
    after = store.manifest()
    changed = [k for k in range(16) if before.folders.get(k) != after.folders.get(k)]
    assert len(changed) == 1 and set(before.folders) == set(after.folders)
    assert found(store.read()) == sorted((f"s{k}", "ready" if k == 7 else "new") for k in range(200))
    assert found(store.read(1)) == sorted((f"s{k}", "new") for k in range(200))  # the old version is still whole
    look = store.lookup(paths(spark, "s7", "nothing"))
    assert found(look) == [("s7", "ready")] and len(look.inputFiles()) <= 3  # two buckets and the keys


def test_changes_equal_the_functions_on_whole_tables(spark, store):
    rng = random.Random(1)
    whole = store.read(1)
    for _ in range(4):
        pick = lambda n: rng.sample(range(220), n)
        a, b = pick(4), pick(3)
        change = {"moves": rows(spark, [(f"s{k}", f"t{k}") for k in a], "old_path string, new_path string"), "inserts": rows(spark, [(f"s{k}", "late") for k in pick(5)]), "deletes": paths(spark, *(f"s{k}" for k in b))}
        whole = C.apply_diff(whole, change["moves"], change["inserts"], change["deletes"])
        whole = spark.createDataFrame(whole.collect(), SCHEMA)
        store.apply(**change)
        assert found(store.read()) == found(whole)
    assert store.version() == 5


def test_writers_of_other_buckets_both_win_without_new_work(spark, store):
    one, two = store.prepare(upserts=rows(spark, [("s1", "a")])), None
    touched = set(one.folders)
    for k in range(2, 200):
        if set(store._touched(16, paths(spark, f"s{k}"))) != touched:
            two = store.prepare(upserts=rows(spark, [(f"s{k}", "b")]))
            break
    assert store.commit(two) == 2 and store.commit(one) == 3
    states = dict(found(store.read()))
    assert states["s1"] == "a" and states[f"s{k}"] == "b"


def test_of_two_writers_of_one_bucket_one_tries_again(spark, store):
    other = Snapshots(spark, store.root, "file_path")
    late = store.prepare(upserts=rows(spark, [("s1", "a")]))
    assert other.apply(upserts=rows(spark, [("s1", "b")])) == 2
    assert store.commit(late) is None and dict(found(store.read()))["s1"] == "b"
    assert store.apply(upserts=rows(spark, [("s1", "a")])) == 3 and dict(found(store.read()))["s1"] == "a"
    with pytest.raises(FileExistsError):
        other.create(rows(spark, [("x", "y")]), 16)


def test_broken_uniqueness_rolls_back(spark, store):
    before = store.manifest()
    two = rows(spark, [("s1", "t"), ("s2", "t")], "old_path string, new_path string")
    for change in ({"moves": two}, {"moves": rows(spark, [("s1", "s2")], "old_path string, new_path string")}, {"upserts": rows(spark, [("s1", "a"), ("s1", "b")])}):
        with pytest.raises(NotUnique):
            store.apply(inserts=rows(spark, [("fresh", "x")]), **change)
    assert store.manifest() == before and store.lookup(paths(spark, "fresh")).isEmpty()


def test_empty_changes_null_keys_and_vacuum(spark, store):
    assert store.apply(deletes=paths(spark).where("false")) == 1 and store.apply() == 1
    store.apply(inserts=rows(spark, [(None, "x"), ("n", "y")]))
    assert store.read().where("file_path IS NULL").count() == 1
    store.apply(deletes=store.read().select("file_path"))
    assert store.read().where("file_path IS NOT NULL").count() == 0
    store.apply(inserts=rows(spark, [("again", "z")]))
    assert store.vacuum(1) >= 1
    assert dict(found(store.read()))["again"] == "z"
