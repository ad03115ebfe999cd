"""Every library query with SQL gives the same rows in DuckDB; the others are tested against brute force elsewhere."""

import os

import pytest

from descant.plans import registry
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no driver tables")

#: Queries that SQL cannot express, and the tests of what they apply.
ELSEWHERE = {
    "joint": "test_timing.test_joint", "repair": "test_timing.test_repair_moves_a_line_between_its_anchors", "timing_prior": "test_timing.test_prior", "global_align": "test_timing.test_line_maps_equal_brute_force",
    "render_script": "test_timing.test_song_tables_and_rendering", "bundle_summary": "test_timing.test_song_tables_and_rendering",
}


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, con, name):
    oracle.same(registry.QUERIES[name](spark, oracle.SF), con, registry.SQL[name])


def test_the_others_are_tested_elsewhere():
    import importlib

    assert set(registry.QUERIES) - set(registry.SQL) == set(ELSEWHERE)
    for where in ELSEWHERE.values():
        module, name = where.split(".")
        assert callable(getattr(importlib.import_module(f"tests.{module}"), name))
