import glob
import os

import pytest

from descant.llm import registry
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no driver tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    oracle.same(registry.queries()[name](spark, oracle.SF), oracle.connect(), registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_only_what_the_result_reads_is_left(spark, name):
    top = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{top}/descant-*"))
    got = registry.queries()[name](spark, oracle.SF)
    assert got.count() > 0
    read = {f.removeprefix("file://") for f in got.inputFiles()}
    left = set(glob.glob(f"{top}/descant-*")) - before
    assert all(any(f.startswith(t + "/") for f in read) for t in left), left
