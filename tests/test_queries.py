"""Every registered query of the engine's own operators against its SQL."""

import pytest
from oracle import compare

from coopspark import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    assert compare(spark, registry.queries()[name], registry.oracle_sql()[name], "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows(spark, name, sf_dir):
    assert registry.queries()[name](spark, sf_dir).count() > 0
