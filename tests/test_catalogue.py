"""Every registered query of the library against its SQL."""

import pytest

from oracle import compare
from qualispark import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, name, catalogue.QUERIES[name], catalogue.ORACLES[name], SF)
