"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

from gridloom import plans

from .oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    compare(spark, plans.QUERIES[name], plans.ORACLE_SQL[name], SF)
