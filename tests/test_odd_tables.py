"""Queries against their SQL on customers that the test tables don't have."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from gridloom.functions import formats, numbers

from .oracle import compare

BALANCES = [-0.0, 0.0, -0.01, -0.17, -0.5, 9999.99, 0.01, 12.0]


@pytest.fixture
def customers(tmp_path):
    values = ", ".join(f"({k}::bigint, 'Customer#{k % 5}', {k % 2}, '{b!r}'::double, '{'ABC'[k % 3]}<{k % 4}>')" for k, b in enumerate(BALANCES * 30))
    duckdb.sql(f"copy (select * from (values {values}) v(c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment)) to '{tmp_path}/customer.parquet'")
    duckdb.sql(f"copy (select k::int as n_nationkey, 'NATION & ' || k as n_name, 0 as n_regionkey from range(2) t(k)) to '{tmp_path}/nation.parquet'")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["office_cell_texts", "fx_coercions"])
def test_small_and_signed_balances(spark, customers, name):
    compare(spark, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name], customers)


def test_a_negative_zero_keeps_its_sign_as_text_but_not_under_general(spark):
    row = spark.createDataFrame([(-0.0,)], "x double").select(numbers.number_text(F.col("x")), formats.format_value(F.col("x"), "General")).first()
    assert tuple(row) == ("-0", "0")
