"""Money sums beyond 64 bits, and customer reports that need no line items."""

from decimal import Decimal

import pytest

import __spark_entry__ as entry
from basketlens.functions.core import micro_sum

SF = "/root/testdata/sf0.001"


def test_micro_sum_beyond_long(spark):
    rows = [(2**62 - 1,), (2**62 - 3,), (2**62,), (-5,), (None,)]
    total = spark.createDataFrame(rows, "m long").agg(micro_sum("m").alias("s")).first().s
    assert Decimal(total) == Decimal(3 * 2**62 - 9) / 1000000


@pytest.mark.parametrize("name", ["a1_", "a3_", "a4_", "d8_"])
def test_customer_reports_leave_lineitem_unread(spark, name):
    key = next(k for k in entry.queries() if k.startswith(name))
    plan = entry.queries()[key](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan
