"""Costly columns are worked out once a row, however often the steps behind them read the rows."""

import random

import pytest
from pyspark.sql import functions as F

from stayflow.operators import allocation, economics


def _counted(spark, n):
    """Rows whose ``net`` counts how often it is computed."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def net(i):
        seen.add(1)
        return [0.0, (i * 37 % 101) / 5 - 3, (i * 53 % 103) / 3 - 5, (i * 71 % 107) / 2 - 9]

    return spark.range(n).select(F.col("id").alias("k"), net.asNondeterministic()("id").alias("net")), seen


def test_allocation_computes_its_rows_once(spark):
    df, seen = _counted(spark, 300)
    out, told = allocation.lagrangian_allocate(df, "net", "k", 900.0)
    assert out.count() == 300 and told["spent"] <= 900.0
    assert seen.value == 300


@pytest.mark.parametrize("costs", [economics.COSTS, [0.0, 3.0, 1.0, 3.0]])
def test_chains_by_columns_equal_those_by_array_functions(spark, costs):
    draw = random.Random(3)
    value = lambda: draw.choice([None, float("nan"), 0.0, 1.0, 2.0, 3.0, draw.uniform(-5, 30), draw.uniform(-5, 30)])
    df = spark.createDataFrame([(i, [0.0, *[value() for _ in costs[1:]]]) for i in range(60)], "k long, net array<double>")
    got = allocation.with_upgrades(df, "net", costs).withColumn("want", allocation.upgrades(F.col("net"), costs))
    assert got.where(~F.to_json("__chain").eqNullSafe(F.to_json("want"))).count() == 0
