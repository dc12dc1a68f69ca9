"""Bootstrap replicates: rows computed once, hashes compared by their digits."""

import math

from pyspark.sql import functions as F

from stayflow.operators import economics
from stayflow.operators.splits import hashed, uniform


def test_bootstrap_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(i):
        seen.add(1)
        return i / 7

    df = spark.range(300).select(F.col("id").alias("k"), value.asNondeterministic()("id").alias("v")).coalesce(1)
    got = economics.bootstrap_differences(df, "k", {"one": F.col("v"), "none": F.lit(0.0)}, "none", 20).collect()
    assert seen.value == 300 and len(got) == 1


def test_hex_digits_compare_as_the_numbers_do(spark):
    cut = 0.36787944117144233
    rows = spark.range(2000).withColumn("h", F.substring(hashed(7, "id"), 1, 12)).withColumn("u", uniform(7, "id"))
    assert rows.where((F.col("h") >= f"{math.ceil(cut * (1 << 48)):012x}") != (F.col("u") >= cut)).count() == 0
