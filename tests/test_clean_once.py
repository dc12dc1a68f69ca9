"""Cleaning computes its input once, however many counts it takes."""

from pyspark.sql import functions as F

from stayflow.operators import cleaning


def test_clean_panel_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def spent(i):
        seen.add(1)
        return -5.0 if i % 40 == 0 else float(i % 90)

    rows = spark.range(400).select((F.col("id") % 300).alias("customer_id"), F.lit(1).alias("period"), F.col("id").alias("ingest_seq"), F.lit(" Ent ").alias("plan_tier"), F.lit("train").alias("split"))
    clean, log = cleaning.clean_panel(rows.withColumn("monetary_12m", spent.asNondeterministic()("ingest_seq")), k=3.0)
    told = {(r.step, r.column): r.n_affected for r in log.collect()}
    assert clean.count() == 300 and clean.where("plan_tier <> 'enterprise' OR monetary_12m < 0").isEmpty()
    assert told["drop_exact_duplicates", "*"] + told["drop_near_duplicates", "*"] == 100 and told["clip_range", "monetary_12m"] == 8
    assert seen.value == 400
