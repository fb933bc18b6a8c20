from pyspark.sql import functions as F

from quillfold.operators import eligibility
from quillfold.session import FEW_ROWS, read_table, spread


def _tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_a_scan_of_one_task_is_dealt_anew(spark, tmp_path):
    rows = 5 * FEW_ROWS
    spark.range(rows).withColumn("t", F.lit("x")).coalesce(1).write.parquet(f"{tmp_path}/one.parquet")
    spark.range(rows).repartition(4).write.parquet(f"{tmp_path}/four.parquet")
    spark.range(FEW_ROWS).coalesce(1).write.parquet(f"{tmp_path}/few.parquet")
    one = read_table(spark, str(tmp_path), "one")
    dealt = spread(one, "id")
    assert _tasks(one) == 1 and _tasks(dealt) > 2 and sorted(dealt.collect()) == sorted(one.collect())
    for name in ("four", "few"):
        df = read_table(spark, str(tmp_path), name)
        assert spread(df, "id") is df
    assert spread(one.limit(0), "id").collect() == []


def test_a_filter_on_the_decision_does_not_screen_again(spark):
    listed = spark.createDataFrame([(1, "must be a resident of ohio"), (2, "resident of texas")], "listing_id int, requirements_text string")
    screened = eligibility.screen_eligibility(listed, eligibility.Profile(state_names=("texas",)))
    matches = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("RLIKE")
    found = eligibility.drop_disqualified(screened)
    assert [r.listing_id for r in found.collect()] == [2]
    assert matches(found) == matches(screened.select("decision")) > 0
