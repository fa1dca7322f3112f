from pyspark.sql import functions as F

from convolake.operators import ranking as R


def test_group_index_matches_window(spark):
    df = spark.range(3000).select((F.col("id") % 7).cast("string").alias("g"), (F.col("id") * 7919 % 3001).alias("v"))
    df = df.withColumn("g", F.when(F.col("g") == "6", F.lit(None)).when(F.col("g") < "3", F.lit("hot")).otherwise(F.col("g")))
    got = {(r.g, r.v): r.idx for r in R.group_index(df, "g", "v").collect()}
    want = df.selectExpr("g", "v", "row_number() over (partition by g order by v) - 1 as idx").collect()
    assert got == {(r.g, r.v): r.idx for r in want}


def test_first_n_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    kept = R.first_n(df, "g", 2, F.desc("id"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sorted((r.g, r.id, r["rank"]) for r in kept.collect()) == [
        (0, 96, 2), (0, 99, 1), (1, 94, 2), (1, 97, 1), (2, 95, 2), (2, 98, 1)]
