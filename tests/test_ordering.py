import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from notewise.operators.ordering import ordered_within

ROWS = ([(1, i, f"t{i}" if i % 4 else None) for i in range(10)]           # NULL values among them
        + [(2, 5, "only"), (3, 7, "b"), (3, 7, "a"), (3, 900_000, "far")]  # a tie, a gap
        + [(None, i, f"n{i}") for i in range(5)]                          # NULL key
        + [(4, None, "x"), (4, None, "w"), (4, 1, "y"), (4, 4, None)]      # NULL order
        + [(None, None, None)])


@pytest.mark.parametrize("bucket_rows", [1, 3, 100_000])
def test_equals_the_plain_window(spark, bucket_rows):
    df = spark.createDataFrame(ROWS, "k int, o long, v string").repartition(3)
    w = Window.partitionBy("k").orderBy("o", "v")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    want = df.select("k", "o", "v", F.row_number().over(w).alias("pos"), F.count(F.lit(1)).over(whole).alias("n"),
                     F.lead("v").over(w).alias("next_v"), F.last("v").over(whole).alias("last_v"))
    got = ordered_within(df, "k", "o", "v", bucket_rows=bucket_rows)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.count() == len(ROWS)


def test_values_are_shuffled_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(100).selectExpr("id % 7 AS k", "id AS o", "repeat('x', 50) AS v")
        plan = ordered_within(df, "k", "o", "v", bucket_rows=3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Window" in plan and "BroadcastNestedLoop" not in plan and "Cartesian" not in plan
