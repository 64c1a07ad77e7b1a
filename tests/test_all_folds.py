"""Walk-forward folds of a series longer than a hundred blocks."""

from pyspark.sql import functions as F

from tidemark.operators import stats


def test_folds_go_on_to_the_last_label(spark):
    labels = spark.range(307).select(F.lit("s").alias("series"), F.col("id").alias("idx"), F.col("id").alias("start"), (F.col("id") + 1).alias("available"))
    got = [(r["fold"], r["idx"]) for r in stats.walk_forward(labels, 3, 2).filter("role = 'test'").collect()]
    assert sorted(got) == [((i - 3) // 2, i) for i in range(3, 307)]
