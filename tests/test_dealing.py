"""Tasks of the plain windows hold a bounded number of rows, however few partitions the session has."""

from pyspark.sql import functions as F

from quire.plans import ranks


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(ranks, "DEAL_FROM", 1000)
    monkeypatch.setattr(ranks, "TASK_ROWS", 500)
    rows = spark.range(20_000).select((F.col("id") % 1000).cast("string").alias("book_id"), F.col("id").alias("k"))
    width = ranks.Width(False, 20_000)
    counted = ranks.with_totals(ranks.number_rows(rows, ["book_id"], ["k"], "n", width), ["book_id"], {"all": F.count(F.lit(1))}, "k", width)
    tasks = counted.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in tasks) <= 1000 and len(tasks) >= 30
    plain = ranks.with_totals(ranks.number_rows(rows, ["book_id"], ["k"], "n", False), ["book_id"], {"all": F.count(F.lit(1))}, "k", False)
    assert sorted(counted.collect()) == sorted(plain.collect())
