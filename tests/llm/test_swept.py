"""Shuffle files that no frame refers to any more are deleted while a query runs."""

import time

from tickloom.llm.components import components


def test_rounds_of_components_leave_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: manager.getAllFiles().size()
    spark.sparkContext._jvm.System.gc()
    time.sleep(3)
    before = files()
    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b").repartition(4)
    found = components(edges)
    time.sleep(3)
    now = files()
    assert now - before <= 40, (before, now)
    assert {r.component for r in found.collect()} == {0}
