"""Small checkpoints are read by few tasks, however many partitions the shuffle before them had."""

from pyspark.sql import functions as F

from tickloom.llm import common
from tickloom.llm.components import components


def partitions(df):
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def test_small_checkpoints_are_read_by_few_tasks(spark):
    numbers = common.cut(spark.range(500).select(F.col("id").alias("node")).repartition(60))
    texts = common.cut(spark.range(500).select(F.col("id").alias("node"), F.col("id").cast("string").alias("text")).repartition(60))
    assert partitions(numbers) == partitions(texts) == 60
    for frame in (numbers, texts):
        small = common.if_small(frame)
        assert partitions(small) <= spark.sparkContext.defaultParallelism and small.count() == 500
    assert partitions(common.if_small(numbers, 100)) == 60


def test_rows_set_the_number_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "TASK_ROWS", 20)
    numbers = common.cut(spark.range(500).select("id").repartition(60))
    assert partitions(common.if_small(numbers)) == 25


def test_components_read_few_edges_by_few_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    tracker = spark.sparkContext.statusTracker()
    try:
        edges = common.cut(spark.createDataFrame([(k, k + 1) for k in range(12)] + [(50, 51), (60, 60)], "a long, b long").repartition(40))
        spark.sparkContext.setJobGroup("components", "components")
        found = components(edges).collect()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("components")]
        stages = [tracker.getStageInfo(s) for j in jobs if j for s in j.stageIds]
        # Both directions of the edges would be read by 80 tasks.
        assert max(s.numTasks for s in stages if s) < 80
        assert sorted((r["node"], r["component"]) for r in found) == [(k, 0) for k in range(13)] + [(50, 50), (51, 50), (60, 60)]
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
