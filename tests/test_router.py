import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.sources import router, versioned


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def frame(spark, rows):
    return spark.createDataFrame(rows, "symbol string, event_timestamp timestamp, x double")


def held(spark, path):
    return sorted((r.symbol, r.event_timestamp.day, r.x) for r in router.offline(spark, path).collect())


def test_contexts_of_the_offline_store(spark, tmp_path):
    path = str(tmp_path / "store")
    put = lambda rows, context, batch: router.route(spark, frame(spark, rows), path, context, "x", batch)
    assert put([("a", at(d), float(d)) for d in (1, 2, 3, 4)] + [("b", at(2), 2.0)], "incremental", 0)
    assert put([("a", at(4), 40.0), ("a", at(5), 6.0), ("a", at(5), 5.0)], "incremental", 1)
    assert held(spark, path) == [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0), ("a", 4, 4.0), ("a", 5, 5.0), ("b", 2, 2.0)]
    # The backfill has no row of day 3, which is empty then; another symbol keeps its own.
    assert put([("a", at(2), 20.0), ("a", at(4), 44.0)], "backfill", 2)
    wanted = [("a", 1, 1.0), ("a", 2, 20.0), ("a", 4, 44.0), ("a", 5, 5.0), ("b", 2, 2.0)]
    assert held(spark, path) == wanted
    assert not put([("a", at(1), 9.0)], "backfill", 2)  # delivered again
    assert not put([], "incremental", 3) and not put([("a", None, 1.0), ("a", at(9), 1.0)], "incremental", 3)
    assert held(spark, path) == wanted
    with pytest.raises(ValueError):
        put([("a", at(1), 1.0)], "other", 4)


def test_a_failed_backfill_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    router.route(spark, frame(spark, [("a", at(1), 1.0), ("a", at(2), 2.0)]), path, "incremental", "x", 0)
    publish, calls = versioned._publish, []

    def failing(*args):
        calls.append(args)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return publish(*args)

    monkeypatch.setattr(versioned, "_publish", failing)
    batch = frame(spark, [("a", at(1), 10.0), ("a", at(2), 20.0)])
    with pytest.raises(RuntimeError):
        router.route(spark, batch, path, "backfill", "x", 1)
    assert held(spark, path) == [("a", 1, 1.0), ("a", 2, 2.0)]
    assert router.route(spark, batch, path, "backfill", "x", 1)
    assert held(spark, path) == [("a", 1, 10.0), ("a", 2, 20.0)]


def test_views_keep_the_newest_values_in_one_version(spark, tmp_path):
    path = str(tmp_path / "online")
    views = spark.createDataFrame([("one", "observation", "a", ["x", "y"]), ("two", "observation", "a", ["z"]), ("three", "context", "b", ["x"])], "view string, feature_role string, symbol string, columns array<string>")
    each = router.push_each_batch(spark, views, "observation", "a", path)
    each(frame(spark, [("a", at(2), 2.0), ("a", at(1), 1.0), ("b", at(3), 3.0)]), 0)
    each(frame(spark, [("a", at(1), 9.0)]), 1)
    each(frame(spark, [("a", at(2), 8.0)]), 2)
    each(frame(spark, [("a", at(4), 7.0)]), 2)  # delivered again
    assert [(r.view, r.symbol, r.event_timestamp, r["values"]) for r in router.online(spark, path).collect()] == [("one", "a", at(2), {"x": 8.0})]
    assert len(versioned.finished(spark, f"{path}/manifests")) == 1
    assert spark.read.parquet(f"{path}/data").select("version").distinct().count() == 1
    with pytest.raises(ValueError):
        router.push(spark, frame(spark, [("b", at(5), 1.0)]), views, "observation", "b", path)
    assert not router.push(spark, frame(spark, [("a", at(5), 1.0)]).withColumnRenamed("x", "other"), views, "observation", "a", path)
    assert not router.materialise(spark, str(tmp_path / "none"), views, path, at(1), at(2))
    assert router.online(spark, path).where(F.col("event_timestamp") > F.lit(at(2))).count() == 0
