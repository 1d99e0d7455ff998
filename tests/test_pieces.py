"""Windows in pieces against plain windows; versioned tables, incremental runs and pages against whole computations."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.test_operators import T0, candles
from tickloom.functions import indicators
from tickloom.operators import incremental, ordered, pieces
from tickloom.operators.resample import roll_up
from tickloom.sources import candles as cs
from tickloom.sources import messages, versioned


def series(spark, n=400, step=3600):
    rng = random.Random(3)
    return candles(spark, [float(rng.randrange(1, 30)) for _ in range(n)], step).unionByName(candles(spark, [2.0] * 7, step, "short"))


@pytest.mark.parametrize("size", [1, 5, 64, 1000])
def test_windows_over_chunks_are_plain_windows(spark, size):
    made = lambda w: {"lagged": F.lag("close_price", 4).over(w), "mean": F.avg("close_price").over(w.rowsBetween(-4, 0)), "n": F.count(F.lit(1)).over(w.rowsBetween(-4, 0))}
    rows = series(spark)
    got = pieces.windowed(rows, ["symbol"], "timestamp", 4, made, size=size)
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.withColumns(made(Window.partitionBy("symbol").orderBy("timestamp"))).collect()))


def test_running_sums_are_plain_windows(spark):
    rows = series(spark, 300, 600).withColumn("timestamp", F.when(F.rand(1) < 0.5, F.date_trunc("hour", "timestamp")).otherwise(F.col("timestamp")))
    rows = rows.withColumn("id", F.monotonically_increasing_id()).withColumn("symbol", F.when(F.col("symbol") == "short", None).otherwise(F.col("symbol")))
    order = Window.partitionBy("symbol").orderBy("timestamp", "id").rowsBetween(Window.unboundedPreceding, 0)
    held = ordered_checkpoint(rows)
    got = pieces.running(held, ["symbol"], "timestamp", {"total": F.col("close_price"), "n": F.lit(1)}, "id")
    want = held.withColumns({"total": F.sum("close_price").over(order), "n": F.sum(F.lit(1)).over(order)})
    columns = ["symbol", "id", "total", "n"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def ordered_checkpoint(df):
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


@pytest.mark.parametrize("ranges", [2, 7, 64])
def test_ranks_by_ranges_are_plain_ranks(spark, ranges):
    rows = [("a", float(i % 40)) for i in range(300)] + [("a", 3.0)] * 200 + [("b", 1.0), ("b", None), ("c", float("nan")), ("c", -1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = sorted(map(str, pieces.ranks(df, ["k"], "v", ranges=ranges).where("v IS NOT NULL").collect()))
    w, same = Window.partitionBy("k").orderBy("v"), Window.partitionBy("k", "v")
    want = df.where("v IS NOT NULL").withColumn("rank", F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2)
    assert got == sorted(map(str, want.collect()))


def test_no_long_window_by_symbol(spark):
    """Of the windows in the plan only those over counts of days go by symbol alone."""
    made = indicators.bollinger(series(spark))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    alone = [line for line in plan.split("\n") if "Window [" in line and "_piece" not in line and "_day" not in line]
    assert "Window [" in plan and not alone


def test_frames_of_equal_columns_keep_the_first_value(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, None, "y")], "k long, v double, s string")
    b = spark.createDataFrame([(2, 5.0, 1), (3, 6.0, 2)], "k long, v double, w int")
    got = {r.k: (r.v, r.s, r.w) for r in ordered.side_by_side([a, None, b], ["k"]).collect()}
    assert got == {1: (1.0, "x", None), 2: (5.0, "y", 1), 3: (6.0, None, 2)}
    with pytest.raises(ValueError):
        ordered.side_by_side([None], ["k"])


def test_true_ranges_only_where_there_are_none(spark):
    rows = series(spark, 40)
    plain = {r.timestamp: r.atr for r in indicators.atr(rows).where("symbol = 'EURUSD'").collect()}
    kept = indicators.with_atr(rows.withColumn("atr", F.when(F.col("symbol") == "short", 7.0)))
    assert {r.atr for r in kept.collect()} == {None, 7.0}
    for made in (indicators.with_atr(rows), indicators.with_atr(rows.withColumn("atr", F.lit(None).cast("double")))):
        assert {r.timestamp: r.atr for r in made.where("symbol = 'EURUSD'").collect()} == plain
    far = indicators.normalised_distance(rows.withColumn("line", F.col("close_price") + 1), "line").where("symbol = 'EURUSD'").collect()
    assert all(r.distance == pytest.approx(1 / plain[r.timestamp]) if plain[r.timestamp] else r.distance is None for r in far)


def test_pages_are_those_of_the_whole_order(spark):
    rows = series(spark)
    want = [(r.symbol, r.timestamp) for r in rows.orderBy("symbol", "timestamp").collect()]
    for offset, limit in ((0, 3), (37, 50), (395, 9), (406, 5), (500, 5)):
        assert [(r.symbol, r.timestamp) for r in cs.page(rows, limit, offset).collect()] == want[offset : offset + limit]
    assert cs.page_days(rows, 10, 100).count() <= 10


def test_a_failed_commit_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "t"), series(spark, 100).withColumn("timeframe", F.lit("1h"))
    assert cs.save(spark, rows, path, 0)
    close = lambda: sorted(r.close_price for r in versioned.read(spark, path).collect())
    before, publish = close(), versioned._publish
    changed = rows.withColumn("close_price", F.lit(1000.0))

    def broken(*_):
        raise OSError("the cluster is gone")

    monkeypatch.setattr(versioned, "_publish", broken)
    with pytest.raises(OSError, match="gone"):
        cs.save(spark, changed, path, 1)
    assert close() == before
    monkeypatch.setattr(versioned, "_publish", publish)
    assert cs.save(spark, changed, path, 1) and close() == [1000.0] * 107
    assert not cs.save(spark, rows, path, 1) and not cs.save(spark, rows, path, 0) and close() == [1000.0] * 107
    assert versioned.expire(spark, path, ["timeframe", "date"]) > 0 and close() == [1000.0] * 107


def test_the_last_of_several_new_rows_wins(spark):
    rows = candles(spark, [1.0]).withColumn("timeframe", F.lit("1h"))
    new = rows.withColumn("close_price", F.lit(9.0)).withColumn("created_at", F.lit("2024-01-01")).unionByName(rows.withColumn("close_price", F.lit(3.0)).withColumn("created_at", F.lit("2024-01-02")))
    assert cs.upsert(rows, new).first().close_price == 3.0


@pytest.mark.parametrize("cuts", [(150,), (59, 60, 61), (0, 399)])
def test_runs_give_the_candles_of_one(spark, tmp_path, cuts):
    """Rows at the mark are counted once, and an open candle's first part is not lost between runs."""
    rows, folder = candles(spark, [float(i % 17 + 1) for i in range(400)], 60), str(tmp_path / "runs")
    held = rows.collect()
    for end in (*cuts, 399):
        incremental.run(spark, spark.createDataFrame(held[: end + 1], rows.schema), folder, ["15m", "1h"])
    got = {(r.timeframe, r.timestamp): (r.open_price, r.high_price, r.low_price, r.close_price, r.volume) for r in incremental.candles(spark, folder).collect()}
    assert got == {(r.timeframe, r.timestamp): (r.open_price, r.high_price, r.low_price, r.close_price, r.volume) for r in roll_up(rows, ["15m", "1h"]).collect()}


def test_a_run_that_fails_is_repeated_from_the_same_state(spark, tmp_path, monkeypatch):
    rows, folder = candles(spark, [float(i % 17 + 1) for i in range(200)], 60), str(tmp_path / "runs")
    incremental.run(spark, rows.limit(100), folder, ["15m"])
    commit = versioned.commit

    def broken(spark, path, *rest):
        if path.endswith("/state"):
            raise OSError("gone")
        return commit(spark, path, *rest)

    monkeypatch.setattr(versioned, "commit", broken)
    with pytest.raises(OSError):
        incremental.run(spark, rows, folder, ["15m"])
    monkeypatch.setattr(versioned, "commit", commit)
    incremental.run(spark, rows, folder, ["15m"])
    got = {r.timestamp: (r.close_price, r.volume) for r in incremental.candles(spark, folder).collect()}
    assert got == {r.timestamp: (r.close_price, r.volume) for r in roll_up(rows, ["15m"]).collect()}


def test_start_and_reset(spark, tmp_path):
    rows, folder = candles(spark, [1.0] * 120, 60), str(tmp_path / "runs")
    incremental.run(spark, rows, folder, ["1h"], start="2024-01-01 11:00:00")
    assert [r.volume for r in incremental.candles(spark, folder).collect()] == [6000]
    incremental.run(spark, rows, folder, ["1h"], reset=True)
    assert sorted(r.volume for r in incremental.candles(spark, folder).collect()) == [6000, 6000]


def test_chunks_of_messages_are_periods(spark):
    days = candles(spark, [1.0] * 30, 86_400, start=T0.replace(hour=0)).withColumn("timeframe", F.lit("1d"))
    assert messages.candle_messages(days, 1000).count() <= 2
