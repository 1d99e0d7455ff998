"""Hand-checked cases, and properties that hold for any input."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tickloom.functions import indicators, registry
from tickloom.functions.timeframe import period_start
from tickloom.operators import coverage, dataset, ordered, stats
from tickloom.operators.resample import resample, roll_up
from tickloom.sources import candles as cs
from tickloom.sources import feature_store as fs
from tickloom.sources import versioned

T0 = dt.datetime(2024, 1, 1, 10)
SCHEMA = "symbol string, timestamp timestamp, open_price double, high_price double, low_price double, close_price double, volume long"


def candles(spark, closes, step=60, symbol="EURUSD", start=T0):
    rows = [(symbol, start + dt.timedelta(seconds=step * i), c, c + 1, c - 1, c, 100) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, SCHEMA)


def test_two_minutes_make_one_candle(spark):
    rows = [("E", T0, 100.0, 100.2, 99.8, 100.1, 1000), ("E", T0 + dt.timedelta(minutes=1), 100.1, 100.3, 99.9, 100.2, 1500)]
    r = resample(spark.createDataFrame(rows, SCHEMA), "5m").first()
    assert (r.timestamp, r.open_price, r.high_price, r.low_price, r.close_price, r.volume) == (T0, 100.0, 100.3, 99.8, 100.2, 2500)


def test_period_starts(spark):
    one = spark.createDataFrame([(dt.datetime(2024, 1, 1, 14, 33, 45),)], "ts timestamp")
    got = one.select(*[period_start(F.col("ts"), t).alias(t) for t in ("15m", "30m", "4h", "1d", "1w", "1M")]).first()
    assert [str(x)[:16] for x in got] == ["2024-01-01 14:30", "2024-01-01 14:30", "2024-01-01 12:00", "2024-01-01 00:00", "2024-01-01 00:00", "2024-01-01 00:00"]


def test_duplicates_are_summed(spark):
    volumes = [1000, 500, 1000, 800, 1200, 600]
    rows = [("E", T0 + dt.timedelta(minutes=i // 2), 1.0, 1.0, 1.0, 1.0, v) for i, v in enumerate(volumes)]
    r = resample(spark.createDataFrame(rows, SCHEMA), "5m").first()
    assert (r.volume, r.source_rows) == (5100, 6)


def test_rolled_candles_equal_direct_ones(spark):
    base = candles(spark, [float(i * 37 % 101) for i in range(600)], 420)
    direct = None
    for tf in ("15m", "1h", "4h", "1d", "1w"):
        one = resample(base, tf)
        direct = one if direct is None else direct.unionByName(one)
    key = lambda df: sorted(map(tuple, df.select("timeframe", "timestamp", "open_price", "close_price", "volume", "source_rows").collect()))
    assert key(direct) == key(roll_up(base, ["15m", "1h", "4h", "1d", "1w"]))


@pytest.mark.parametrize("length", [2, 14])
def test_rsi_equals_the_plain_loop(spark, length):
    closes = [100 + (i * 7919 % 53) / 7 + i / 50 for i in range(1500)]
    got = [r.rsi for r in indicators.rsi(candles(spark, closes, 600), length).orderBy("timestamp").collect()]
    up = down = 0.0
    for i in range(1, len(closes)):
        gain, loss = max(closes[i] - closes[i - 1], 0), max(closes[i - 1] - closes[i], 0)
        if i <= length:
            up, down = up + gain / length, down + loss / length
        else:
            up, down = (up * (length - 1) + gain) / length, (down * (length - 1) + loss) / length
        if i >= length:
            assert got[i] == pytest.approx(100 - 100 / (1 + up / down) if down else 100, abs=1e-9)
        else:
            assert got[i] is None


def test_higher_timeframe_never_looks_ahead(spark):
    day = dt.datetime(2024, 1, 1)
    base = candles(spark, [1.0] * 9, 3600, start=day + dt.timedelta(hours=9))
    higher = spark.createDataFrame([("EURUSD", day + dt.timedelta(hours=8), 55.0), ("EURUSD", day + dt.timedelta(hours=12), 65.0)], "symbol string, timestamp timestamp, RSI double")
    got = {r.timestamp.hour: r["HTF-240_RSI"] for r in dataset.merge_higher(base, higher, 240, ["symbol"]).collect()}
    assert [got[h] for h in (9, 11, 12, 15, 16, 17)] == [None, None, 55.0, 55.0, 65.0, 65.0]


def test_asof_carries_over_days_and_respects_tolerance(spark):
    left = candles(spark, [1.0] * 5, 86400)
    right = spark.createDataFrame([("EURUSD", T0, 7.0)], "symbol string, at timestamp, v double")
    assert [r.v for r in ordered.asof(left, right, ["symbol"], "timestamp", "at").orderBy("timestamp").collect()] == [7.0] * 5
    assert [r.v for r in ordered.asof(left, right, ["symbol"], "timestamp", "at", 2 * 86400).orderBy("timestamp").collect()] == [7.0] * 3 + [None] * 2


def test_gaps(spark):
    rows = [("E", "1h", "f", T0 + dt.timedelta(hours=i), None if i in (0, 5, 6, 15, 16, 23) else 1.0) for i in range(24)]
    gaps = coverage.missing_periods(spark.createDataFrame(rows, "symbol string, timeframe string, feature string, timestamp timestamp, value double"), "1h")
    assert sorted(r.n_missing for r in gaps.collect()) == [1, 1, 2, 2]


def test_split(spark):
    got = dataset.split(candles(spark, [1.0] * 100), ["symbol"], 0.7, 0.2, 0.1).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 70, "validation": 20, "test": 10}
    with pytest.raises(ValueError):
        dataset.split(candles(spark, [1.0]), ["symbol"], 0.7, 0.4, 0.3)


def test_feature_store_appends_once(spark, tmp_path):
    rows = candles(spark, [float(i) for i in range(50)], 3600).withColumnRenamed("timestamp", "event_timestamp").select("symbol", "event_timestamp", "close_price")
    path = str(tmp_path / "store")
    assert [fs.append(spark, rows, path, "close_price"), fs.append(spark, rows, path, "close_price")] == [50, 0]
    assert fs.read(spark, path).count() == 50
    with pytest.raises(ValueError):
        fs.append(spark, rows.drop("event_timestamp"), path, "close_price")


def test_candle_table_upsert(spark, tmp_path):
    rows = candles(spark, [1.0] * 30, 3600).withColumn("timeframe", F.lit("1h"))
    path = str(tmp_path / "candles")
    cs.save(spark, rows, path)
    cs.save(spark, rows.limit(5).withColumn("close_price", F.lit(1.5)), path)
    got = versioned.read(spark, path)
    assert (got.count(), got.where("close_price = 1.5").count()) == (30, 5)


def test_csv_source(spark, tmp_path):
    (tmp_path / "EURUSD_1h.csv").write_text("Time\tOpen\tHigh\tLow\tClose\tVolume\tX\n2008-10-03 00:00:00\t1.1\t1.2\t1.0\t1.15\t10\t0\n2008-10-03 01:00:00\t1.1\t1.2\t1.0\t1.16\t\t0\n")
    got = cs.read_csv(spark, str(tmp_path)).orderBy("timestamp").collect()
    assert [(r.symbol, r.timeframe, r.close_price, r.volume) for r in got] == [("EURUSD", "1h", 1.15, 10), ("EURUSD", "1h", 1.16, 0)]


def test_registry():
    assert registry.matching_column(["a", "rsi_14_x"], "rsi_9", "rsi") == "rsi_14_x"
    assert len(registry.parameter_sets([{"length": 14}, {"length": 14}, {"length": 9, "enabled": False}])) == 1
    with pytest.raises(ValueError):
        registry.feature("rsi")(lambda df, p: df)


def test_stream_equals_batch_over_two_runs(spark, tmp_path):
    from tickloom.streaming.candles import closed_candles, rsi_updates, run_available

    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows = candles(spark, [float(i % 13) for i in range(400)], 60)
    rows.limit(200).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    run_available(closed_candles(stream, "15m", "1 minute"), out, check)
    rows.where(F.col("timestamp") >= T0 + dt.timedelta(minutes=200)).coalesce(1).write.mode("append").parquet(source)
    run_available(closed_candles(spark.readStream.schema(rows.schema).parquet(source), "15m", "1 minute"), out, check)
    got = {r.timestamp: (r.open_price, r.close_price, r.volume) for r in spark.read.parquet(out).collect()}
    want = {r.timestamp: (r.open_price, r.close_price, r.volume) for r in resample(rows, "15m").collect()}
    assert len(got) >= len(want) - 2 and all(want[k] == v for k, v in got.items())
    run_available(rsi_updates(spark.readStream.schema(rows.schema).parquet(source)), str(tmp_path / "rsi"), str(tmp_path / "check2"))
    want = {r.timestamp: r.rsi for r in indicators.rsi(rows).collect()}
    got = {r.timestamp: r.rsi for r in spark.read.parquet(str(tmp_path / "rsi")).collect()}
    assert got.keys() == want.keys() and all((v is None) == (want[k] is None) and (v is None or abs(v - want[k]) < 1e-9) for k, v in got.items())


def test_bootstrap_picks_are_independent(spark):
    rng = random.Random(5)
    n, sims = 250, 200
    returns = [rng.gauss(0, 1) for _ in range(n)]
    series = spark.createDataFrame([("s", i, x) for i, x in enumerate(returns)], "strategy_id string, i long, r double")
    rows = stats.draws(series, sims).groupBy("sim").agg(F.avg("r").alias("m"), F.count_distinct("r").alias("k")).collect()
    true = statistics.pstdev(returns) / n**0.5
    assert len(rows) == sims and 0.85 < statistics.pstdev(r.m for r in rows) / true < 1.15
    assert 0.61 < statistics.mean(r.k for r in rows) / n < 0.65
