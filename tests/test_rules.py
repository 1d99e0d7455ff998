"""Rules that the queries' SQL can't show: picks are independent, months are whole, odd volumes, and the package alone."""

import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import stats
from tickloom.sources import candles as cs
from tickloom.sources import feature_store as fs
from tickloom.streaming.candles import closed_candles, run_available

ROOT = Path(__file__).resolve().parents[1]


def series(spark, n, seed=1):
    values = np.random.default_rng(seed).normal(0, 1, n)
    return values, spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "strategy_id string, i long, r double")


def test_bootstrap_means_spread_as_they_should(spark):
    values, frame = series(spark, 400)
    means = [x.m for x in stats.draw_stats(frame, 400).collect()]
    assert abs(np.std(means) / (values.std() / 20) - 1) < 0.12
    share = stats.draws(frame, 20).groupBy("sim").agg(F.countDistinct("r").alias("n")).agg(F.avg("n")).first()[0] / 400
    assert abs(share - (1 - np.exp(-1))) < 0.02


def test_means_of_arrays_are_those_of_rows(spark, monkeypatch):
    _, frame = series(spark, 50)
    held = {x.sim: x.m for x in stats.draw_stats(frame, 130).collect()}
    monkeypatch.setattr(stats, "LONGEST", 10)
    rows = {x.sim: x.m for x in stats.draw_stats(frame, 130).collect()}
    assert held.keys() == rows.keys() == set(range(130)) and all(abs(held[k] - rows[k]) < 1e-12 for k in held)


def test_bootstrap_p_value_by_plain_python(spark):
    import hashlib

    values, frame = series(spark, 30, 4)
    centred = values - values.mean()
    pick = lambda sim, k: int(hashlib.md5(f"7:{sim}:{k}".encode()).hexdigest()[:8], 16) % 30
    means = [np.mean([centred[pick(sim, k)] for k in range(30)]) for sim in range(60)]
    got = stats.bootstrap_test(frame, 60).first()
    side = 1 if values.mean() > 0 else -1
    assert abs(got.p_mean - np.mean([side * m >= side * values.mean() for m in means])) < 1e-9
    drawn = [values[[pick(sim, k) for k in range(30)]] for sim in range(60)]
    ratio = values.mean() / (values.std(ddof=1) + 1e-10)
    assert abs(got.p_ratio - np.mean([side * d.mean() / (d.std() + 1e-10) >= side * ratio for d in drawn])) < 1e-9


def test_t_probabilities_are_those_of_the_density(spark):
    import math

    rows = [(t, df) for df in (3.0, 5.0, 12.0, 60.0, 500.0) for t in (0.0, 0.4, 1.3, -2.2, 4.0)]
    got = spark.createDataFrame(rows, "t double, df double").select("t", "df", stats.student_p(F.col("t"), F.col("df")).alias("p"), stats.student_quantile(0.975, F.col("df")).alias("q")).collect()
    for x in got:
        grid = np.linspace(0, 1, 200_001)[1:]
        beyond = lambda start: np.sum((1 + (start + (1 - grid) / grid) ** 2 / x.df) ** (-(x.df + 1) / 2) / grid**2) / 200_000 * math.exp(math.lgamma((x.df + 1) / 2) - math.lgamma(x.df / 2)) / math.sqrt(x.df * math.pi)  # noqa: E731, B023
        assert abs(x.p - 2 * beyond(abs(x.t))) < 2e-4
        assert x.df < 10 or abs(beyond(x.q) - 0.025) < 1e-5


def test_normal_paths_have_the_moments_of_the_series(spark):
    values, frame = series(spark, 300)
    drawn = stats.parametric_draws(frame, 50).agg(F.avg("r").alias("m"), F.stddev("r").alias("sd"), F.kurtosis("r").alias("k")).first()
    sd = values.std(ddof=1)
    assert abs(drawn.m - values.mean()) < 4 * sd / 15_000**0.5 and abs(drawn.sd / sd - 1) < 0.03 and abs(drawn.k) < 0.2


def test_month_candles_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    rows = [("a", f"2024-0{m}-{d:02d} 10:00:00", float(d)) for m in (1, 2, 3, 5) for d in (3, 17, 28)]
    prices = [F.col("v").alias(c) for c in ("open_price", "high_price", "low_price", "close_price")]
    made = spark.createDataFrame(rows, "symbol string, ts string, v double").select("symbol", F.to_timestamp("ts").alias("timestamp"), *prices, F.lit(1).cast("long").alias("volume"))
    for k, month in enumerate(("2024-02-10", "2024-12-31")):  # the file of a second run goes on with the first one's month
        late = F.col("timestamp") >= F.lit("2024-02-10").cast("timestamp")
        made.where(late if k else ~late).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))
        run_available(closed_candles(stream, "1M"), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {str(x.timestamp)[:7]: (x.open_price, x.high_price, x.close_price, x.volume) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {str(x.timestamp)[:7]: (x.open_price, x.high_price, x.close_price, x.volume) for x in closed_candles(made, "1M").collect()}
    assert len(batch) == 4 and {"2024-01", "2024-02", "2024-03"} == got.keys() and all(batch[k] == v for k, v in got.items())


def test_empty_volume_is_zero(spark):
    empty = spark.createDataFrame([], "symbol string, timeframe string, timestamp timestamp, open_price double, high_price double, low_price double, close_price double, volume long")
    new = spark.createDataFrame([("a", "1h", "2024-01-01", 1.0, 1.0, 1.0, 1.0, v) for v in ("",)] + [("b", "1h", "2024-01-01", 1.0, 1.0, 1.0, 1.0, "7")], "symbol string, timeframe string, ts string, open_price double, high_price double, low_price double, close_price double, volume string")
    found = cs.upsert(empty, new.withColumn("timestamp", F.to_timestamp("ts")).drop("ts"))
    assert {x.symbol: x.volume for x in found.collect()} == {"a": 0, "b": 7}


def test_time_key_needs_a_time(spark):
    with pytest.raises(ValueError):
        cs.time_key(spark.range(1))


def test_load_of_no_partition(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 10:00:00", 1.0), ("b", "2024-01-02 10:00:00", 2.0)], "symbol string, ts string, v double")
    rows = rows.select("symbol", F.to_timestamp("ts").alias("event_timestamp"), "v")
    fs.write(rows, str(tmp_path / "store"))
    assert fs.load(spark, str(tmp_path / "store"), []).count() == 0
    assert [x.v for x in fs.load(spark, str(tmp_path / "store"), [("b", "2024-01-02")]).collect()] == [2.0]


def test_works_without_the_llm_folders(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 80 and set(e.oracle_sql()) <= set(q); import bench"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={"PYTHONPATH": str(copy), "PATH": "/usr/bin:/bin"}, timeout=120)
    assert done.returncode == 0, done.stderr[-500:]


def test_csv_files_are_converted_by_symbol_and_timeframe(spark, tmp_path):
    for name, close in (("AB_1h", 2.0), ("AB_4h", 3.0)):
        (tmp_path / f"{name}.csv").write_text(f"Time\tOpen\tHigh\tLow\tClose\tVolume\tX\n2024-01-01 00:00:00\t1\t4\t1\t{close}\t5\t0\n")
    cs.convert_csv(spark, str(tmp_path / "*.csv"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "symbol=AB" / "timeframe=4h").is_dir()
    assert sorted((x.timeframe, x.close_price) for x in spark.read.parquet(str(tmp_path / "out")).collect()) == [("1h", 2.0), ("4h", 3.0)]


def test_validation_names_unknown_checks_and_counts_absent_ones_as_failed(spark):
    from tickloom.operators import checks

    ts = "timestamp'2024-01-0{} 00:00:00'"
    trades = spark.sql(f"SELECT 's' AS strategy_id, 'x' AS symbol, {ts.format(1)} AS entry_ts, CAST(NULL AS timestamp) AS exit_ts, 10.0D AS entry_price, 2.0D AS size, 1 AS direction, 5.0D AS profit, 9.0D AS stop_loss")
    equity = spark.sql(f"SELECT 's' AS strategy_id, {ts.format(1)} AS ts, 100.0D AS equity")
    with pytest.raises(KeyError, match="nothing"):
        checks.validated(trades, equity, [("nothing", {}), ("stop_loss", {})])
    rows = checks.validated(trades, equity, [("stop_loss", {}), ("win_rate", {}), ("position_size", {"limit": 3})]).collect()
    assert {(x.check, x.passed, x.all_passed) for x in rows} == {("stop_loss", True, False), ("position_size", True, False)}
    assert "met" in rows[0].explanation


def test_longest_streak_falls_from_the_balance_after_its_first_loss(spark):
    from tickloom.operators import backtest

    profits = [10.0, -10.0, -20.0, -10.0, 5.0, -1.0]
    rows = [("s", f"2024-01-{i + 1:02d} 00:00:00", p) for i, p in enumerate(profits)]
    made = spark.createDataFrame(rows, "strategy_id string, ts string, profit double").selectExpr("strategy_id", "timestamp(ts) AS exit_ts", "timestamp(ts) AS entry_ts", "profit", "1.0D AS size")
    got = backtest.longest_streaks(made, 90.0).first()
    assert got.max_losses == 3 and abs(got.streak_drawdown_pct - 100 * 30 / 90) < 1e-9


def test_no_view_of_a_role_is_an_error(spark):
    views = spark.createDataFrame([("v", "reward", "a")], "view string, feature_role string, symbol string")
    assert fs.views_of(views, "reward", "a").count() == 1
    with pytest.raises(ValueError, match="no feature view"):
        fs.views_of(views, "reward", "b")
