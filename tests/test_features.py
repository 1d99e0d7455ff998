"""One definition of a feature for tables, the newest candles and streams; typed parameters; discovery."""

import datetime as dt
import math
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from tickloom.functions import features, registry
from tickloom.streaming.candles import run_available
from tickloom.streaming.features import updates

T0 = dt.datetime(2024, 1, 1)
WANTED = [("rsi", {"length": 5}), ("close", {}), ("macd", {}), ("macd", {"fast": 3, "slow": 7, "signal": 4}, "_short"), ("bollinger", {"width": 1}), ("atr", {"length": 6})]


def candles(spark, n=300, symbols=("A", "B")):
    rows = []
    for k, s in enumerate(symbols):
        for i in range(n if k == 0 else n // 30):
            c = 100 + 10 * math.sin(i / 7 + k) + (i * 37 % 11) / 5
            rows.append((s, T0 + dt.timedelta(hours=i), c - 0.5, c + 1 + i % 3, c - 1.5, c, 10 + i))
    return spark.createDataFrame(rows, "symbol string, timestamp timestamp, open_price double, high_price double, low_price double, close_price double, volume long")


def values(df, names):
    return {(r.symbol, r.timestamp): tuple(r[n] for n in names) for r in df.collect()}


def alike(a, b):
    return all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-8) for x, y in zip(a, b, strict=True))


def test_three_ways_agree(spark, tmp_path):
    rows, names = candles(spark), [c for one in registry.chosen(WANTED) for c in one.columns.values()]
    want = values(registry.compute(rows, WANTED), names)
    assert len(names) == 12 and len(want) == 310
    source = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    middle = T0 + dt.timedelta(hours=101)
    for part in (F.col("timestamp") < middle, F.col("timestamp") >= middle):
        rows.where(part).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        run_available(updates(source(), WANTED), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("late").count() == 0
    got = values(got, names)
    assert got.keys() == want.keys() and all(alike(got[k], want[k]) for k in want)
    newest = values(registry.latest(rows, WANTED), names)
    ends = {k: v for k, v in want.items() if k[1] == max(t for s, t in want if s == k[0])}
    assert newest.keys() == ends.keys() and all(alike(newest[k], ends[k]) for k in ends)


def test_latest_computes_the_last_days_only(spark, monkeypatch):
    seen = []
    batch = registry.FEATURES["bollinger"].batch
    watched = registry.Definition("watched", lambda df, p: (seen.append(df.count()), batch(df, p))[1], features.Bands, reach=lambda p: p.length - 1)
    monkeypatch.setitem(registry.FEATURES, "watched", watched)
    rows = candles(spark, 24 * 30, ("A",))
    got = registry.latest(rows, [("watched", {"length": 30})]).first()
    assert seen == [48] and abs(got.bb_middle - registry.compute(rows, [("bollinger", {"length": 30})]).orderBy("timestamp").collect()[-1].bb_middle) < 1e-9


def test_late_candles_change_nothing(spark, tmp_path):
    rows = candles(spark, 40, ("A",))
    late = rows.where("hour(timestamp) < 3").unionByName(rows.limit(1).withColumn("timestamp", F.lit(None).cast("timestamp")))
    source = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    last = T0 + dt.timedelta(hours=39)
    for part in (rows.where(F.col("timestamp") < last), late.unionByName(rows.where(F.col("timestamp") == last))):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        run_available(updates(source(), [("rsi", {"length": 3})]), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.late, r.n) for r in got.groupBy("late").agg(F.count("*").alias("n")).collect()} == {(False, 40), (True, 7)}
    assert got.where("late AND rsi_3 IS NOT NULL").count() == 0
    want = values(registry.compute(rows, [("rsi", {"length": 3})]), ["rsi_3"])
    assert all(alike(v, want[k]) for k, v in values(got.where("NOT late"), ["rsi_3"]).items())


def test_parameters_are_typed():
    assert registry.create("nobody") is None
    one = registry.create("bollinger", {"width": 3, "type": "bollinger"}, "_wide")
    assert one.parameters == features.Bands(20, 3.0) and one.metadata()["columns"] == ["bb_middle_wide", "bb_upper_wide", "bb_lower_wide"]
    assert one.metadata()["role"] == "observation_space" and registry.create("close").metadata()["role"] == "reward_engineering"
    for name, bad in (("rsi", {"length": "9"}), ("rsi", {"length": True}), ("rsi", {"size": 9}), ("rsi", {"length": 0}), ("macd", {"fast": 30}), ("rsi", {"type": "atr"}), ("close", {"x": 1})):
        with pytest.raises(ValueError):
            registry.create(name, bad)
    with pytest.raises(KeyError):
        registry.chosen([("nobody", {})])
    with pytest.raises(ValueError, match="twice"):
        registry.chosen([("macd", {}), ("macd", {"fast": 3})])
    assert registry.supported(["rsi", "nobody"]) == {"rsi": True, "nobody": False}


def test_a_feature_of_a_table_alone(spark, monkeypatch):
    @dataclass(frozen=True)
    class Needed:
        factor: float

    monkeypatch.setattr(registry, "FEATURES", dict(registry.FEATURES))
    registry.feature("scaled", parameters=Needed, columns=lambda p: ["scaled"])(lambda df, p: df.withColumn("scaled", F.col("close_price") * p.factor))
    registry.feature("plain")(lambda df, p: df.withColumn("plain", F.lit(p.get("x", 1))))
    rows = candles(spark, 5, ("A",))
    monkeypatch.setattr(features, "Needed", Needed, raising=False)
    got = registry.compute(rows.withColumn("scaled", F.lit("mine")), [("scaled", {"factor": 2}, "_2"), ("plain", {"x": 7})]).first()
    assert (got.scaled, got.scaled_2, got.plain) == ("mine", got.close_price * 2, 7)
    with pytest.raises(ValueError):
        registry.create("scaled")
    with pytest.raises(ValueError, match="plain"):
        updates(rows, [("rsi", {}), ("plain", {})])


def test_discovery(tmp_path, monkeypatch, caplog):
    monkeypatch.setattr(registry, "FEATURES", dict(registry.FEATURES))
    package = tmp_path / "own_features"
    package.mkdir()
    (package / "__init__.py").write_text("")
    (package / "broken.py").write_text("import no_such_module_at_all")
    (package / "good.py").write_text("from tickloom.functions.registry import feature\n\n\n@feature('own')\ndef own(df, p):\n    return df\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert registry.discover("own_features") == ["own"] and "broken" in caplog.text
    assert registry.discover("no_such_package_at_all") == []
    with pytest.raises(ValueError):
        registry.discover(" ")
