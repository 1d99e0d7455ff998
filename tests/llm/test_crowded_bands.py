"""Buckets are met as arrays of keys: no row and no sort for each key."""

import random

from tickloom.llm import components


def test_keys_are_shuffled_as_arrays(spark, monkeypatch):
    monkeypatch.setattr(components, "GROUP", 40)
    rng = random.Random(3)
    rows = [(k, [rng.randrange(-300, 300) for _ in range(4)]) for k in range(-60, 60)]
    rows += [(k, b) for k, b in rows[:30]] + [(1000 + k, [7]) for k in range(50)] + [(5000, []), (-(2**63), [2**63 - 1]), (2**63 - 1, [2**63 - 1])]
    found = components.crowded_bands(spark.createDataFrame(rows, "id long, bands array<long>").repartition(5))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
    holders = {}
    for k, bands in rows:
        for b in bands:
            holders.setdefault(b, set()).add(k)
    want = sorted((b, k, min(ids)) for b, ids in holders.items() if len(ids) > 1 for k in ids)
    assert sorted(map(tuple, found.collect())) == want


def test_no_keys(spark):
    for rows in ([], [(1, [])], [(1, [5]), (2, [6])]):
        assert components.crowded_bands(spark.createDataFrame(rows, "id long, bands array<long>")).collect() == []
