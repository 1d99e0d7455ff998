"""How many rows the steps of `components.links` make: one for each node, and one shuffle of the buckets."""

import random

import numpy as np

from tickloom.llm.bag_minhash import bags, ranked
from tickloom.llm.components import CELLS, cells, crowded, prefixes


def test_buckets_are_shuffled_once(spark):
    rows = [(b, i) for b in range(50) for i in range(b % 3)] + [(7, 0), (8, 1)]
    members = spark.createDataFrame(rows, "bucket long, id long").repartition(3)
    found = crowded(members)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "Join" not in plan
    assert found._jdf.queryExecution().sparkPlan().toString().count("Exchange") <= 1
    expected = {(b, i, 0) for b in range(50) if b % 3 == 2 for i in range(2)}
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_prefixes_are_one_row_a_node(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(90):
        words = list(base)
        for _ in range(k % 7):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        texts.append((k, " ".join(words)))
    found = {r["node"]: r for r in ranked(spark.createDataFrame(texts, "node long, text string").repartition(5), 0.8).collect()}
    assert sorted(found) == list(range(90))
    owner, element, weight, _ = bags([t for _, t in texts])
    counters = np.bincount(cells(element), minlength=CELLS)
    want = prefixes(owner, element.view(np.int64), weight, len(texts), counters, 0.8)
    rare = want["df"] > 1
    for k in range(90):
        mine = rare & (want["owner"] == k)
        assert found[k]["element"] == want["element"][mine].tolist() and found[k]["before"] == want["before"][mine].tolist()
        assert abs(found[k]["central"] - want["central"][want["owner"] == k][0]) < 1e-9
