"""What the steps of `components.links` shuffle: summaries as wide as their sets need, and only the texts of pairs."""

import tracemalloc

from tickloom.llm import common, line_dedup
from tickloom.llm.bag_minhash import summed


def test_lines_have_narrow_summaries(spark):
    lines = spark.createDataFrame([(1, "the quick brown fox"), (2, "the quick brown dog")], "node long, text string")
    found = summed(lines, line_dedup.sets, line_dedup.WORDS)
    assert len(found.columns) == 6
    a, b = (r.asDict() for r in found.orderBy("node").collect())
    apart = sum(bin((a[f"bits_{k}"] ^ b[f"bits_{k}"]) & (2**64 - 1)).count("1") for k in range(line_dedup.WORDS))
    assert 0 < apart <= 6  # three shingles of each are not the other's


def test_only_texts_of_pairs_are_joined(spark):
    texts = spark.createDataFrame([(k, f"text {k}") for k in range(20)], "node long, text string")
    pairs = common.cut(spark.createDataFrame([(1, 2), (2, 5)], "a long, b long"))
    held = common.of_pairs(texts, pairs)
    assert sorted(r["node"] for r in held.collect()) == [1, 2, 5]
    assert "Exchange hashpartitioning" not in held._jdf.queryExecution().executedPlan().toString()


def test_jaccard_of_lines_with_and_without_letters():
    got = line_dedup.jaccard(["", "!!", "abc", "one two three", "one two three"], ["?", "", "abd", "One, two: three!", ""])
    assert got.tolist() == [1.0, 1.0, 0.0, 1.0, 0.0] and len(line_dedup.jaccard([], [])) == 0


def test_a_worker_hashes_few_characters_at_a_time():
    text = "\n".join("some words of line %d" % k for k in range(60_000))[: line_dedup.SLAB]
    line_dedup.line_signatures(*line_dedup.normalised([text])[:3])  # tables that are kept
    tracemalloc.start()
    line_dedup.line_signatures(*line_dedup.normalised([text])[:3])
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
