"""Links inside hash buckets and connected components, as Spark jobs.

`links` finds the components that verified links of a set of buckets make, without writing out all pairs of a bucket:
members are compared with leaders first, and of the members that this leaves apart only pairs with a rare element in
common. `components` is the alternating large-star and small-star algorithm, with a checkpoint in the shared folder each
round. Its joins have the neighbours of a hub on one side and one row for each node on the other, so adaptive execution
can split a hub's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import BROADCAST_BYTES, cut, few_tasks, if_small, swept
from tickloom.llm.hashing import mix


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b): the component's id is its least node.

    Self links are allowed and keep a single node. Empty edges give an empty result.
    """
    loops = edges.where(F.col("a") == F.col("b")).select(F.col("a").alias("node"))
    now = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        # n edges have at most 2 n nodes of two numbers each. Where these can be sent to all tasks, edges stay in place.
        few = state["n"] <= BROADCAST_BYTES // 48
        now = few_tasks(now, state["n"]) if few else now
        if state["n"] == 0 or (state["n"], state["h"]) == before:
            break
        before = (state["n"], state["h"])
        sent = F.broadcast if few else lambda frame: frame
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(sent(least), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where(F.col("u") != F.col("v"))
        large = large if few else large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sent(least), "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = swept(cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()))
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")))
    found = found.unionByName(loops.select("node", F.col("node").alias("component")))
    return found.groupBy("node").agg(F.min("component").alias("component"))


def crowded(members: DataFrame) -> DataFrame:
    """The (bucket, id) rows of buckets that hold several ids, with the least of them, `leader`; repeated rows are one.

    The rows are shuffled once, by bucket; most of them are alone in their bucket and end there."""
    bucket = Window.partitionBy("bucket")
    ends = members.select("bucket", "id", F.min("id").over(bucket).alias("leader"), F.max("id").over(bucket).alias("most"))
    return ends.where("leader < most").select("bucket", "id", "leader").dropDuplicates(["bucket", "id"])


#: Keys that a task holds before it sends them on, and keys of a group of buckets on average.
HELD = 1 << 19
GROUP = 1 << 18


def crowded_bands(banded: DataFrame) -> DataFrame:
    """`crowded` for rows (id, bands), where `bands` are the buckets of the id.

    Keys are shuffled once, as arrays, by group of buckets: most are alone in their bucket and never become rows. There are
    as many groups as GROUP keys each need, or as shuffles have partitions, so a group stays small however many keys there
    are."""
    source = banded.where(F.size("bands") > 0).select("id", "bands")
    n = source.agg(F.sum(F.size("bands"))).first()[0] or 0
    groups = max(int(banded.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // GROUP))
    layout = "part long, buckets array<long>, ids array<long>"

    def dealt(buckets: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        bucket, node = np.concatenate(buckets), np.concatenate(ids)
        part = (mix(bucket.view(np.uint64)) % np.uint64(groups)).astype(np.uint16 if groups <= 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        part, bucket, node = part[order], bucket[order], node[order]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ends = pa.array(np.append(first, len(part)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int64)), pa.ListArray.from_arrays(ends, bucket), pa.ListArray.from_arrays(ends, node)], names=["part", "buckets", "ids"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, ids, held = [], [], 0
        for batch in batches:
            bands = batch.column("bands")
            buckets.append(bands.flatten().to_numpy(zero_copy_only=False))
            ids.append(np.repeat(batch.column("id").to_numpy(zero_copy_only=False), bands.value_lengths().to_numpy(zero_copy_only=False)))
            held += len(buckets[-1])
            if held >= HELD:
                yield dealt(buckets, ids)
                buckets, ids, held = [], [], 0
        if held:
            yield dealt(buckets, ids)

    def meet(group: pa.Table) -> pa.Table:
        bucket, node = (group.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("buckets", "ids"))
        bucket, node = _met(bucket, node)
        first = np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)]
        leader = node[first][np.cumsum(first) - 1]
        return pa.table({"bucket": bucket, "id": node, "leader": leader})

    return source.mapInArrow(deal, layout).groupBy("part").applyInArrow(meet, "bucket long, id long, leader long")


def _met(bucket: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (bucket, id) of buckets with several ids, in order."""
    order = np.argsort(bucket)
    again = bucket[order[1:]] == bucket[order[:-1]]
    order = order[np.append(False, again) | np.append(again, False)] if len(order) else order
    bucket, node = bucket[order], node[order]
    order = np.lexsort((node, bucket))
    bucket, node = bucket[order], node[order]
    new = np.append(True, (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1]))[: len(bucket)]
    bucket, node = bucket[new], node[new]
    again = bucket[1:] == bucket[:-1]
    several = (np.append(False, again) | np.append(again, False))[: len(bucket)]
    return bucket[several], node[several]


#: Buckets of more members than this are not compared pair by pair.
SMALL = 64
#: Words of 64 bits in which the parities of a set's elements are summed up, unless sets are known to be short.
BITS = 8


def summary(words: int = BITS) -> list[str]:
    """The columns of a summary."""
    return ["size", *(f"bits_{k}" for k in range(words))]


def summaries(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, words: int = BITS) -> dict[str, np.ndarray]:
    """For n sets of weighted elements: their weights, and the xor of one bit for each element of odd weight. Two sets
    differ by as much weight as bits at least, however many words there are."""
    bits = np.zeros(n * words, np.uint64)
    odd = weight % 2 == 1
    spot = mix(element[odd].astype(np.uint64))
    np.bitwise_xor.at(bits, owner[odd] * words + ((spot >> np.uint64(6)) % np.uint64(words)).astype(np.int64), np.uint64(1) << (spot & np.uint64(63)))
    return dict(zip(summary(words), [np.bincount(owner, weight, n).astype(np.int64), *bits.view(np.int64).reshape(n, words).T]))


def links(members: DataFrame, summed: DataFrame, verify: Callable[[DataFrame], DataFrame], features: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """(node, component) for the nodes that a verified link joins to another.

    members: what `crowded` gives. summed: node and `summary` of every member, checkpointed. verify: (a, b) pairs to those
    of Jaccard similarity `similarity` or more. features: (node) rows to (node, central, element, before): what `prefixes`
    gives for their sets, elements of the prefix and the weights before them as arrays.

    Every member is compared with the leaders of all its buckets. That settles buckets of two, and those whose other
    members are in one component. In what is left, pairs of different components are compared, in buckets of up to SMALL
    members; a pair is verified only if the summaries don't rule it out. Larger buckets are compared in two steps: first
    with the most central member, the one whose elements most others hold (copies of one text that differ by changes of
    their own are each nearer to it than to one another); then pairs of different components are compared which have an
    element of their prefixes in common. A prefix is the rarest elements of a set, as many as make the rest lighter than
    `similarity` of the whole: pairs at `similarity` always share one (see `prefixes`), so no link is lost, and as rare
    elements come first, few others do.
    """
    kept, possible = [c for c in summed.columns if c != "node"], _possible(similarity, len(summed.columns) - 2)
    known = if_small(summed)
    sided = lambda side: [F.col(c).alias(f"{c}_{side}") for c in kept]
    of = lambda frame, on, side: frame.join(known.select(F.col("node").alias(on), *sided(side)), on)
    first = members.where(F.col("id") != F.col("leader")).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    good = swept(cut(verify(of(of(first, "a", "x"), "b", "y").where(possible).select("a", "b"))))
    label = cut(components(good))
    stars = label.select(F.col("node").alias("a"), F.col("component").alias("b"))
    unsettled = cut(_unsettled(members.where(F.col("id") != F.col("leader")).select("bucket", "id"), label))
    # From here on only the summaries of unsettled members are wanted.
    known = if_small(cut(summed.join(if_small(cut(unsettled.select(F.col("id").alias("node")).distinct())), "node", "left_semi")))
    large = unsettled.where(F.col("n") > SMALL)
    near = unsettled.where(F.col("n") <= SMALL).select("bucket", F.col("id").alias("node"), "component").join(known, "node")
    x, y = (near.select("bucket", F.col("node").alias(f"id_{side}"), F.col("component").alias(f"component_{side}"), *sided(side)) for side in "xy")
    pairs = x.join(y, (x["bucket"] == y["bucket"]) & (F.col("id_x") < F.col("id_y")) & (F.col("component_x") != F.col("component_y")) & possible)
    more = verify(pairs.select(F.col("id_x").alias("a"), F.col("id_y").alias("b")).distinct())
    if large.isEmpty():
        more = cut(more)
        return label if more.isEmpty() else components(stars.unionByName(more))
    # Members of which no rare element is another's have no link left to find.
    ranked = cut(features(if_small(cut(large.select(F.col("id").alias("node")).distinct()))).where(F.size("element") > 0).join(known, "node"))
    weighed = large.withColumnRenamed("id", "node").join(if_small(ranked.select("node", "central", *kept)), "node")
    central = weighed.groupBy("bucket").agg(F.max(F.struct("central", "node", "component", *kept)).alias("m"))
    central = cut(central.select("bucket", F.col("m.node").alias("a"), F.col("m.component").alias("component_x"), *[F.col(f"m.{c}").alias(f"{c}_x") for c in kept]))
    second = weighed.select("bucket", F.col("node").alias("b"), "component", *sided("y")).join(if_small(central), "bucket").where((F.col("component") != F.col("component_x")) & possible)
    more = swept(cut(more.unionByName(verify(second.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))))
    label = cut(components(stars.unionByName(more)))
    stars = label.select(F.col("node").alias("a"), F.col("component").alias("b"))
    # Only members of buckets that still hold several components go on; what is known of a node is joined before its
    # elements become rows.
    left = _unsettled(large.select("bucket", "id"), label).select(F.col("id").alias("node"), "component").distinct()
    named = cut(ranked.select("node", F.arrays_zip("element", "before").alias("rare"), *kept).join(left, "node"))
    side = lambda s: named.select("node", "component", *kept, F.inline("rare")).select("element", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "component", "before", *kept)])
    x, y = side("x"), side("y")
    after = F.least(F.col("size_x") - F.col("before_x"), F.col("size_y") - F.col("before_y"))
    enough = after >= similarity / (1 + similarity) * (F.col("size_x") + F.col("size_y")) - 1e-6
    third = x.join(y, (x["element"] == y["element"]) & (F.col("node_x") < F.col("node_y")) & (F.col("component_x") != F.col("component_y")) & enough & possible)
    more = cut(verify(third.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()))
    return label if more.isEmpty() else components(stars.unionByName(more))


def _unsettled(members: DataFrame, label: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, with `component` and the bucket's number of members, `n`."""
    labelled = members.join(if_small(label.withColumnRenamed("node", "id")), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most")
    return labelled.join(if_small(cut(mixed.select("bucket", "n"))), "bucket")


#: Counters of elements by hash: a table of fixed size, made by all tasks and sent to all.
CELLS = 1 << 18


def cells(element: np.ndarray) -> np.ndarray:
    return (mix(element.view(np.uint64)) % np.uint64(CELLS)).astype(np.int64)


def prefixes(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, counters: np.ndarray, similarity: float) -> dict[str, np.ndarray]:
    """The prefix elements of n sets that another set may hold too, and each set's first element.

    Elements are ordered by df, the number of sets that hold an element of their cell, then by value; `before` is the
    weight of those earlier in the order. The prefix ends where what follows weighs less than `similarity` of the set's
    weight. If the prefixes of two sets have nothing in common, all that the sets share follows the prefix that ends
    first, so it is less than `similarity` of one of them; that holds for any order that is the same for all sets.
    `central` is the mean df of a set's elements.
    """
    df = counters[cells(element)]
    order = np.lexsort((element, df, owner))
    owner, element, weight, df = owner[order], element[order], weight[order], df[order]
    size, first = np.bincount(owner, weight, n), np.searchsorted(owner, np.arange(n + 1))
    total = np.concatenate([[0], np.cumsum(weight)])
    before = total[:-1] - total[first[owner]]
    place = np.arange(len(owner)) - first[owner] + 1
    central = np.bincount(owner, weight * df, n) / np.maximum(size, 1)
    kept = (place == 1) | ((size[owner] - before >= similarity * size[owner] - 1e-6) & (df > 1))
    return {"owner": owner[kept], "element": element[kept], "df": df[kept], "before": before[kept].astype(np.int64), "place": place[kept], "central": central[owner[kept]]}


def _possible(similarity: float, words: int) -> Column:
    """False only for two nodes that cannot reach `similarity`: by their sizes, or by the bits in which they differ."""
    a, b = F.col("size_x"), F.col("size_y")
    differ = sum((F.bit_count(F.col(f"bits_{k}_x").bitwiseXOR(F.col(f"bits_{k}_y"))) for k in range(words)), F.lit(0))
    return (F.least(a, b) >= similarity * F.greatest(a, b) - 1e-6) & (differ <= (1 - similarity) / (1 + similarity) * (a + b) + 1e-6)
