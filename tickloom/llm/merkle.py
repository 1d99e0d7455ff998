"""A Merkle manifest of a table: digests of rows, of groups and of the whole, with a proof for every row.

Levels are made by slot pivot: a parent's children are spread into one column for each of its `fanout` slots by
conditional aggregates. The concatenated columns hash to the parent; without a child's own column they are its siblings.

Nodes are (tree, pos, n, node): trees are numbered, pos counts a tree's nodes from 0, n is their number. A block is
fanout ** DEPTH consecutive nodes of a tree. Rows are dealt out by block once for DEPTH levels, which then need no
further shuffle; each such round leaves one row a block. So a table of 10 ** 11 rows takes five rounds, the second
of which has 1/256 of the rows, and no tree is gathered in one task however many rows it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import crc_mod, cut, fresh, if_small, table

#: Children of a node.
FANOUT = 2
#: Levels between two shuffles.
DEPTH = 8
#: The columns of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The type of the way to the root.
NO_STEPS = "array<struct<left:string,right:string>>"


def row_digest(fields: list[Column]) -> Column:
    """sha256, as lowercase hex, of `-` for each null and of UTF-8 byte count, `:` and value for the rest."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with `out`, the place from 0 of each row in ascending `order` (nulls first); rows of equal keys in any order.

    Rows are dealt into ranges and sorted there; a range begins where those before it end, so what is gathered is one
    count for each range. A number that is written with each row first also splits rows of equal keys among ranges.
    """
    salt, part, place, before = (fresh(df.columns, c) for c in ("_salt", "_part", "_place", "_before"))
    mono = F.monotonically_increasing_id()
    salted = cut(df.withColumn(salt, mono))
    ranged = salted.repartitionByRange(*order, salt).sortWithinPartitions(*order, salt).drop(salt)
    held = cut(ranged.withColumns({part: F.shiftright(mono, 33), place: mono.bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = held.groupBy(part).agg(F.count(F.lit(1)).alias("_count"))
    starts = cut(counts.select(part, (F.sum("_count").over(Window.orderBy(part)) - F.col("_count")).alias(before)))
    return held.join(if_small(starts), part).withColumn(out, F.col(before) + F.col(place)).drop(part, place, before)


def _level(k: int, fanout: int) -> tuple[Column, Column, Column]:
    """Of level k (0: the nodes given): the parent's place, the slot in it, and whether the tree has more than one node."""
    width = fanout**k
    place = F.expr(f"pos div {width}")
    return F.expr(f"pos div {width * fanout}"), place % fanout, F.expr(f"(n + {width - 1}) div {width}") > 1


def tops(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """One row for each block: (tree, pos, n, node) of the tree `depth` levels above. A tree of one node stays as it is."""
    width = fanout**depth
    rows = nodes.select("tree", F.expr(f"pos div {width}").alias("block"), "pos", "n", "node").repartition("tree", "block")
    for k in range(depth):
        parent, slot, more = _level(k, fanout)
        slots = [F.max(F.when(slot == j, F.col("node"))).alias(f"_slot{j}") for j in range(fanout)]
        spread = rows.groupBy("tree", "block", parent.alias("_parent")).agg(F.min("pos").alias("pos"), F.min("n").alias("n"), *slots)
        joined = F.concat(*[F.coalesce(f"_slot{j}", F.lit("")) for j in range(fanout)])
        rows = spread.select("tree", "block", "pos", "n", F.when(more, F.sha2(joined, 256)).otherwise(F.col("_slot0")).alias("node"))
    return rows.select("tree", F.col("block").alias("pos"), F.expr(f"(n + {width - 1}) div {width}").alias("n"), "node")


def climbed(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """nodes with their `block` and `steps`, one step for each level in the block at which the tree has several nodes: the
    siblings on the left and on the right, joined (empty: none). All nodes of a block must be there."""
    rows = nodes.withColumns({"block": F.expr(f"pos div {fanout**depth}"), "_up": F.col("node"), "steps": F.array().cast(NO_STEPS)})
    rows = rows.repartition("tree", "block")
    for k in range(depth):
        parent, slot, more = _level(k, fanout)
        family = Window.partitionBy("tree", "block", "_parent")
        rows = rows.withColumns({"_parent": parent, "_slot": slot})
        # On a child's row all children of its parent; cousins of one node carry the same hash.
        rows = rows.withColumns({f"_slot{j}": F.coalesce(F.max(F.when(F.col("_slot") == j, F.col("_up"))).over(family), F.lit("")) for j in range(fanout)})
        others = lambda keep: F.concat(*[F.when(keep(j), F.col(f"_slot{j}")).otherwise("") for j in range(fanout)])  # noqa: E731, B023
        step = F.struct(others(lambda j: F.col("_slot") > j).alias("left"), others(lambda j: F.col("_slot") < j).alias("right"))
        joined = F.concat(*[F.col(f"_slot{j}") for j in range(fanout)])
        rows = rows.withColumns({"_up": F.when(more, F.sha2(joined, 256)).otherwise(F.col("_up")), "steps": F.when(more, F.array_append("steps", step)).otherwise(F.col("steps"))})
        rows = rows.drop("_parent", "_slot", *[f"_slot{j}" for j in range(fanout)])
    return rows.drop("_up")


def rounds_up(nodes: DataFrame, fanout: int, depth: int) -> list[DataFrame]:
    """nodes, and one row a block for each round above, up to one row a tree."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(cut(tops(out[-1], fanout, depth)))
    return out


def down(rounds: list[DataFrame], ends: DataFrame, fanout: int, depth: int) -> DataFrame:
    """The nodes of the first round with `steps` up to the root of their tree and those that `ends` (tree, steps and other
    columns, one row a tree) adds."""
    added = [c for c in ends.columns if c != "tree"]
    above = ends.withColumn("block", F.lit(0).cast("long"))
    for k in reversed(range(len(rounds) - 1)):
        low = climbed(rounds[k], fanout, depth).join(above.withColumnRenamed("steps", "_more"), ["tree", "block"])
        low = low.withColumn("steps", F.concat("steps", "_more")).drop("_more", "block")
        above = low.select("tree", F.col("pos").alias("block"), *added) if k else low
    if len(rounds) == 1:
        return rounds[0].join(ends, "tree")
    return above


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and its steps lead to."""
    return F.aggregate(steps, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def manifest(rows: DataFrame, group: str, key: str, leaf: str, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """rows with subroot, root and `steps`, which lead from the leaf to the root.

    Leaves are ordered by `key` in each `group`, those of equal keys by their digest; groups are ordered by their name
    (nulls first, then bytewise). Rows of equal key and digest are exchangeable; null keys come first. No rows: no rows.
    A lone leaf is its group's root. Columns named tree, pos, n, node, block or steps must not be there.
    """
    ranked = numbered(rows, [group, key, leaf], "_g")
    groups = ranked.groupBy(group).agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias("n"))
    trees = cut(numbered(groups, [group], "tree"))
    named = if_small(trees.withColumnRenamed(group, "_group"))
    nodes = ranked.join(named, F.col(group).eqNullSafe(F.col("_group"))).withColumns({"pos": F.col("_g") - F.col("_first"), "node": F.col(leaf)}).drop("_group", "_first", "_g")
    lower = rounds_up(nodes, fanout, depth)
    subroots = cut(lower[-1].select("tree", F.col("node").alias("subroot")))
    n = subroots.count()
    upper = rounds_up(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n).alias("n"), F.col("subroot").alias("node"), "subroot"), fanout, depth)
    ends = upper[-1].select("tree", F.array().cast(NO_STEPS).alias("steps"), F.col("node").alias("root"))
    tops_of = cut(down(upper, ends, fanout, depth).select(F.col("pos").alias("tree"), "steps", "subroot", "root"))
    return down(lower, tops_of, fanout, depth).drop("tree", "pos", "n", "node")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents as a leaf, grouped by lang, and whether the proof holds for its possibly tampered form.

    Tampering adds 1 to n_chars where 7 divides the crc32 of doc_id; a null n_chars stays, so such a row still verifies.
    Nulls are hashed as `-`, empty texts as `0:`; a null doc_id is not tampered and comes first in its group. Texts are
    hashed where they are read, whatever their length, and go no further. Repeated rows are leaves of their own. Other
    columns of the table are not looked at. No rows: no rows.
    """
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    original = row_digest([F.col(c) for c in FIELDS])
    tampered = row_digest([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    leaves = docs.select("doc_id", "lang", original.alias("leaf"), F.when(crc_mod("doc_id", 7) == 0, tampered).alias("_changed"))
    proved = manifest(leaves, "lang", "doc_id", "leaf")
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    found = folded(F.coalesce("_changed", "leaf"), F.col("steps"))
    out = proved.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), found.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Bytes are counted in UTF-8; crc32 is worked out bit by bit; levels and folds are recursive.
ORACLE = """
WITH RECURSIVE docs AS (
 SELECT row_number() OVER () AS row_no, *, list_reduce([4294967295::BIGINT] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT),
  lambda c, x: list_reduce([xor(c, x)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS crc FROM documents),
fields AS (SELECT row_no, doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
 n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail, xor(crc, 4294967295) % 7 = 0 AS tampered FROM docs),
leaves AS (SELECT row_no, doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
 CASE WHEN tampered THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-') || tail) END AS changed FROM fields),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM leaves),
low AS (SELECT tree, 0 AS level, pos, n, leaf AS node FROM placed
 UNION ALL SELECT tree, level + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY tree, level, pos // 2),
subroots AS (SELECT tree, node AS subroot FROM low WHERE n = 1),
high AS (SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM subroots) AS n, subroot AS node FROM subroots
 UNION ALL SELECT level + 1, pos // 2, (max(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 2),
walk AS (SELECT row_no, doc_id, leaf, tree, 0 AS level, false AS upper, pos AS at, n AS left_n, '' AS proof, coalesce(changed, leaf) AS fold FROM placed
 UNION ALL SELECT w.row_no, w.doc_id, w.leaf, w.tree, CASE WHEN w.left_n = 1 THEN 0 ELSE w.level + 1 END, w.upper OR w.left_n = 1,
  CASE WHEN w.left_n = 1 THEN w.tree ELSE w.at // 2 END, CASE WHEN w.left_n = 1 THEN (SELECT count(*) FROM subroots) ELSE (w.left_n + 1) // 2 END,
  CASE WHEN w.left_n = 1 THEN w.proof ELSE w.proof || coalesce(l.node, h.node, '') END,
  CASE WHEN w.left_n = 1 THEN w.fold WHEN w.at % 2 = 0 THEN sha256(w.fold || coalesce(l.node, h.node, '')) ELSE sha256(coalesce(l.node, h.node, '') || w.fold) END
 FROM walk w LEFT JOIN low l ON NOT w.upper AND l.tree = w.tree AND l.level = w.level AND l.pos = xor(w.at, 1)
  LEFT JOIN high h ON w.upper AND h.level = w.level AND h.pos = xor(w.at, 1) WHERE NOT (w.upper AND w.left_n = 1))
SELECT w.doc_id, w.leaf, s.subroot, (SELECT node FROM high WHERE n = 1) AS root, sha256(w.proof) AS proof_sha256, w.fold AS folded_root, w.fold = (SELECT node FROM high WHERE n = 1) AS verified
FROM walk w JOIN subroots s USING (tree) WHERE w.upper AND w.left_n = 1
"""
