"""Fuzzy line deduplication by MinHash.

A line is lower-cased and every run of characters that are no letters or digits becomes one space. Its set of
SHINGLE-character shingles gets a one-permutation MinHash signature: shingles are dealt to bins by their hash, a bin
keeps its least value, an empty bin takes the value of the next full one. Bands of the signature give candidates,
exact Jaccard similarity of the shingle sets verifies them, and links of SIMILARITY or more join lines to components
by a distributed union-find. The first line of a component, by document id and line number, stays.

Defined results: blank lines, and lines without letters or digits, are kept and never compared. A line shorter than a
shingle is one shingle. Null texts have no lines. Rows with a null id are kept whole and not compared. Rows that share
an id but not the text are documents of their own, ordered by a hash of their texts; rows that share both are one
document. Texts are split at line feeds only, and are read whole whatever their length. An empty table gives no rows.
Other columns may have any name; the filtering stage returns them as they are.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.bag_minhash import ranked, summed
from tickloom.llm.common import cut, fresh, if_small, of_pairs, small_batches, stored, swept, table
from tickloom.llm.components import crowded_bands, links
from tickloom.llm.hashing import _powers, mix

SHINGLE = 7
SIMILARITY = 0.8
BANDS, ROWS = 16, 5
M = BANDS * ROWS
EMPTY = np.uint32(0xFFFFFFFF)
#: Characters that a worker handles at a time, and lines whose bands it remembers to have sent. A character takes some 300
#: bytes while its shingles are hashed.
SLAB = 100_000
SENT = 1_000_000
#: Words of a line's summary: lines are short, so more of them say little.
WORDS = 4


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


@functools.lru_cache(1)
def _mixed_points() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64))


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the normalised lines of all texts; each line's start and end there; each text's first line."""
    points = np.frombuffer("\n".join(texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.append(points, np.uint32(10))
    line_feed = points == 10
    letter = _letters()[points]
    keep = letter | line_feed
    after_letter = np.zeros(len(points), bool)  # one space stands for a run between two letters of a line
    after_letter[1:] = letter[:-1] & ~keep[1:]
    points = np.where(letter | line_feed, points, np.uint32(32))[keep | after_letter]
    trailing = np.zeros(len(points), bool)
    trailing[:-1] = (points[:-1] == 32) & (points[1:] == 10)
    points = points[~trailing]
    ends = np.flatnonzero(points == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    counts = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
    return points, starts, ends, np.concatenate([[0], np.cumsum(counts)])


def line_windows(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lines; and for every shingle the number of its line and its hash."""
    up, down = _powers(len(points) + 1)
    prefix = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_mixed_points()[points] * up[: len(points)], out=prefix[1:])
    sizes = ends - starts
    node = mix(mix((prefix[ends] - prefix[starts]) * down[starts]) + sizes.astype(np.uint64))
    windows = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
    line = np.repeat(np.arange(len(starts)), windows)
    offsets = np.concatenate([[0], np.cumsum(windows)])
    at = np.repeat(starts - offsets[:-1], windows)
    at += np.arange(len(line))
    # Of most shingles the end is SHINGLE further on; lines shorter than that have one each.
    h = np.zeros(len(points) + 1, np.uint64)
    if len(points) >= SHINGLE:
        h[: len(prefix) - SHINGLE] = prefix[SHINGLE:] - prefix[:-SHINGLE]
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    h[starts[short]] = prefix[ends[short]] - prefix[starts[short]]
    h *= down
    return node, line, mix(h[at])


def line_signatures(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lines, and their signatures [line, M]; all EMPTY for a blank line."""
    node, line, h = line_windows(points, starts, ends)
    bins = ((h >> np.uint64(32)) * np.uint64(M) >> np.uint64(32)).astype(np.int64)
    sig = np.full(len(starts) * M, EMPTY)
    np.minimum.at(sig, line * M + bins, (h & np.uint64(0xFFFFFFFE)).astype(np.uint32))
    sig = sig.reshape(-1, M)
    some = np.flatnonzero((ends > starts) & (sig == EMPTY).any(1))
    if len(some):
        rows = sig[some]
        twice = np.concatenate([rows, rows], 1) != EMPTY
        place = np.where(twice, np.arange(2 * M), 4 * M)
        following = np.minimum.accumulate(place[:, ::-1], 1)[:, ::-1][:, :M]
        taken = np.take_along_axis(rows, following % M, 1)
        distance = (following - np.arange(M)).astype(np.uint32)
        sig[some] = taken + distance * np.uint32(0x9E3779B1)
    return node.view(np.int64), sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    out = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sig), BANDS)).copy()
    values = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    for r in range(ROWS):
        out = mix(out * np.uint64(3) + values[:, :, r])
    return out.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, line, node, bands) for every line with a letter or digit; tkey is a hash of the text, bands come
    once for each node and task at least."""
    schema = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("line", pa.int32()), ("node", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            texts = batch.column(1).to_pylist()
            sizes = np.cumsum([len(t) for t in texts])
            cuts = sorted({0, len(texts), *map(int, np.searchsorted(sizes, np.arange(SLAB, sizes[-1], SLAB)))}) if len(texts) else []
            for low, high in zip(cuts, cuts[1:]):
                points, starts, ends, first = normalised(texts[low:high])
                node, sig = line_signatures(points, starts, ends)
                some = np.flatnonzero(ends > starts)
                owner = np.searchsorted(first, some, "right") - 1
                fresh = np.zeros(len(some), bool)
                if len(sent) > SENT:
                    sent.clear()
                for i, v in enumerate(node[some].tolist()):
                    if v not in sent:
                        sent.add(v)
                        fresh[i] = True
                offsets = np.concatenate([[0], np.cumsum(fresh * BANDS)]).astype(np.int32)
                bands = pa.ListArray.from_arrays(offsets, band_keys(sig[some[fresh]]).ravel())
                yield pa.RecordBatch.from_arrays([pa.array(ids[low:high][owner]), pa.array(keys[low:high][owner]), pa.array((some - first[owner]).astype(np.int32)), pa.array(node[some]), bands], schema=schema)

    source = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tkey"))
    return source.mapInArrow(run, "doc_id long, tkey long, line int, node long, bands array<long>")


def sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, None]:
    """(line, shingle hash of 48 bits, 1) of the distinct shingles of each raw line, in order; at most 65,536 lines."""
    points, starts, ends, _ = normalised(lines)
    _, line, h = line_windows(points, starts, ends)
    both = np.sort((line.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return (both >> np.uint64(48)).astype(np.int64), both & np.uint64((1 << 48) - 1), np.ones(len(both), np.int64), None


def jaccard(left: list[str], right: list[str]) -> np.ndarray:
    """Jaccard similarity of the shingle sets of each pair of raw lines."""
    distinct = {t: i for i, t in enumerate(dict.fromkeys([*left, *right]))}
    line, h, _, _ = sets(list(distinct))
    key = (line.astype(np.uint64) << np.uint64(48)) | h
    bounds = np.searchsorted(line, np.arange(len(distinct) + 1))
    a, b = (np.fromiter((distinct[t] for t in side), np.int64, len(side)) for side in (left, right))
    sizes = np.diff(bounds)
    both = sizes[a] + sizes[b]
    a, b = np.where(sizes[a] <= sizes[b], a, b), np.where(sizes[a] <= sizes[b], b, a)  # the smaller set is looked up
    pair = np.repeat(np.arange(len(a)), sizes[a])
    at = bounds[a][pair] + np.arange(len(pair)) - np.concatenate([[0], np.cumsum(sizes[a])])[pair]
    wanted = (b[pair].astype(np.uint64) << np.uint64(48)) | h[at]
    common = np.bincount(pair[key[np.minimum(np.searchsorted(key, wanted), len(key) - 1)] == wanted], minlength=len(a))
    return np.where(both > 0, common / np.maximum(both - common, 1), 1.0)


def verifier(texts: DataFrame, similarity: float):
    """texts: (node, text) with the raw line. Pairs (a, b) to those of Jaccard similarity `similarity` or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[jaccard(list(batch["text_a"]), list(batch["text_b"])) >= similarity, ["a", "b"]]

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        held = of_pairs(texts, pairs)
        of = lambda side: held.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}"))
        return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long")

    return verify


def labelled_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, tkey, line, component, first) for the lines of components of several lines; first tells whether the line
    is the first of its component."""
    rows = stored(signed(docs))
    members = swept(cut(crowded_bands(rows.select(F.col("node").alias("id"), "bands"))))
    at = F.min(F.struct("doc_id", "tkey", "line")).alias("at")
    places = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), at)
    wanted = members.select(F.col("id").alias("node"), F.lit(True).alias("wanted")).distinct()
    places = cut(places.join(if_small(cut(wanted)), "node", "left").where("n > 1 OR wanted"))
    at_doc, at_text, at_line = (F.col("at.doc_id").alias("at_doc"), F.col("at.tkey").alias("at_text"), F.col("at.line").alias("at_line"))
    holders = places.where("wanted").select(at_doc, at_text, F.struct("node", F.col("at.line").alias("line")).alias("held"))
    # A document is read once for all its lines that are wanted.
    holders = cut(holders.groupBy("at_doc", "at_text").agg(F.collect_list("held").alias("held")))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    texts = source.join(if_small(holders), (F.col("doc_id") == F.col("at_doc")) & (F.xxhash64("text") == F.col("at_text")))
    texts = texts.select(F.split("text", "\n").alias("lines"), "held")
    texts = texts.select(F.explode(F.transform("held", lambda x: F.struct(x["node"].alias("node"), F.get("lines", x["line"]).alias("text")))).alias("held")).select("held.*")
    texts = swept(cut(texts.groupBy("node").agg(F.min("text").alias("text"))))
    found = links(members, cut(summed(texts, sets, WORDS)), verifier(texts, similarity), lambda nodes: ranked(texts.join(nodes, "node"), similarity, sets), similarity)
    of_node = places.join(if_small(cut(found)), "node", "left").where("n > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "node"))
    kept = of_node.groupBy("component").agg(F.min("at").alias("at"))
    several = cut(of_node.select("node", "component").join(kept.select("component", at_doc, at_text, at_line), "component"))
    out = rows.select("doc_id", "tkey", "line", "node").join(if_small(several), "node")
    first = (F.col("doc_id") == F.col("at_doc")) & (F.col("tkey") == F.col("at_text")) & (F.col("line") == F.col("at_line"))
    return out.select("doc_id", "tkey", "line", "component", first.alias("first"))


def removed_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, tkey, removed): the numbers, from 0, of the lines that go from a document; documents that lose some."""
    found = labelled_lines(docs, similarity).where("NOT first")
    return found.groupBy("doc_id", "tkey").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def with_removed(docs: DataFrame, removed: DataFrame, name: str) -> DataFrame:
    """`docs` with the numbers of the lines to go in a column `name`; null where none goes."""
    mark_id, mark_text = fresh([*docs.columns, name], "mark_id"), fresh([*docs.columns, name], "mark_text")
    marks = removed.select(F.col("doc_id").alias(mark_id), F.col("tkey").alias(mark_text), F.col("removed").alias(name))
    return docs.join(marks, (F.col("doc_id").cast("long") == F.col(mark_id)) & (F.xxhash64("text") == F.col(mark_text)), "left").drop(mark_id, mark_text)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its number of lines, how many go, and the numbers of these lines."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    # The text is needed only to count lines and to tell rows apart, so both are taken before the join.
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1).cast("long")
    rows = docs.select("doc_id", n_lines.alias("n_lines"), F.xxhash64("text").alias("tkey"))
    marks = removed_lines(docs).select(F.col("doc_id").alias("mark_id"), F.col("tkey").alias("mark_text"), "removed")
    joined = rows.join(marks, (F.col("doc_id") == F.col("mark_id")) & (F.col("tkey") == F.col("mark_text")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one; documents of which no letter or digit is left go."""
    small_batches(spark)
    gone = fresh(docs.columns, "gone")
    joined = with_removed(docs, if_small(cut(removed_lines(docs))), gone)
    lines = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i))
    out = joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(lines, "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    left = F.coalesce(F.col("text").rlike(r"[\p{L}\p{N}]"), F.lit(False))
    return out.where(F.col(gone).isNull() | left).select(*docs.columns)
