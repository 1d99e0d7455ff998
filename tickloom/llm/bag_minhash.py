"""Near-duplicate documents by BagMinHash.

A document is the multiset of its five-word windows. Each window carries, for every weight interval (0, 1], (1, 2],
(2, 4], (4, 8] ... below its weight, a Poisson process whose rate is the interval's length; the process depends on the
window alone. An interval that the weight covers in part is split down to unit cells: a point counts if its cell is
under the weight. Every point has a random coordinate, and each coordinate of the signature is the earliest point that
falls on it, so two signatures agree on a coordinate with the probability of the multisets' weighted Jaccard
similarity. Processes stop as soon as their next point comes later than every coordinate of the signature, which makes
about one or two points per window enough.

Signatures are cut into bands; documents that share a band are compared by the exact overlap of their multisets, and
links of SIMILARITY or more join documents to classes (see components.links).

Words are runs of letters, digits and
all signs beyond ASCII (dashes and curly quotes too, see `hashing`) of the lower-cased text. Defined results: null and empty texts, and texts without
words, form one class; a text of fewer than five words has one window, its word sequence, so it is near only its
copies. Texts with the same words are copies. Repeated rows are copies of each other. Rows with a null id belong to
classes like others; a class of such rows only has a null class_id. Very long texts are compared whole. An empty table
gives no rows. Other columns may have any name; the filtering stage returns them as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import cut, fresh, if_small, of_pairs, small_batches, table
from tickloom.llm.components import BITS, CELLS, cells, crowded_bands, links, prefixes, summaries, summary
from tickloom.llm.hashing import mix, windows, word_hashes

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
M = BANDS * ROWS
#: Windows that a worker handles at a time.
SLAB = 200_000


def bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, window hash, weight) of the distinct windows of each text, and a hash of each text's word sequence."""
    words, word_offsets = word_hashes(texts)
    shingles, offsets = windows(words, word_offsets, WORDS)
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    order = np.lexsort((shingles, text))
    text, shingles = text[order], shingles[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (shingles[1:] != shingles[:-1])
    at = np.flatnonzero(first)
    return text[at], shingles[at], np.diff(np.append(at, len(text))), _sequences(words, word_offsets)


def _sequences(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of the word sequence of each text, as a signed 64-bit number; equal for texts with equal words."""
    place = np.arange(len(words)) - np.repeat(offsets[:-1], np.diff(offsets))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words + mix(place.astype(np.uint64) + np.uint64(7))), dtype=np.uint64)])
    return mix((sums[offsets[1:]] - sums[offsets[:-1]]) + np.diff(offsets).astype(np.uint64)).view(np.int64)


def signatures(text: np.ndarray, window: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """BagMinHash signatures [n, M] of the weighted windows of n texts; infinite where a text has no window."""
    deepest = int(np.ceil(np.log2(weight.max()))) if len(weight) else 0
    owner, key, low, high, top = [], [], [], [], []
    for level in range(deepest + 1):
        start, end = (0, 1) if level == 0 else (2 ** (level - 1), 2**level)
        held = np.flatnonzero(weight > start)
        owner.append(text[held])
        key.append(mix(window[held] + np.uint64(0x9E37 * (level + 1))))
        low.append(np.full(len(held), start, np.float64))
        high.append(np.full(len(held), end, np.float64))
        top.append(weight[held].astype(np.float64))
    owner, key, low, high, top = map(np.concatenate, (owner, key, low, high, top))
    sig = np.full(n * M, np.inf)
    when = np.zeros(len(owner))
    while len(owner):
        key = mix(key + np.uint64(0x9E3779B97F4A7C15))
        when = when - np.log(((key >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / (high - low)
        other = mix(key ^ np.uint64(0xD1B54A32D192ED03))
        coordinate = (other >> np.uint64(40)).astype(np.int64) % M
        counted = high <= top
        if not counted.all():  # the cell of a point in an interval that is covered in part
            cell = low + 1 + np.floor((high - low) * ((other & np.uint64(0xFFFFFF)).astype(np.float64) / 2.0**24))
            counted |= cell <= top
        np.minimum.at(sig, (owner * M + coordinate)[counted], when[counted])
        late = sig.reshape(n, M).max(1)
        going = np.flatnonzero(when < late[owner])
        owner, key, low, high, top, when = (x[going] for x in (owner, key, low, high, top, when))
    return sig.reshape(n, M)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """[n, BANDS] keys, equal where all coordinates of a band are equal."""
    bits = sig.view(np.uint64).reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        out = mix(out * np.uint64(3) + bits[:, :, r])
    return out.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, node, tkey, bands): a hash of the words, a hash of the text, and the band keys (none without words)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            sizes = np.cumsum([len(t) // 6 for t in texts])
            pieces = np.searchsorted(sizes, np.arange(SLAB, sizes[-1], SLAB)) if len(texts) else []
            cuts = sorted({0, len(texts), *map(int, pieces)})
            for low, high in zip(cuts, cuts[1:]):
                text, window, weight, node = bags(texts[low:high])
                keys = band_keys(signatures(text, window, weight, high - low))
                some = np.bincount(text, minlength=high - low) > 0
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[low:high], "node": node, "tkey": batch["tkey"].iloc[low:high], "bands": [k if s else [] for k, s in zip(keys, some)]})

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tkey", F.xxhash64("text"))
    return source.mapInPandas(run, "doc_id long, node long, tkey long, bands array<long>")


def overlaps(left: list[str], right: list[str]) -> np.ndarray:
    """Exact weighted Jaccard similarity of each pair of texts."""
    distinct = {t: i for i, t in enumerate(dict.fromkeys([*left, *right]))}
    text, window, weight, _ = bags(list(distinct))
    offsets = np.searchsorted(text, np.arange(len(distinct) + 1))
    total = np.add.reduceat(np.append(weight, 0), offsets[:-1]) * (np.diff(offsets) > 0) if len(weight) else np.zeros(len(distinct))
    out = np.zeros(len(left))
    for i, (a, b) in enumerate(zip(left, right)):
        a, b = distinct[a], distinct[b]
        sa, sb = slice(offsets[a], offsets[a + 1]), slice(offsets[b], offsets[b + 1])
        if not (total[a] and total[b]):
            out[i] = float(a == b)
            continue
        at = np.minimum(np.searchsorted(window[sa], window[sb]), sa.stop - sa.start - 1)
        both = window[sa][at] == window[sb]
        common = np.minimum(weight[sa][at], weight[sb])[both].sum()
        out[i] = common / (total[a] + total[b] - common)
    return out


def verifier(texts: DataFrame, similarity: float):
    """texts: (node, text). Pairs (a, b) to those whose texts overlap by `similarity` or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 64):
                part = batch.iloc[low : low + 64]
                yield part[["a", "b"]][overlaps(list(part["text_a"]), list(part["text_b"])) >= similarity]

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        held = of_pairs(texts, pairs)
        of = lambda side: held.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}"))
        return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long")

    return verify


#: Rows in which a task sends its counters: slices of the table of CELLS.
SLICES = 16


def ranked(texts: DataFrame, similarity: float, sets=bags) -> DataFrame:
    """(node, central, element, before) of each (node, text): the prefixes of their multisets, as `prefixes` makes them, a
    row for each node. Only counters of fixed size and the prefixes leave a task."""
    width = CELLS // SLICES

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(CELLS, np.int64)
        for batch in batches:
            seen += np.bincount(cells(sets(list(batch["text"]))[1]), minlength=CELLS)
        parts = [(k, part) for k, part in enumerate(seen.reshape(SLICES, width)) if part.any()]
        yield pd.DataFrame({"slice": [k for k, _ in parts], "counts": [zlib.compress(part.tobytes(), 1) for _, part in parts]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.int64)
        for counts in part["counts"]:
            total += np.frombuffer(zlib.decompress(counts), np.int64)
        return pd.DataFrame({"slice": part["slice"].iloc[:1], "counts": [total.tobytes()]})

    counters = np.zeros(CELLS, np.int64)
    layout = "slice int, counts binary"
    for r in texts.mapInPandas(count, layout).groupBy("slice").applyInPandas(add, layout).collect():  # SLICES rows at most
        counters[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
    shared = texts.sparkSession.sparkContext.broadcast(counters)

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text, window, weight, _ = sets(list(batch["text"]))
            out = prefixes(text, window.view(np.int64), weight, len(batch), shared.value, similarity)
            rare, central = out["df"] > 1, np.zeros(len(batch))
            central[out["owner"]] = out["central"]
            bounds = np.searchsorted(out["owner"][rare], np.arange(1, len(batch)))
            yield pd.DataFrame({"node": batch["node"].to_numpy(), "central": central, "element": np.split(out["element"][rare], bounds), "before": np.split(out["before"][rare], bounds)})

    return texts.mapInPandas(rank, "node long, central double, element array<long>, before array<long>")


def summed(texts: DataFrame, sets=bags, words: int = BITS) -> DataFrame:
    """node and the `summary` of so many words of each (node, text); `sets` makes their multisets, as `bags` does."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text, window, weight, _ = sets(list(batch["text"]))
            yield pd.DataFrame({"node": batch["node"].to_numpy()} | summaries(text, window, weight, len(batch), words))

    return texts.mapInPandas(run, "node long, " + ", ".join(f"{c} long" for c in summary(words)))


def labelled(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of `docs`, checkpointed: doc_id, tkey (a hash of the text), class_id and class_tkey (those of the
    row of the class with the least doc_id), class_size."""
    rows = cut(signed(docs))
    spot = F.struct("doc_id", "tkey")
    nodes = rows.groupBy("node").agg(F.min(F.when(F.col("doc_id").isNotNull(), spot)).alias("spot"), F.min("tkey").alias("tkey"), F.count(F.lit(1)).alias("n"))
    nodes = cut(nodes.select("node", "tkey", "n", "spot.doc_id", F.col("spot.tkey").alias("spot_tkey")))
    # Copies are one before their bands are shuffled.
    distinct = rows.select("node", "bands").dropDuplicates(["node"])
    members = cut(crowded_bands(distinct.select(F.col("node").alias("id"), "bands")))
    wanted = nodes.select("node", "tkey").join(members.select(F.col("id").alias("node")).distinct(), "node")
    # One row gives a node's text: one with the node's least text hash, and of these that of the least id.
    holder = cut(rows.join(wanted, ["node", "tkey"]).groupBy("node", "tkey").agg(F.min("doc_id").alias("holder")))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tkey", F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = source.join(if_small(holder), (source["tkey"] == holder["tkey"]) & source["doc_id"].eqNullSafe(holder["holder"]))
    texts = cut(texts.select("node", "text").dropDuplicates(["node"]))
    found = links(members, cut(summed(texts)), verifier(texts, similarity), lambda nodes: ranked(texts.join(nodes, "node"), similarity), similarity)
    # A class of one row needs no name but its own: only nodes of several rows or with links are looked up by the rows.
    of_node = nodes.join(found, "node", "left").where("n > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "node"))
    spot = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "spot_tkey"))
    named = of_node.groupBy("component").agg(F.min(spot).alias("spot"), F.sum("n").alias("class_size"))
    of_node = of_node.select("node", "component").join(named, "component")
    of_node = cut(of_node.select("node", F.lit(True).alias("several"), F.col("spot.doc_id").alias("class_id"), F.col("spot.spot_tkey").alias("class_tkey"), "class_size"))
    out = rows.select("doc_id", "tkey", "node").join(if_small(of_node), "node", "left")
    own = lambda c, x: F.when(F.col("several"), F.col(c)).otherwise(x).alias(c)
    return cut(out.select("doc_id", "tkey", own("class_id", F.col("doc_id")), own("class_tkey", F.col("tkey")), own("class_size", F.lit(1))))


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of `docs` (doc_id, text; others ignored): doc_id, class_id (the least doc_id), class_size."""
    return labelled(docs, similarity).select("doc_id", "class_id", "class_size")


def op6_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 250)
    return classes(table(spark, sf_dir, "documents"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class, that of the least id (of rows that share it, that of the least text hash); of
    repeated rows one. Rows with null ids stay."""
    small_batches(spark, 250)
    found = labelled(docs).where("doc_id IS NOT NULL")
    gone = found.where("doc_id != class_id OR tkey != class_tkey").select("doc_id", "tkey", F.lit(True).alias("other")).distinct()
    again = found.where("doc_id = class_id AND tkey = class_tkey").groupBy("doc_id", "tkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "tkey", F.lit(False).alias("other"))
    marks = cut(gone.unionByName(again))
    mark_id, mark_text, other = (fresh(docs.columns, c) for c in ("mark_id", "mark_text", "other"))
    marks = if_small(marks.toDF(mark_id, mark_text, other))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(mark_id)) & F.xxhash64(F.coalesce("text", F.lit(""))).eqNullSafe(F.col(mark_text))
    marked = docs.join(marks, same, "left")
    once = marked.where(~F.col(other)).dropDuplicates(["doc_id", mark_text])
    return marked.where(F.col(other).isNull()).select(*docs.columns).unionByName(once.select(*docs.columns))
