"""Packing documents into sequences by cutting-stock column generation.

A document's ids, with its end id, are cut into pieces of SEQUENCE ids and a rest. Lengths are counted in a histogram
of classes of GRAIN ids, which has as many rows for any corpus. On the driver, a linear program over patterns (numbers
of pieces of each class that fit a sequence) covers the histogram with the least number of sequences: the simplex
method starts from one pattern for each class, and a knapsack dynamic programme over the dual prices finds the next
pattern to enter, until none improves. Whole parts of the solution give copies of patterns; what they leave is packed
by best fit decreasing. In Spark, the pieces of a class are ranked, and the rank selects the pattern, the copy and the
place in it.

Defined results: null and empty texts are the end id alone. Repeated rows are packed as rows of their own. Rows with a
null id are packed too. An empty table gives no pieces.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import cut, small_batches, table
from tickloom.llm.tokens import TextEncoder

SEQUENCE = 2048
GRAIN = 8
END = 1
#: Pieces ranked together, by class.
RANKED = 20_000


@dataclass
class Pattern:
    classes: list[int]  # with repetition, in the order in which pieces stand in the sequence
    copies: int


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits, by dynamic programming over capacities: value and counts."""
    best, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = sizes <= room
        if not fits.any():
            continue
        value = np.where(fits, best[np.maximum(room - sizes, 0)] + prices, -1.0)
        i = int(value.argmax())
        if value[i] > best[room - 1] + 1e-12:
            best[room], chosen[room] = value[i], i
        else:
            best[room], chosen[room] = best[room - 1], -1
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if chosen[room] < 0:
            room -= 1
        else:
            counts[chosen[room]] += 1
            room -= sizes[chosen[room]]
    return float(best[capacity]), counts


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 1500, tolerance: float = 0.003) -> list[tuple[np.ndarray, float]]:
    """Patterns with fractional copies that cover the demand with the fewest sequences (the revised simplex method).

    It ends when the best pattern is priced at no more than 1 + tolerance: the optimum is then nearer than that. If it
    has to end before, after `rounds` patterns, it warns with the price reached, which is how far off the plan can be.
    """
    def times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
        return (matrix * vector).sum(1)  # small, and so without the threads of a linear-algebra library

    n = len(sizes)
    basis = np.diag(np.maximum(capacity // sizes, 1)).astype(float)
    inverse = np.diag(1 / np.diag(basis))
    where = {int(c): i for i, c in enumerate(sizes)}
    for i, c in enumerate(sizes):  # start with each large class beside the class that fills the sequence
        j = where.get(capacity - int(c))
        if 2 * c > capacity and j is not None:
            few, many = (i, j) if demand[i] <= demand[j] else (j, i)
            basis[[few, many], few] = 1
            inverse[few, few] = 1
            inverse[many, few] = -inverse[many, many]
    x = times(inverse, demand)
    for _ in range(rounds):
        value, counts = knapsack(sizes, np.maximum(inverse.sum(0), 0), capacity)
        if value <= 1 + tolerance:
            break
        direction = times(inverse, counts)
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        step = ratio[leave]
        x = np.maximum(x - step * direction, 0)
        x[leave] = step
        basis[:, leave] = counts
        row = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, row)
        inverse[leave] = row
    else:
        warnings.warn(f"column generation ended after {rounds} patterns; the plan takes at most {value:.4f} times the optimum", stacklevel=2)
    return [(basis[:, j].astype(np.int64), float(x[j])) for j in range(n)]


def best_fit(classes: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: each size goes to the fullest sequence that still has room for it."""
    open_: dict[int, list[int]] = {}
    made: list[list[int]] = []
    for size in sorted(classes, reverse=True):
        room = next((r for r in range(size, capacity) if open_.get(r)), None)
        if room is None:
            made.append([size])
            at, room = len(made) - 1, capacity
        else:
            at = open_[room].pop()
            made[at].append(size)
        open_.setdefault(room - size, []).append(at)
    return made


def plan(histogram: dict[int, int], capacity: int = SEQUENCE // GRAIN) -> list[Pattern]:
    """Patterns that hold exactly the pieces of the histogram (class to number)."""
    sizes = np.array(sorted(c for c, n in histogram.items() if n), np.int64)
    if not len(sizes):
        return []
    left = np.array([histogram[c] for c in sizes], np.int64)
    made: list[Pattern] = []
    for counts, copies in sorted(column_generation(sizes, left.astype(float), capacity), key=lambda p: -p[1]):
        used = counts > 0
        whole = int(min(np.floor(copies + 1e-6), (left[used] // counts[used]).min()))
        if whole > 0:
            made.append(Pattern([int(c) for c in np.repeat(sizes, counts)[::-1]], whole))
            left -= whole * counts
    rest = best_fit([int(c) for c in np.repeat(sizes, left)], capacity)
    return made + [Pattern(classes, 1) for classes in rest]


def pieces(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of the pieces of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            ids, offsets = encoder.encode([t if isinstance(t, str) else None for t in batch["text"]], END)
            raw = memoryview(ids.astype("<u4").tobytes())
            rows = []
            for i, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                for start in range(low, high, SEQUENCE):
                    until = min(start + SEQUENCE, high)
                    rows.append((i, start - low, until - start, zlib.crc32(raw[4 * start : 4 * until]), high - low))
            out = pd.DataFrame(rows, columns=["i", "start", "length", "ids_crc32", "doc_tokens"])
            out.insert(0, "doc_id", batch["doc_id"].array.take(out.pop("i").to_numpy()))
            yield out

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


_ENCODERS: dict[str, TextEncoder] = {}


def _encoder(path: str, byte_level: bool = False) -> TextEncoder:
    """One encoder for each worker process, so that its memo lives on from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path, byte_level)
    return _ENCODERS[path]


def pack(cut_pieces: DataFrame) -> DataFrame:
    """`cut_pieces`, checkpointed and with columns doc_id, start and length of at most SEQUENCE, with sequence_id and offset."""
    spark = cut_pieces.sparkSession
    classed = cut_pieces.withColumn("class", F.ceil(F.col("length") / GRAIN).cast("int"))
    histogram = {r["class"]: r["n"] for r in classed.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns = plan(histogram)
    slots, sequence, taken = [], 0, {}
    for p in patterns:
        place = 0
        for c in dict.fromkeys(p.classes):
            each = p.classes.count(c)
            slots.append((c, taken.get(c, 0), each, p.copies, sequence, place))
            taken[c] = taken.get(c, 0) + each * p.copies
            place += each
        sequence += p.copies
    slots_df = spark.createDataFrame(slots, "s_class int, s_first long, s_each long, s_copies long, s_sequence long, s_place long")
    salts = max(1, -(-sum(histogram.values()) // RANKED))
    salted = classed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("class", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("class", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    rest = [c for c in cut_pieces.columns if c not in ("doc_id", "start", "length")]  # tells rows of one id apart
    here = Window.partitionBy("class", "salt").orderBy(F.desc("length"), "doc_id", "start", *rest)
    ranked = salted.withColumn("here", F.row_number().over(here) - 1).join(before, ["class", "salt"]).withColumn("rank", F.col("before") + F.col("here"))
    within = (F.col("class") == F.col("s_class")) & (F.col("rank") >= F.col("s_first")) & (F.col("rank") < F.col("s_first") + F.col("s_each") * F.col("s_copies"))
    # The slots are as many as the patterns' distinct classes: bounded by the number of classes, not by the corpus.
    placed = ranked.join(F.broadcast(slots_df), within)
    nth = F.col("rank") - F.col("s_first")
    placed = placed.withColumn("sequence_id", F.col("s_sequence") + F.expr("(rank - s_first) div s_each")).withColumn("place", F.col("s_place") + nth % F.col("s_each"))
    earlier = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).select(*cut_pieces.columns, "sequence_id", "offset")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packed(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    return pack(cut(pieces(docs, tokenizer_path or word_tokenizer())))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packed(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packed(docs)
