"""Document fingerprints by order MinHash.

The k-mers of a document are its windows of K words, each numbered by its occurrence among equal windows, so repeats
count. For each of N_HASHES hash functions the L k-mers of smallest hash value are selected, put back in the order in
which they stand in the text, and the tuple is hashed to one coordinate of the fingerprint. Two documents agree on a
coordinate if they select the same k-mers in the same order, so the share of equal coordinates falls with the edit
distance, also where only the order of passages changes.

Defined results: null texts count as empty; texts without words share the all-zero fingerprint; a text of fewer than
K words has one k-mer, its word sequence; one of fewer than L k-mers uses those it has. Equal texts have equal
fingerprints. Words are runs of letters, digits and
all signs beyond ASCII (dashes and curly quotes too, see `hashing`) of the lower-cased text. Repeated rows are ordered among
themselves by text. With one document only, that document is its own next one. Rows with null ids come last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import small_batches, table
from tickloom.llm.hashing import mix, windows, word_hashes

K = 3
L = 2
N_HASHES = 64
#: k-mers hashed at a time by one function; bounds the temporaries.
SLAB = 30_000
MULTIPLIERS = mix(np.arange(1, N_HASHES + 1, dtype=np.uint64)) | np.uint64(1)
EXPECTED = 16


def numbered(kmers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each k-mer's hash with its occurrence number among equal k-mers of the same text mixed in."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keyed = mix(kmers ^ mix(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keyed, kind="stable")
    ranked = keyed[order]
    first = np.ones(len(ranked), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    at = np.arange(len(ranked))
    occurrence = np.empty(len(ranked), np.uint64)
    occurrence[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return mix(kmers + occurrence * np.uint64(0xC2B2AE3D27D4EB4F))


def sketch(texts: list[str | None]) -> np.ndarray:
    """Fingerprints [text, N_HASHES] as 16-bit coordinates."""
    words, word_offsets = word_hashes(texts)
    kmers, offsets = windows(words, word_offsets, K)
    out = np.zeros((len(texts), N_HASHES), np.uint16)
    base = numbered(kmers, offsets)
    counts = np.diff(offsets)
    full = np.flatnonzero(counts > 0)
    begin = 0
    while begin < len(full):  # consecutive texts with about SLAB k-mers together
        end = begin + max(1, int(np.searchsorted(np.cumsum(counts[full[begin:]]), SLAB, "right")))
        part = full[begin:end]
        low, high = offsets[part[0]], offsets[part[-1] + 1]
        values, starts = base[low:high], offsets[part] - low
        sizes = counts[part]
        owner = np.repeat(np.arange(len(part)), sizes)
        # About EXPECTED k-mers of each text fall under its limit; sorting these few gives the L least.
        limit = np.full(len(part), 2**64 - 1, np.uint64)
        limit[sizes > EXPECTED] = (EXPECTED / sizes[sizes > EXPECTED] * 2.0**64).astype(np.uint64)
        limit = np.repeat(limit, sizes)
        for f in range(N_HASHES):
            h = values * MULTIPLIERS[f]  # values are well mixed and odd factors permute them
            under = np.flatnonzero(h <= limit)
            text = owner[under]
            under = under[np.lexsort((h[under], text))]
            first = np.searchsorted(text, np.arange(len(part) + 1))
            have = np.diff(first)
            picked = [np.where(have > i, under[np.minimum(first[:-1] + i, len(under) - 1)] if len(under) else -1, -1) for i in range(L)]
            for t in np.flatnonzero(have < np.minimum(sizes, L)):  # too few under the limit: sort them all
                least = np.argsort(h[starts[t] : starts[t] + sizes[t]], kind="stable")[:L] + starts[t]
                for i, at in enumerate(least):
                    picked[i][t] = at
            chosen = np.sort(np.stack(picked), axis=0)
            code = np.zeros(len(part), np.uint64)
            for at in chosen:
                code = mix(code * np.uint64(3) + np.where(at >= 0, values[np.maximum(at, 0)], np.uint64(0)))
            out[part, f] = (code >> np.uint64(48)).astype(np.uint16)
        begin = end
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def to_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """All columns of `docs` with the fingerprint of column `text` as a hexadecimal string."""
    docs = docs.drop(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: [to_text(x) for x in sketch(_texts(batch[text]))]})

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())])
    return docs.mapInPandas(run, schema)


def _texts(column: pd.Series) -> list[str]:
    return [t if isinstance(t, str) else "" for t in column]


def in_order(docs: DataFrame, partitions: int) -> tuple[DataFrame, DataFrame]:
    """Rows of `docs` with `part`, so that parts hold descending, disjoint ranges of doc_id; and the parts' first rows.

    The bounds are quantiles of doc_id: as many numbers as there are partitions. The column `halo` marks a copy of the
    first row of a part, added to the part before it (the last part's is the first of all rows).
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    probabilities = [i / partitions for i in range(1, partitions)] or [0.5]
    bounds = keyed.select(F.percentile_approx("doc_id", F.array(*map(F.lit, probabilities)), F.lit(10_000)).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    part = F.lit(len(bounds))
    if bounds:  # the number of bounds below the id, by binary search over nested conditions
        part = F.lit(len(bounds)) - _bisect(bounds, 0, len(bounds))
    part = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(part)
    keyed = keyed.withColumn("part", part.cast("int"))
    firsts = keyed.groupBy("part").agg(F.max("doc_id").alias("first_id")).orderBy("part").collect()
    return keyed, firsts


def _bisect(bounds: list[int], low: int, high: int):
    """How many of bounds[low:high] are at most doc_id, plus low."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(F.col("doc_id") >= F.lit(bounds[middle]), _bisect(bounds, middle + 1, high)).otherwise(_bisect(bounds, low, middle))


def edited_fingerprints(docs: DataFrame, partitions: int) -> DataFrame:
    """For every document: its fingerprint, that of its edited text, and their likeness; and its likeness to the next.

    Documents are dealt to ranges of descending doc_id, so the one shuffle moves each text once; a range also gets the
    first document of the range after it.
    """
    keyed, firsts = in_order(docs, partitions)
    if not firsts:
        keyed = keyed.withColumn("halo", F.lit(False))
    else:
        # The next part's first row is copied to this part. As many rows as parts.
        into = [(firsts[(i + 1) % len(firsts)]["part"], firsts[i]["part"], firsts[(i + 1) % len(firsts)]["first_id"]) for i in range(len(firsts))]
        moves = keyed.sparkSession.createDataFrame(into, "from_part int, to_part int, from_id long")
        copies = keyed.join(F.broadcast(moves), (F.col("part") == F.col("from_part")) & F.col("doc_id").eqNullSafe(F.col("from_id"))).groupBy("to_part", "doc_id").agg(F.min("text").alias("text"))
        keyed = keyed.withColumn("halo", F.lit(False)).unionByName(copies.select("doc_id", "text", F.col("to_part").alias("part"), F.lit(True).alias("halo")))
    # By number, not by a hash of it, so that each task gets one range.
    ordered = keyed.repartitionById(max(partitions, 1), "part").sortWithinPartitions("part", "halo", F.desc_nulls_last("doc_id"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None  # the row before, which waits for its next text
        for batch in batches:
            texts = list(batch["text"])
            prints = sketch(texts)
            rows = list(zip(batch["doc_id"], batch["part"], batch["halo"], texts, prints))
            if held is not None:
                rows.insert(0, held)
            done = [(a, b) for a, b in zip(rows, rows[1:]) if a[1] == b[1] and not a[2]]
            held = rows[-1]
            edited = [edit(a[3], b[3]) for a, b in done]
            changed = sketch(edited)
            own = np.array([a[4] for a, _ in done]).reshape(-1, N_HASHES)
            following = np.array([b[4] for _, b in done]).reshape(-1, N_HASHES)
            yield pd.DataFrame(
                {
                    "doc_id": pd.array([None if pd.isna(a[0]) else int(a[0]) for a, _ in done], dtype="Int64"),
                    "n_chars": [len(a[3]) for a, _ in done],
                    "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                    "fingerprint": [to_text(x) for x in own],
                    "edited_fingerprint": [to_text(x) for x in changed],
                    "near_edited": likeness(own, changed),
                    "near_next": likeness(own, following),
                }
            )

    return ordered.mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def edit(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by as many of the first of the next text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 250)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return edited_fingerprints(table(spark, sf_dir, "documents"), partitions)
