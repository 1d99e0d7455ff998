"""Product quantisation of vectors, with k-means that leaves out the scans which norm-of-sum bounds make needless.

Components become integers floor(4096 * x); all distances, sums and means are exact integers, so the result depends on
neither the order of rows nor rounding. Vectors are cut into PARTS parts, each with a codebook of ENTRIES entries.

A part keeps its entry, an upper bound of the distance to it and a lower bound of the distances to all others, each with
the round in which it was measured. Codebooks of all rounds are kept. A bound is carried to the current round by the
distance between an entry now and at the bound's stamp: its net displacement, never more than the sum of its moves from
round to round. If the upper bound stays below the lower one, the entry can't have changed. Else the upper bound is
measured anew; if that isn't enough, all entries are scanned. Bounds decide only where they differ by more than rounding.

Every round is one pass over the rows, whose states are checkpointed with the vectors. Each task sums its parts by
entry; Spark adds these sums up, so the driver gets one row for each component of the codebooks, whatever the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import cut, fresh, if_small, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6


def state_type(parts: int) -> np.dtype:
    """entry, and upper and lower bound with the rounds of their measurement, for each part of a vector."""
    return np.dtype([("entry", "u1", parts), ("upper_at", "u1", parts), ("lower_at", "u1", parts), ("upper", "<f8", parts), ("lower", "<f8", parts)])


def scanned(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each row (the first of several), the distance to it and to the nearest other one."""
    d = np.empty((len(x), len(book)), np.int64)
    for e, entry in enumerate(book):
        away = x - entry
        d[:, e] = np.einsum("ij,ij->i", away, away)
    nearest, rows = d.argmin(1), np.arange(len(x))
    upper = np.sqrt(d[rows, nearest].astype(float))
    d[rows, nearest] = np.iinfo(np.int64).max
    return nearest, upper, np.sqrt(d.min(1).astype(float)) if len(book) > 1 else np.full(len(x), np.inf)


def assigned(x: np.ndarray, state: np.ndarray | None, history: np.ndarray) -> tuple[np.ndarray, int]:
    """The states of vectors x (rows of integers) for the newest codebooks of history (round, part, entry, component), and
    the number of parts that were scanned. state: that of the round before, None in the first."""
    now, parts, width = len(history) - 1, history.shape[1], history.shape[3]
    out = np.zeros(len(x), state_type(parts)) if state is None else state.copy()
    scans = 0
    for p in range(parts):
        mine, book = x[:, p * width : (p + 1) * width], history[now, p]
        if state is None:
            rows = np.arange(len(x))
        else:
            moves = np.sqrt(((history[:, p] - book) ** 2).sum(-1).astype(float))  # (round, entry), from there to now
            entry, at = out["entry"][:, p].astype(np.int64), out["lower_at"][:, p]
            # The farthest net displacement of the other entries since each round, by the entry that is left out.
            others = np.stack([np.delete(moves, e, 1).max(1, initial=0.0) for e in range(len(book))], 1)
            lower = out["lower"][:, p] - others[at, entry]
            upper = out["upper"][:, p] + moves[out["upper_at"][:, p], entry]
            slack = 1e-9 + 1e-12 * (np.abs(lower) + upper + out["lower"][:, p])
            rows = np.flatnonzero(~(upper + slack < lower))
            away = mine[rows] - book[entry[rows]]
            upper = np.sqrt(np.einsum("ij,ij->i", away, away).astype(float))
            out["upper"][rows, p], out["upper_at"][rows, p] = upper, now
            rows = rows[~(upper + slack[rows] < lower[rows])]
        scans += len(rows)
        nearest, upper, lower = scanned(mine[rows], book)
        out["entry"][rows, p], out["upper"][rows, p], out["lower"][rows, p] = nearest, upper, lower
        out["upper_at"][rows, p] = out["lower_at"][rows, p] = now
    return out, scans


def integers(batch: pa.RecordBatch, at: int, d: int) -> np.ndarray:
    """The vectors of a batch as rows of integers; distances between any two must fit a long."""
    x = np.floor(float(SCALE) * batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, d))
    if x.size and np.abs(x).max() ** 2 * 4 * d >= 2**62:
        raise ValueError("a component is so large that squared distances don't fit a long")
    return x.astype(np.int64)


def usable(vector: str) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.col(vector).isNotNull() & ~F.exists(vector, bad)


def learnt(rows: DataFrame, d: int, first: np.ndarray, rounds: int, parts: int) -> tuple[np.ndarray, DataFrame]:
    """The codebooks of all rounds (round, part, entry, component), and rows (key, label, vector) with the state of the
    last but one."""
    history, frame = first[None], rows
    for now in range(rounds):
        seen = history.copy()

        def step(batches: Iterator[pa.RecordBatch], seen: np.ndarray = seen) -> Iterator[pa.RecordBatch]:
            kind = state_type(parts)
            for batch in batches:
                old = np.frombuffer(b"".join(batch.column(3).to_pylist()), kind) if batch.num_columns > 3 else None
                state, _ = assigned(integers(batch, 2, d), old, seen)
                packed = pa.array([s.tobytes() for s in state], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], [*batch.schema.names[:3], "state"])

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(history.shape[1:], np.int64)
            counts = np.zeros(history.shape[1:3], np.int64)
            width = d // parts
            for batch in batches:
                x = integers(batch, 0, d)
                entry = np.frombuffer(b"".join(batch.column(1).to_pylist()), state_type(parts))["entry"]
                for p in range(parts):
                    np.add.at(total[p], entry[:, p], x[:, p * width : (p + 1) * width])
                    counts[p] += np.bincount(entry[:, p], minlength=counts.shape[1])
            p, e = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

        frame = cut(frame.mapInArrow(step, T.StructType([*rows.schema.fields, T.StructField("state", T.BinaryType())])))
        found = frame.select("vector", "state").mapInArrow(sums, "part long, entry long, n long, total array<long>")
        means = found.select("part", "entry", "n", F.posexplode("total").alias("place", "x")).groupBy("part", "entry", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
        book = history[now].copy()
        for row in means.collect():  # one row for each component of the codebooks
            book[row.part, row.entry, row.place] = int(row.x) // row.n
        history = np.concatenate([history, book[None]])
    return history, frame


def coded(df: DataFrame, key: str, vector: str, label: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(key, label, code, error) of every usable vector, and the final codebooks (part, entry, component).

    Vectors that are null or hold null or non-finite components are left out, and so are those of another length than
    most (of several lengths as frequent, the longest stays); that length must be a multiple of `parts`. Codebooks begin
    as the vectors of the least keys, ties by vector, null keys last; with fewer vectors they have fewer entries. Rows that
    repeat are coded each. No usable vector: no rows and empty codebooks.
    """
    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector")).where(usable("vector"))
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return rows.select("key", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    d = sizes.d
    if d % parts:
        raise ValueError(f"vectors of {d} components can't be cut into {parts} equal parts")
    rows = rows.where(F.size("vector") == d)
    least = rows.orderBy(F.asc_nulls_last("key"), "vector").limit(entries).collect()
    start = np.floor(float(SCALE) * np.array([r.vector for r in least], float).reshape(len(least), d)).astype(np.int64)
    first = start.reshape(len(least), parts, d // parts).transpose(1, 0, 2).copy()
    history, frame = learnt(rows, d, first, rounds, parts)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch, 2, d)
            old = np.frombuffer(b"".join(batch.column(3).to_pylist()), state_type(parts)) if batch.num_columns > 3 else None
            entry = assigned(x, old, history)[0]["entry"]
            chosen = history[-1][np.arange(parts), entry].reshape(len(x), d)
            codes = [s.tobytes().hex() for s in np.ascontiguousarray(entry)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(codes, pa.string()), pa.array(((x - chosen) ** 2).sum(1), pa.int64())], ["key", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return frame.mapInArrow(last, f"key {kinds['key']}, label {kinds['label']}, code string, error long"), history[-1]


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every embedding, its error and that of its label. Null labels are one label."""
    found, books = coded(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    codes = cut(found)
    listed = ",".join(str(x) for x in books.ravel().tolist())
    name = fresh(codes.columns, "_label")
    labels = cut(codes.groupBy(F.col("label").alias(name)).agg(F.sum("error").alias("label_error")))
    joined = codes.join(if_small(labels), F.col("label").eqNullSafe(F.col(name)))
    return joined.select(F.col("key").alias("vec_id"), "code", "error", "label_error", F.lit(hashlib.sha256(listed.encode()).hexdigest()).alias("codebooks_sha256"))


def _oracle(rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES) -> str:
    """Plain rounds of exact k-means."""
    ctes = [f"""k AS MATERIALIZED (SELECT row_number() OVER () AS row_no, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            f"""pt AS MATERIALIZED (SELECT row_no, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM k, range({parts}) t(p))""",
            f"""b0 AS MATERIALIZED (SELECT p, e, x AS c FROM pt JOIN (SELECT row_no, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM k QUALIFY e < {entries}) USING (row_no))"""]
    for t in range(rounds + 1):
        ctes.append(f"""a{t} AS MATERIALIZED (SELECT row_no, p, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {entries} + e) AS m FROM pt JOIN b{t} USING (p) GROUP BY 1, 2)""")
        if t < rounds:
            ctes.append(f"""s{t} AS MATERIALIZED (SELECT p, m % {entries} AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{t} JOIN pt USING (row_no, p), range(1, 1 + (SELECT max(len(x)) FROM pt)) r(i) GROUP BY 1, 2, 3)""")
            ctes.append(f"""b{t + 1} AS MATERIALIZED (SELECT p, e, coalesce(c2, c) AS c FROM b{t} LEFT JOIN (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c2 FROM s{t} GROUP BY 1, 2) USING (p, e))""")
    last = rounds
    return f"""WITH {', '.join(ctes)},
r AS (SELECT row_no, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM a{last} GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
 (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{last}) AS codebooks_sha256 FROM r JOIN k USING (row_no)"""


ORACLE = _oracle()
