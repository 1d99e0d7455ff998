"""Byte-level BPE: encoding by overlapping chunks, and decoding.

A text is cut into chunks that overlap. Every chunk is pre-tokenised on its own, in parallel, as if a pre-token began
where it begins. A match of the pattern depends on nothing in front of it, so once two chunks have a pre-token boundary
in common, all later boundaries agree: there the chunks are stitched. The first chunk's boundaries are true, so those of
each chunk are, from its stitch on. The pre-tokens between two stitches are encoded by the ranks, each on its own. Texts
in which two chunks don't meet within the overlap (one run longer than it) are pre-tokenised whole. Decoding joins the
bytes of the ids.

Ids are held as little-endian unsigned 32-bit integers in one binary value. Chunks of equal texts are encoded once.
"""

from __future__ import annotations

import base64
import functools
import struct
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import cut, fresh, if_small, small_batches, table

#: Code points of a chunk and of what it shares with the next one. Moving a text costs disk, and 64 K code points are
#: encoded in a tenth of a second, so only longer texts are worth it.
CHUNK, OVERLAP = 65_536, 1_024
#: Boundaries so near to a chunk's right end may change with what follows: a contraction has three signs.
MARGIN = 3
#: Pre-tokens that a worker keeps with their ids; longer ones than LONG are not kept.
MEMO, LONG = 400_000, 64
#: Stands for a sign that is neither letter, number nor space.
SIGN = "�"


class Ranks(dict):
    """Pre-token to its packed ids; what is new is encoded and kept."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.pattern = regex.compile(pattern)
        self.stand_in = dict.fromkeys(map(ord, self.unlike(pattern)), SIGN)
        self.masked = np.zeros(sys.maxunicode + 1, bool)
        self.masked[list(self.stand_in)] = True

    @staticmethod
    def unlike(pattern: str) -> list[str]:
        """The code points that `regex` takes for letters or numbers and the library for signs, as their tables of Unicode
        are of different years. Asked with ranks that join a letter or a digit to the byte behind it in one pre-token."""
        import regex
        import tiktoken

        unknown = "".join(c for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and unicodedata.category(c := chr(i)) == "Cn")
        ranks = {bytes([b]): b for b in range(256)} | {bytes([lead, b]): 256 * k + b for k, lead in enumerate(b"a1", 1) for b in range(256)}
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return [c for c in regex.findall(r"[\p{L}\p{N}]", unknown) if all(probe.encode_ordinary(lead + c)[0] < 256 for lead in "a1")]

    def __missing__(self, piece: str) -> bytes:
        ids = self.library.encode_ordinary(piece)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONG:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = packed
        return packed

    def pieces(self, text: str, start: int = 0) -> list[str]:
        """The pre-tokens of text from `start` on."""
        if text.isascii() or not self.masked[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
            return self.pattern.findall(text, start)
        shown, at = self.pattern.findall(text.translate(self.stand_in), start), start
        for k, piece in enumerate(shown):
            shown[k] = text[at : at + len(piece)]
            at += len(piece)
        return shown

    def encode(self, pieces: Iterable[str]) -> bytes:
        return b"".join(map(self.__getitem__, pieces))

    def decode(self, packed: bytes | None) -> bytes | None:
        """The bytes of packed ids; None if they aren't whole ids of the vocabulary."""
        if packed is None or len(packed) % 4:
            return None
        ids = np.frombuffer(packed, "<u4")
        if len(ids) and int(ids.max()) >= len(self.bytes_of):
            return None
        try:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        except TypeError:
            return None


@functools.lru_cache(2)
def ranks_of(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


def _rows(columns: list[str], read: list[str], make: Callable[..., list], kind: pa.DataType) -> Callable:
    """A function for mapInArrow that keeps `columns` and adds what `make` returns for the values of `read`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(make(*(batch.column(c).to_pylist() for c in read)), kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), made], [*columns, "_made"])

    return run


def _with(df: DataFrame, columns: list[str], read: list[str], make: Callable[..., list], kind: pa.DataType, ddl: T.DataType, out: str) -> DataFrame:
    fields = [df.schema[c] for c in columns] + [T.StructField("_made", ddl)]
    return df.mapInArrow(_rows(columns, read, make, kind), T.StructType(fields)).withColumnRenamed("_made", out)


def _cut_up(chunk: int, overlap: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows):
            return pa.RecordBatch.from_pylist(rows, pa.schema([("digest", pa.string()), ("no", pa.int64()), ("begin", pa.int64()), ("closed", pa.bool_()), ("part", pa.string())]))

        rows = []
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for no, begin in enumerate(range(0, len(text), chunk)):
                    part = text[begin : begin + chunk + overlap]
                    rows.append({"digest": digest, "no": no, "begin": begin, "closed": begin + len(part) == len(text), "part": part})
                    if len(rows) >= 100:
                        yield made(rows)
                        rows = []
        yield made(rows)

    return run


def stitched(texts: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(digest, ids) of texts (digest, text) of more than one chunk, equal ones once."""
    parts = texts.mapInArrow(_cut_up(chunk, overlap), "digest string, no long, begin long, closed boolean, part string")
    parts = parts.groupBy("digest", "no").agg(*[F.first(c).alias(c) for c in ("begin", "closed", "part")])

    def bounds(begins, closed, shown):
        out = []
        for begin, whole, part in zip(begins, closed, shown):
            most = len(part) - (0 if whole else MARGIN)
            found = [s for s in accumulate(map(len, ranks_of(path, pattern).pieces(part)), initial=0) if s <= most]
            out.append([begin + s for s in found if s < overlap or s >= chunk])
        return out

    columns = ["digest", "no", "begin", "part"]
    held = cut(_with(parts, columns, ["begin", "closed", "part"], bounds, pa.list_(pa.int64()), T.ArrayType(T.LongType()), "bounds"))
    inside = lambda low, high: F.filter("bounds", lambda b: (b >= F.col("begin") + low) & (b < F.col("begin") + high))
    tails = held.select("digest", "no", inside(chunk, chunk + overlap).alias("_tail"))
    heads = held.where("no > 0").select("digest", (F.col("no") - 1).alias("no"), inside(0, overlap).alias("_head"))
    links = cut(tails.join(heads, ["digest", "no"]).select("digest", "no", F.array_min(F.array_intersect("_tail", "_head")).alias("stitch")))
    apart = if_small(cut(links.where("stitch IS NULL").select("digest").distinct()))
    near = if_small(links)  # so that chunks stay where they are, if there are not too many

    def encoded(begins, shown, firsts, lasts):
        ranks, out = ranks_of(path, pattern), []
        for begin, part, first, last in zip(begins, shown, firsts, lasts):
            start = 0 if first is None else first - begin
            pieces = ranks.pieces(part, start)
            if last is not None:
                ends = list(accumulate(map(len, pieces), initial=start))
                pieces = pieces[: ends.index(last - begin)]
            out.append(ranks.encode(pieces))
        return out

    firsts = near.select("digest", (F.col("no") + 1).alias("no"), F.col("stitch").alias("first"))
    ready = held.join(apart, "digest", "left_anti").join(near.withColumnRenamed("stitch", "last"), ["digest", "no"], "left").join(firsts, ["digest", "no"], "left")
    ids = _with(ready, ["digest", "no"], ["begin", "part", "first", "last"], encoded, pa.binary(), T.BinaryType(), "ids")
    joined = ids.groupBy("digest").agg(F.expr("listagg(ids) WITHIN GROUP (ORDER BY no)").alias("ids"))
    whole = texts.join(apart, "digest", "left_semi").dropDuplicates(["digest"])
    return joined.unionByName(_with(whole, ["digest"], ["text"], lambda ts: [ranks_of(path, pattern).encode(ranks_of(path, pattern).pieces(t)) for t in ts], pa.binary(), T.BinaryType(), "ids"))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """df without `text`, with the packed ids of every text in `out` (a column of that name is replaced).

    Null texts are encoded as empty ones, to no ids. Texts of one chunk are encoded where they are read; only those of
    more are shuffled, by chunk. Repeated rows stay, and no column but `text` has any influence. No rows: no rows.
    """
    if not 0 < overlap < chunk:
        raise ValueError("the overlap has to be shorter than a chunk")
    rest = [c for c in df.columns if c not in (text, out)]
    digest = fresh(df.columns, "_digest")
    whole = df.where(F.coalesce(F.length(text) <= chunk, F.lit(True))).select(*rest, F.coalesce(text, F.lit("")).alias(text))
    done = _with(whole, rest, [text], lambda ts: [ranks_of(path, pattern).encode(ranks_of(path, pattern).pieces(t)) for t in ts], pa.binary(), T.BinaryType(), out)
    long = df.where(F.length(text) > chunk)
    ids = stitched(long.select(F.sha2(text, 256).alias("digest"), F.col(text).alias("text")), path, pattern, chunk, overlap)
    named = long.select(*rest, F.sha2(text, 256).alias(digest)).join(ids.select(F.col("digest").alias(digest), F.col("ids").alias(out)), digest).drop(digest)
    return done.unionByName(named)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df without `ids`, with the bytes of every row's packed ids in `out`: null for null ids, and where they are not
    whole ids of the vocabulary."""
    rest = [c for c in df.columns if c not in (ids, out)]
    return _with(df, rest, [ids], lambda xs: [ranks_of(path, pattern).decode(x) for x in xs], pa.binary(), T.BinaryType(), out)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents encoded and decoded again: counts and digests of both."""
    import public_tokenizers

    small_batches(spark)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    counted = ids.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return decode(counted, path, pattern).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
