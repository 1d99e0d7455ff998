"""Token ids in compressed, independently decodable blocks.

A block holds up to BLOCK ids. Each id is coded by a mixture of three predictions: the id that last followed the two ids
before it (order 2), the id that last followed the id before it (order 1), and the frequencies of the block's ids so far that
those two missed (order 0). In order 0 an id that is new to the block is told by its class, whose share grows with the
new ids it had so far, and by its place there. How much weight orders 2 and 1 get depends on how often predictions of the
same confidence were right in the block so far. The mixture drives a range coder. All state starts anew with each block, and
a block carries a CRC-32 of its ids, so blocks are read alone and checked.

A block's ids are coded as up to STREAMS consecutive streams, each with a range coder of its own. They step side by side and
share the block's state: orders 2 and 1 change with each step, frequencies and weights after each of `_stages`. Blocks are
independent, so a task codes many at once: the coder's state is a numpy vector with a lane for each stream of each block.

A file is a Parquet folder with one row for each block: its part (ranges of doc_id in ascending order) and number, its
ids, steps, checksum and payload, and the index of its documents: id, ordinal in the part, ids in this block, and the
document's first position among the part's ids.

Defined results: null and empty texts are the end id alone. Documents are written in ascending doc_id order, null ids
first; rows that share an id are ordered by text and keep rows of their own. An empty table gives an empty file. Very
long texts run over many blocks. Only doc_id and text are read, so other columns may have any name. The file is written
while the query is built, in the shared checkpoint folder, and stays there.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import ensure_checkpoint_dir, small_batches, table
from tickloom.llm.packing import _encoder

END = 2
BLOCK = 8192
LANES = 512
#: Characters of the texts that are tokenized at once, at least.
CHARACTERS = 4 << 20
TABLE = 4096
BITS = 3
LEVELS = 1 << BITS
#: Streams of a block at most, ids of a stream at least, and blocks that are coded side by side.
STREAMS, LEAST, BESIDE = 16, 64, LANES
#: Ids are below ROOM. Ids that are new to a block are told by class: one bit behind the highest of id + 2, then the rest.
ROOM = 1 << 17
_SHIFTED = np.arange(ROOM) + 2
_WIDTH = np.frexp(_SHIFTED)[1] - 2
CLASS = (_WIDTH << 1) + (_SHIFTED >> _WIDTH) - 2
CLASSES = int(CLASS[-1]) + 1
FIRST = np.searchsorted(CLASS, np.arange(CLASSES))
SPAN = np.exp2(_WIDTH[FIRST])
#: Range coder: the range is 2 ** 32 to 2 ** 48, held as a float, which is exact; words of 16 bits are shifted out.
LEAST_RANGE, MOST_RANGE, WORD = 2.0**32, 2.0**48, 65536.0
#: Shares of the mixture's predictions add up to SHARES; order 0 has REST where the others' odds are reckoned.
SHARES, REST = 4096, 4096
#: A block learns from what its streams have coded after GROWTH times as many steps as the last time, or OFTEN more if that is sooner.
GROWTH, OFTEN = 1.35, 40
#: Counts of order 0 add up to less than this.
FULL = 65_000


def _streams(steps: int) -> int:
    return max(1, min(STREAMS, steps // LEAST))


def _stages(length: int) -> list[tuple[int, int]]:
    """Ranges of a stream's steps, after each of which the block learns."""
    ends = [0]
    while ends[-1] < length:
        ends.append(min(length, ends[-1] + OFTEN, max(ends[-1] + 1, int(ends[-1] * GROWTH))))
    return list(zip(ends, ends[1:]))


class _Model:
    """The predictions of all lanes: `streams` lanes of each block code its ids side by side and share what it has learnt."""

    def __init__(self, blocks: int, streams: int):
        self.blocks, self.streams, lanes = blocks, streams, blocks * streams
        self.block = np.repeat(np.arange(blocks), streams)
        self.blocks_of_stage = np.tile(self.block, OFTEN)
        self.two, self.one = np.zeros(blocks * TABLE, np.int32), np.zeros(blocks * TABLE, np.int32)  # id and confidence
        self.in_table, self.in_shares, self.in_odds = self.block * TABLE, self.block * (2 * LEVELS * LEVELS), self.block * (4 * LEVELS * LEVELS)
        self.hits, self.tries = np.ones((2, blocks, LEVELS)), np.full((2, blocks, LEVELS), 4.0)
        self.tries[:, :, 0] = 40
        self.last, self.before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        #: Order 0: an id's number among its block's ids, from 1; ids by number; how often each came, and classes of new ids.
        self.number = np.zeros(blocks * ROOM, np.int16)
        self.ids, self.sizes = np.zeros((blocks, 0), np.int64), np.zeros(blocks, np.int64)
        self.counts, self.news = np.zeros((blocks, 0), np.int64), np.ones((blocks, CLASSES), np.int64)
        self.outcomes: list[np.ndarray] = []
        self.steps = 0
        self.weigh()
        self.arrange()

    def weigh(self) -> None:
        """Shares of orders 2 and 1 by their confidences, from the odds of right predictions so far."""
        odds = np.floor(REST * self.hits / np.maximum(self.tries - self.hits, 1))
        two = np.minimum(odds[0], 30_000)[:, None, :, None] + 1
        one = np.stack([np.minimum(odds[1], 15_000) + 1, np.zeros((self.blocks, LEVELS))], 1)[:, :, None, :]  # none where both say the same
        total = two + one + REST
        first = 1 + np.floor(two * (SHARES - 3) / total)
        both = first + np.where(one > 0, 1 + np.floor(one * (SHARES - 3) / total), 0)
        self.shares = (first.astype(np.int32) | both.astype(np.int32) << 16).ravel()

    def arrange(self) -> None:
        """Order 0's shares: an id's is 2 n - 1 after n times, and one goes to its class as a new id."""
        self.width = CLASSES + self.ids.shape[1]
        weights = np.concatenate([self.news, np.maximum(2 * self.counts - 1, 0)], 1).ravel()
        ends = np.cumsum(weights)
        self.begins = np.concatenate([[0], ends[self.width - 1 :: self.width]])
        self.total = np.diff(self.begins).astype(np.float64)
        values = np.concatenate([np.broadcast_to(-1 - np.arange(CLASSES), (self.blocks, CLASSES)), self.ids], 1).ravel()
        starts = ends - weights - np.repeat(self.begins[:-1], self.width)
        #: A symbol's id, or -1 - class, where its shares start, and how many it has, in one number.
        self.symbols = values << 32 | starts << 16 | weights
        self.in_symbols = self.block * self.width
        self.weights = weights

    def slots(self) -> np.ndarray:
        """The symbol, counted in its block, of each of order 0's shares."""
        return np.repeat(np.tile(np.arange(self.width, dtype=np.uint16), self.blocks), self.weights)

    def predict(self) -> None:
        mixed = self.last * np.uint32(0x9E3779B1)
        self.at1 = (mixed >> np.uint32(20)).astype(np.intp) + self.in_table
        self.at2 = (mixed + self.before * np.uint32(0x85EBCA6B) >> np.uint32(20)).astype(np.intp) + self.in_table
        self.e2, self.e1 = self.two.take(self.at2), self.one.take(self.at1)
        self.c2, self.c1 = self.e2 & (LEVELS - 1), self.e1 & (LEVELS - 1)
        self.id2, self.id1 = self.e2 >> BITS, self.e1 >> BITS
        key = (self.c2 << BITS) + self.c1 + ((self.id1 == self.id2) * np.int32(LEVELS * LEVELS)) + self.in_shares
        both = self.shares.take(key)
        self.first, self.both = both & 0xFFFF, both >> 16

    def update(self, ids: np.ndarray) -> None:
        """`ids` int32. A prediction that was wrong gives way, unless it was right often; then it loses confidence."""
        fresh = ids << BITS
        right2, right1 = ids == self.id2, ids == self.id1
        for table, at, entry, confidence, right in ((self.two, self.at2, self.e2, self.c2, right2), (self.one, self.at1, self.e1, self.c1, right1)):
            wrong = np.where(confidence > 3, entry - 4, fresh)
            table[at] = np.where(right, entry + (confidence < LEVELS - 1), wrong)
        self.outcomes.append((((right1 * np.int32(LEVELS) + self.c1) * np.int32(2) + right2) << BITS) + self.c2)
        self.before, self.last = self.last, ids.view(np.uint32)
        self.steps += 1

    def learn(self, seen: np.ndarray, missed: np.ndarray, numbers: np.ndarray) -> None:
        """The odds of orders 1 and 2, and order 0 from the ids [step, lane] since the last time that those missed, and their numbers."""
        codes = np.stack(self.outcomes) + self.in_odds
        found = np.bincount(codes.ravel(), minlength=self.blocks * 4 * LEVELS * LEVELS).reshape(self.blocks, 2, LEVELS, 2, LEVELS)
        self.tries += found.sum((1, 2, 3)), found.sum((1, 3, 4))
        self.hits += found[..., 1, :].sum((1, 2)), found[:, 1].sum((2, 3))
        self.outcomes = []
        self.weigh()
        if 2 * self.steps * self.streams + CLASSES >= FULL:
            return
        lanes = np.flatnonzero(missed)
        numbers, of_lane = numbers.ravel()[lanes], self.blocks_of_stage.take(lanes)
        unknown = np.flatnonzero(numbers == 0)
        keys = seen.ravel()[lanes[unknown]] + of_lane[unknown] * ROOM
        new = np.unique(keys)
        if len(new):
            of, ids = new >> 17, new & (ROOM - 1)
            per_block = np.bincount(of, minlength=self.blocks)
            rank = self.sizes[of] + np.arange(len(new)) - (np.cumsum(per_block) - per_block)[of]
            self.number[new] = rank + 1
            numbers[unknown] = self.number.take(keys)
            self.sizes += per_block
            more = ((0, 0), (0, int(self.sizes.max()) - self.ids.shape[1]))
            self.ids, self.counts = np.pad(self.ids, more), np.pad(self.counts, more)
            self.ids[of, rank] = ids
            self.news += np.bincount(of * CLASSES + CLASS[ids], minlength=self.blocks * CLASSES).reshape(self.blocks, CLASSES)
        many = self.ids.shape[1]
        at = of_lane * many + (numbers - 1)
        self.counts += np.bincount(at, minlength=self.blocks * many).reshape(self.blocks, many)
        self.arrange()


class _Encoder:
    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes), np.full(lanes, MOST_RANGE)
        self.room = 3 * steps + 1
        self.out = np.zeros(lanes * self.room, np.uint32)  # words, with their carry
        self.at = np.arange(lanes) * self.room

    def put(self, start: np.ndarray, size: np.ndarray, total: np.ndarray | float) -> None:
        """Narrow all lanes to the shares from `start` on of `total`."""
        unit = np.floor(self.range / total)
        self.low += start * unit
        np.multiply(size, unit, out=self.range)

    def shift(self) -> None:
        """Shift words out of the lanes whose range is small."""
        small = self.range < LEAST_RANGE
        word = np.floor(self.low * (1 / LEAST_RANGE))
        self.out[self.at] = word  # written again by the next one, if this lane goes on
        self.at += small
        factor = np.where(small, WORD, 1.0)
        self.low -= word * small * LEAST_RANGE
        self.low *= factor
        self.range *= factor
        self.shift_in(np.flatnonzero(self.range < LEAST_RANGE))

    def shift_in(self, lanes: np.ndarray) -> None:
        """The same for a few lanes."""
        while len(lanes := lanes[self.range[lanes] < LEAST_RANGE]):
            low, at = self.low[lanes], self.at[lanes]
            word = np.floor(low * (1 / LEAST_RANGE))
            self.out[at] = word
            self.at[lanes] = at + 1
            self.low[lanes] = (low - word * LEAST_RANGE) * WORD
            self.range[lanes] *= WORD

    def put_bits(self, lanes: np.ndarray, value: np.ndarray, span: np.ndarray) -> None:
        """Narrow these lanes to one of `span` equal shares."""
        unit = np.floor(self.range[lanes] / span)
        self.low[lanes] += value * unit
        self.range[lanes] = unit

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """All words of all lanes, and how many each lane has."""
        self.out[self.at] = np.ceil(self.low * (1 / LEAST_RANGE))  # within the range, zeros behind it
        used = self.at + 1 - np.arange(len(self.at)) * self.room
        words = self.out.reshape(-1, self.room)[:, : used.max()].copy()
        while (carry := words >> 16).any():
            words &= 0xFFFF
            words[:, :-1] += carry[:, 1:]
        return words[np.arange(words.shape[1]) < used[:, None]].astype("<u2"), used


class _Decoder:
    def __init__(self, words: np.ndarray, used: np.ndarray):
        self.room = int(used.max()) + 3
        data = np.zeros((len(used), self.room), np.uint16)
        data[np.arange(self.room) < used[:, None]] = words
        self.code = data[:, 0] * LEAST_RANGE + data[:, 1] * WORD + data[:, 2]
        self.range = np.full(len(used), MOST_RANGE)
        self.data, self.at = data.ravel(), np.arange(len(used)) * self.room + 3

    def where(self, total: np.ndarray | float) -> np.ndarray:
        self.unit = np.floor(self.range / total)
        return np.minimum(self.code / self.unit, total - 1).astype(np.int32)

    def take(self, start: np.ndarray, size: np.ndarray) -> None:
        self.code -= start * self.unit
        np.multiply(size, self.unit, out=self.range)

    def shift(self) -> None:
        small = self.range < LEAST_RANGE
        factor = np.where(small, WORD, 1.0)
        self.code *= factor
        self.code += self.data.take(self.at, mode="clip") * small
        self.range *= factor
        self.at += small
        self.shift_in(np.flatnonzero(self.range < LEAST_RANGE))

    def shift_in(self, lanes: np.ndarray) -> None:
        while len(lanes := lanes[self.range[lanes] < LEAST_RANGE]):
            at = self.at[lanes]
            self.code[lanes] = self.code[lanes] * WORD + self.data.take(at, mode="clip")
            self.at[lanes] = at + 1
            self.range[lanes] *= WORD

    def take_bits(self, lanes: np.ndarray, span: np.ndarray) -> np.ndarray:
        unit = np.floor(self.range[lanes] / span)
        value = np.minimum(np.floor(self.code[lanes] / unit), span - 1)
        self.code[lanes] -= value * unit
        self.range[lanes] = unit
        return value


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Payloads of the rows of `ids` [block, step]; ids are below ROOM."""
    return [p for low in range(0, len(ids), BESIDE) for p in _encode_beside(ids[low : low + BESIDE])]


def _encode_beside(ids: np.ndarray) -> list[bytes]:
    blocks, steps = ids.shape
    streams = _streams(steps)
    length = -(-steps // streams)
    columns = np.ascontiguousarray(np.pad(ids.astype(np.int32), ((0, 0), (0, streams * length - steps))).reshape(-1, length).T)
    model, coder = _Model(blocks, streams), _Encoder(blocks * streams, length)
    missed = np.zeros(columns.shape, bool)
    for begun, ended in _stages(length):
        part = columns[begun:ended]
        total = model.total.take(model.block)
        numbers = model.number.take(part + model.block * ROOM)
        symbols = model.symbols.take(np.where(numbers > 0, numbers + (CLASSES - 1), CLASS.take(part)) + model.in_symbols).astype(np.uint32)
        starts, weights = symbols >> np.uint32(16), symbols & np.uint32(0xFFFF)
        for now, number, start, weight, miss in zip(part, numbers, starts, weights, missed[begun:ended]):
            model.predict()
            hit2 = now == model.id2
            np.logical_not(hit2 | (now == model.id1), out=miss)
            low = np.where(miss, model.both, np.where(hit2, 0, model.first))
            high = np.where(miss, SHARES, np.where(hit2, model.first, model.both))
            coder.put(low, high - low, SHARES)
            coder.put(start * miss, np.where(miss, weight, np.uint32(1)), np.where(miss, total, 1.0))
            new = np.flatnonzero(miss & (number == 0))
            if len(new):
                coder.shift_in(new)
                fresh = now[new]
                kind = CLASS.take(fresh)
                coder.put_bits(new, fresh - FIRST.take(kind), SPAN.take(kind))
            coder.shift()
            model.update(now)
        if ended < length:
            model.learn(part, missed[begun:ended], numbers)
    words, used = coder.finish()
    per_block = used.reshape(blocks, streams)
    ends = np.cumsum(per_block.sum(1))
    heads = per_block.astype(_length_type(length))
    return [heads[b].tobytes() + words[end - n : end].tobytes() for b, (end, n) in enumerate(zip(ends.tolist(), per_block.sum(1).tolist()))]


def _length_type(length: int) -> str:
    return "<u2" if 3 * length + 1 < 1 << 16 else "<u4"


def decode_blocks(payloads: list[bytes], steps: int) -> np.ndarray:
    return np.concatenate([_decode_beside(payloads[low : low + BESIDE], steps) for low in range(0, len(payloads), BESIDE)])


def _decode_beside(payloads: list[bytes], steps: int) -> np.ndarray:
    blocks, streams = len(payloads), _streams(steps)
    length = -(-steps // streams)
    kind = np.dtype(_length_type(length))
    used = np.concatenate([np.frombuffer(p, kind, streams) for p in payloads]).astype(np.int64)
    words = np.concatenate([np.frombuffer(p, "<u2", offset=streams * kind.itemsize) for p in payloads])
    model, coder = _Model(blocks, streams), _Decoder(words, used)
    out = np.zeros((length, blocks * streams), np.int32)
    missed, numbers = np.zeros(out.shape, bool), np.zeros(out.shape, np.int32)
    for begun, ended in _stages(length):
        slots = model.slots()
        in_slots, total = model.begins.take(model.block), model.total.take(model.block)
        for t in range(begun, ended):
            model.predict()
            at = coder.where(SHARES)
            hit2, miss = at < model.first, at >= model.both
            low = np.where(miss, model.both, np.where(hit2, 0, model.first))
            high = np.where(miss, SHARES, np.where(hit2, model.first, model.both))
            coder.take(low, high - low)
            number = slots.take(coder.where(np.where(miss, total, 1.0)) + in_slots)
            symbol = model.symbols.take(number + model.in_symbols)
            coder.take(symbol >> 16 & 0xFFFF, np.where(miss, symbol & 0xFFFF, 1))  # the first symbol's start is 0
            found = (symbol >> 32).astype(np.int32)
            np.maximum(number - np.int32(CLASSES - 1), 0, out=numbers[t])
            new = np.flatnonzero(miss & (found < 0))
            if len(new):
                coder.shift_in(new)
                kind = -1 - found[new]
                found[new] = np.minimum(FIRST.take(kind) + coder.take_bits(new, SPAN.take(kind)), ROOM - 1)
            coder.shift()
            now = np.where(miss, found, np.where(hit2, model.id2, model.id1))
            out[t], missed[t] = now, miss
            model.update(now)
        if ended < length:
            model.learn(out[begun:ended], missed[begun:ended], numbers[begun:ended])
    return out.T.reshape(blocks, streams * length)[:, :steps]


FILE_SCHEMA = "part int, block long, n_ids int, steps int, crc32 long, payload binary, doc_ids array<long>, ordinals array<long>, lengths array<long>, starts array<long>"


def _checksum(ids: np.ndarray, running: int = 0) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes(), running)


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str | None]]]:
    """Ids and texts of as many batches as have CHARACTERS, so that words are told apart in one go."""
    doc_ids, texts, characters = [], [], 0
    for batch in batches:
        doc_ids += batch["doc_id"].tolist()
        more = [t if isinstance(t, str) else None for t in batch["text"]]
        texts += more
        characters += sum(len(t) for t in more if t)
        if characters >= CHARACTERS:
            yield doc_ids, texts
            doc_ids, texts, characters = [], [], 0
    if texts:
        yield doc_ids, texts


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, partitions: int) -> None:
    """Encode the texts of `docs` (doc_id, text) and write their ids to a new folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part = _encoder(tokenizer_path, True), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        index: list[tuple] = []  # (doc_id, ordinal, first position, end position), positions in the part
        done = block = ordinal = position = 0

        def rows(final: bool) -> Iterator[pd.DataFrame]:
            nonlocal held, index, done, block
            ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
            while len(ids) >= LANES * BLOCK or (final and len(ids)):
                size = min(len(ids), LANES * BLOCK)
                lanes = -(-size // BLOCK)
                steps = min(size, BLOCK)
                padded = np.zeros(lanes * steps, np.uint32)
                padded[:size] = ids[:size]
                grid = padded.reshape(lanes, steps)
                out = []
                first = 0
                for lane, payload in enumerate(encode_blocks(grid)):
                    low = done + lane * BLOCK
                    n = min(BLOCK, size - lane * BLOCK)
                    while index[first][3] <= low:
                        first += 1
                    here = []
                    k = first
                    while k < len(index) and index[k][2] < low + n:
                        d, o, a, b = index[k]
                        here.append((d, o, min(b, low + n) - max(a, low), a))
                        k += 1
                    out.append((part, block, n, steps, _checksum(grid[lane, :n]), payload, *([x[j] for x in here] for j in range(4))))
                    block += 1
                yield pd.DataFrame(out, columns=["part", "block", "n_ids", "steps", "crc32", "payload", "doc_ids", "ordinals", "lengths", "starts"])
                ids = ids[size:]
                done += size
                index = [x for x in index if x[3] > done]
            held = [ids]

        waiting = 0
        for doc_ids, texts in _gathered(batches):
            ids, offsets = encoder.encode(texts, END)
            for d, a, b in zip(doc_ids, offsets[:-1].tolist(), offsets[1:].tolist()):
                index.append((None if pd.isna(d) else int(d), ordinal, position + a, position + b))
                ordinal += 1
            position += len(ids)
            held.append(ids)
            waiting += len(ids)
            if waiting >= LANES * BLOCK:
                yield from rows(False)
                waiting = len(held[0])
        yield from rows(True)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = source.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInPandas(run, FILE_SCHEMA).write.mode("errorifexists").parquet(path)


#: x ** 8, which is one zero byte, squared again and again.
_ZEROS = [1 << 23]


def combined_crc(first: int, second: int, n_bytes: int) -> int:
    """The CRC-32 of two joined byte strings from theirs: the first is shifted by n_bytes zero bytes."""

    def times(a: int, b: int) -> int:  # product of polynomials over GF(2), reduced; bits reflected
        product, bit = 0, 1 << 31
        while bit:
            if a & bit:
                product ^= b
            bit >>= 1
            b = (b >> 1) ^ 0xEDB88320 if b & 1 else b >> 1
        return product

    factor, k = 1 << 31, 0  # one
    while n_bytes >> k:
        if k == len(_ZEROS):
            _ZEROS.append(times(_ZEROS[-1], _ZEROS[-1]))
        if n_bytes >> k & 1:
            factor = times(factor, _ZEROS[k])
        k += 1
    return times(factor, first) ^ second


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone. A damaged block raises an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for steps, rows in batch.groupby("steps"):
                for low in range(0, len(rows), LANES):
                    lanes = rows.iloc[low : low + LANES]
                    ids = decode_blocks(list(lanes["payload"]), int(steps)).astype("<u4")
                    for lane, r in enumerate(lanes.itertuples()):
                        if _checksum(ids[lane, : r.n_ids]) != r.crc32:
                            raise ValueError(f"block {r.block} of part {r.part} is damaged")
                        raw, at = memoryview(ids[lane].tobytes()), 0
                        for d, o, n, s in zip(r.doc_ids, r.ordinals, r.lengths, r.starts):
                            out.append((r.part, o, d, s, r.block, n, zlib.crc32(raw[4 * at : 4 * (at + n)])))
                            at += n
            yield pd.DataFrame(out, columns=["part", "ordinal", "doc_id", "start", "block", "n", "crc"]).astype({"doc_id": "Int64"})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = []
            for sizes, crcs in zip(batch.pop("sizes"), batch.pop("crcs")):
                crc = int(crcs[0])
                for n, second in zip(sizes[1:].tolist(), crcs[1:].tolist()):
                    crc = combined_crc(crc, second, 4 * n)
                codes.append(crc)
            yield batch.assign(ids_crc32=codes)

    files = spark.read.parquet(path)
    found = files.mapInPandas(run, "part int, ordinal long, doc_id long, start long, block long, n long, crc long")
    documents = found.groupBy("part", "ordinal", "doc_id", "start").agg(F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("block", "n", "crc"))).alias("pieces"))
    # As many rows as the file has parts.
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    bases, total = [], 0
    for r in sizes:
        bases.append((r["part"], total))
        total += r["n"]
    base = spark.createDataFrame(bases, "part int, base long")
    joined = documents.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", F.col("pieces.n").alias("sizes"), F.col("pieces.crc").alias("crcs"))
    return joined.mapInPandas(join, "doc_id long, start long, n_tokens long, ids_crc32 long")


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_token_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path, byte_tokenizer(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_tokens(spark, path)
