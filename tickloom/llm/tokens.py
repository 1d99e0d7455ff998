"""Token ids of whole texts by a public tokenizer, with a memo of words.

The `tokenizers` library encodes every distinct word once; a text's ids are those of its words. That is exact because
the tokenizers used here split texts at white space before they merge: the lower-casing word tokenizer drops it, the
byte-level one puts a single space in front of the word that follows and makes pieces of their own of the rest. Within a
word they split letters from the signs behind them, so words are learnt as a stem and its signs. Stems are given to the
library many in one text, whose ids are cut again at the tokens that end a word (word tokenizer) or begin with its space
(byte level). Byte-level texts with control characters that the library and Python class differently are encoded whole.

The words of a batch are told apart by Arrow's dictionary encoding, so the memo is asked once for each distinct word, and
lists of ids are put together by Arrow's `take`. Byte-level texts are cut where their UTF-8 bytes tell: words are slices of
the batch's bytes, and a plain word's signs are a word of their own. Only texts with runs of white space or rarer white
space are cut one by one.
"""

from __future__ import annotations

import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words in the memo at most; when it is full, those seen most stay. At byte level a word takes some 60 bytes, else 270, so that
#: memo has four fifths of the room. Longer words than LONG are not kept.
MEMO = 370_000
LONG = 64
IRREGULAR = re.compile(r"[^\S \n]|[ \n][ \n]|\0")
SEPARATORS = re.compile("[\x00\x1c-\x1f]")
PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s")
#: Signs that are no part of a contraction.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters of which every tokenizer makes words in the same way, in either case.
LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c != "\u0130")
#: Stems that the library gets in one text.
JOINED = 200
#: Kinds of UTF-8 bytes. RARE are those of white space other than SPACE and LINE, of NUL and separators, or may begin such.
OTHER, SPACE, LINE, LETTER, SIGN, RARE, LATIN = range(7)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[[ord(" "), ord("\n")]] = SPACE, LINE
KINDS[[b for b in range(128) if chr(b) in LETTERS]] = LETTER
KINDS[[ord(c) for c in SIGNS]] = SIGN
KINDS[0xC3:0xC9] = LATIN  # first of the two bytes of a letter, but for these three
NO_LETTERS = [(0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0)]
KINDS[[0, *b"\t\v\f\r", 0x1C, 0x1D, 0x1E, 0x1F, *{c.encode()[0] for c in map(chr, range(0x80, 0x3001)) if c.isspace()}]] = RARE
#: The characters in which byte-level tokenizers write bytes.
PRINTED = np.isin(np.arange(256), [*range(33, 127), *range(161, 173), *range(174, 256)])
WRITTEN = np.where(PRINTED, np.arange(256), 255 + np.cumsum(~PRINTED)).astype("<u2")

#: Lists of ids, one behind the other, and where each begins; the last number is the end.
Lists = tuple[np.ndarray, np.ndarray]


def taken(lists: Lists, rows: np.ndarray) -> Lists:
    """The lists of these rows."""
    ids, starts = lists
    found = pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), pa.array(ids, pa.uint32())).take(pa.array(rows, pa.int64()))
    offsets = found.offsets.to_numpy()
    return found.flatten().to_numpy(), offsets - offsets[0]


def joined(*parts: Lists) -> Lists:
    """All lists of all parts, in order."""
    ends = np.cumsum([0, *(len(ids) for ids, _ in parts)])
    return np.concatenate([ids for ids, _ in parts]), np.concatenate([[0], *(starts[1:] + end for (_, starts), end in zip(parts, ends))])


class TextEncoder:
    """ids of texts; `byte_level` tells how the tokenizer treats spaces."""

    def __init__(self, path: str, byte_level: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core already
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.byte_level = byte_level
        vocabulary = self.tokenizer.get_vocab()
        #: Whether an id begins a word with its space, or ends a word.
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.edge[i] = token.startswith("\u0120") if byte_level else token.endswith("</w>")
        self.plain = re.compile(f"({' ' * byte_level}[{LETTERS}]+)([{re.escape(SIGNS)}]*)").fullmatch
        if byte_level:
            self.stems_only = f"^ [{LETTERS}]+\\z"
            #: The same merges for stems whose bytes are WRITTEN already.
            self.merger = Tokenizer(self.tokenizer.model)
            self.merger.pre_tokenizer = pre_tokenizers.Split("\u0120", "merged_with_next")
        #: Words by row; as a column at byte level.
        self.memo: dict[str, int] | pa.Array = pa.array([], pa.large_string()) if byte_level else {}
        self.lists: Lists = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.seen = np.zeros(0, np.int64)

    def worth(self) -> np.ndarray:
        """The rows of words that were seen twice, of half the room those seen most."""
        keep = np.flatnonzero(self.seen > 1)
        if len(keep) > MEMO // 2:
            keep = np.sort(keep[np.argpartition(self.seen[keep], len(keep) - MEMO // 2)[len(keep) - MEMO // 2 :]])
        return keep

    def forget(self) -> None:
        """Drop the words that are not worth their room."""
        keep = self.worth()
        words = list(self.memo)
        self.memo = {words[i]: n for n, i in enumerate(keep.tolist())}
        self.lists, self.seen = taken(self.lists, keep), np.ones(len(keep), np.int64)

    def units(self, texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts, and how many each text has."""
        if not self.byte_level:
            split = pc.split_pattern(pc.replace_substring(pa.array([t or "" for t in texts], pa.large_string()), "\n", " "), " ")
            return split.flatten(), np.diff(split.offsets.to_numpy())
        column = pa.array([t or "" for t in texts], pa.large_string())
        bounds, data = np.frombuffer(column.buffers()[1], np.int64)[: len(texts) + 1], column.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[: bounds[-1]] if bounds[-1] else np.zeros(0, np.uint8)
        kinds = KINDS[raw]
        latin = np.flatnonzero(kinds == LATIN) + 1
        kinds[latin - 1] = kinds[latin] = LETTER
        for pair in NO_LETTERS:
            none = latin[(raw[latin - 1] == pair[0]) & (raw[latin] == pair[1])]
            kinds[none - 1] = kinds[none] = OTHER
        white = (kinds == SPACE) | (kinds == LINE)
        begins = white.copy()  # whether a word begins with this byte
        begins[1:] |= kinds[:-1] == LINE
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        odd = kinds == RARE
        odd[1:] |= white[1:] & white[:-1]
        for i in np.unique(np.searchsorted(bounds, np.flatnonzero(odd), "right") - 1).tolist():
            begins[bounds[i] : bounds[i + 1]] = False
            ends = np.cumsum([len(piece.encode()) for piece in self.pieces(texts[i])])
            begins[bounds[i] + np.concatenate([[0], ends[ends < ends[-1]]])] = True
        # A word of a space, letters and signs is cut before its signs.
        to_signs = np.zeros(len(kinds), bool)
        to_signs[1:] = (kinds[1:] == SIGN) & (kinds[:-1] == LETTER) & ~begins[1:]
        odd = (kinds == OTHER) | (kinds == RARE) | (white & ~begins) | (begins & (kinds != SPACE))
        odd[1:] |= (kinds[1:] == LETTER) & (kinds[:-1] == SIGN)
        word = np.cumsum(begins, dtype=np.int32)
        whole = np.zeros(len(word) and int(word[-1]) + 1, bool)
        whole[word[odd]] = True
        cuts = np.flatnonzero(to_signs)
        begins[cuts[~whole[word[cuts]]]] = True
        starts = np.append(np.flatnonzero(begins), bounds[-1])
        return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), data), np.diff(np.searchsorted(starts[:-1], bounds))

    def pieces(self, text: str) -> list[str]:
        if IRREGULAR.search(text):
            return [text] if SEPARATORS.search(text) else PIECES.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def library(self, words: list[str], merger: bool = False) -> Lists:
        found = [e.ids for e in (self.merger if merger else self.tokenizer).encode_batch_fast(words, add_special_tokens=False)]
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        starts = np.concatenate([[0], ends]).astype(np.int64)
        return np.fromiter(chain.from_iterable(found), np.uint32, int(starts[-1])), starts

    def stem(self, word: str) -> tuple[str, str]:
        """The letters of a word and the signs behind them; ("", word) if it is not of that kind."""
        found = self.plain(word)
        return found.groups() if found else ("", word)

    def stem_ids(self, stems: list[str]) -> Lists:
        """The ids of stems, by texts of JOINED stems each."""
        between = "" if self.byte_level else " "
        return self.cut_ids(self.library([between.join(stems[i : i + JOINED]) for i in range(0, len(stems), JOINED)])[0], len(stems))

    def cut_ids(self, ids: np.ndarray, n: int) -> Lists:
        """The lists of n stems that were encoded side by side."""
        edges = np.flatnonzero(self.edge[ids])
        starts = np.append(edges, len(ids)) if self.byte_level else np.concatenate([[0], edges + 1])
        if len(starts) != n + 1:
            raise ValueError("the tokenizer does not tell words apart by their ids")
        return ids, starts

    def learnt(self, words: pa.Array) -> Lists:
        """The ids of new words."""
        if not self.byte_level:
            return self.learnt_apart(words.to_pylist())
        plain = pc.match_substring_regex(words, self.stems_only)
        stems, others = words.filter(plain), words.filter(pc.invert(plain))
        if not len(stems):
            return self.learnt_apart(others.to_pylist())
        bounds, written = np.frombuffer(stems.buffers()[1], np.int64)[: len(stems) + 1], WRITTEN[np.frombuffer(stems.buffers()[2], np.uint8)]
        ends = [*bounds[:-1:JOINED].tolist(), int(bounds[-1])]
        texts = [written[a:b].tobytes().decode("utf-16-le") for a, b in zip(ends, ends[1:])]
        row = np.empty(len(words), np.int64)
        is_stem = plain.to_numpy(zero_copy_only=False)
        row[is_stem], row[~is_stem] = np.arange(len(stems)), np.arange(len(stems), len(words))
        return taken(joined(self.cut_ids(self.library(texts, True)[0], len(stems)), self.learnt_apart(others.to_pylist())), row)

    def learnt_apart(self, words: list[str]) -> Lists:
        """The ids of new words, by stems and the signs behind them."""
        split = list(map(self.stem, words))
        stems, tails = [s for s, _ in split], [t for _, t in split]
        if not self.byte_level:  # case does not count
            stems = [s.lower() for s in stems]
        rows = {s: -1 if self.byte_level else self.memo.get(s, -1) for s in dict.fromkeys(stems) if s}
        known, new = [s for s, r in rows.items() if r >= 0], [s for s, r in rows.items() if r < 0]
        place = {s: i for i, s in enumerate(chain(known, new, ("",)))}  # no stem: an empty list
        signs = {t: i for i, t in enumerate(dict.fromkeys(tails), len(place))}
        of_known = taken(self.lists, np.array([rows[s] for s in known], np.int64))
        parts = joined(of_known, self.stem_ids(new), (np.zeros(0, np.uint32), np.zeros(2, np.int64)), self.library(list(signs)))
        both = np.empty(2 * len(words), np.int64)
        both[::2], both[1::2] = [place[s] for s in stems], [signs[t] for t in tails]
        ids, starts = taken(parts, both)
        return ids, starts[::2]

    def encode(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, each followed by `end`, and the offsets of the texts in them."""
        units, counts = self.units(texts)
        if self.byte_level:
            return self.encode_units(units, counts, end)
        coded = units.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        before = np.cumsum(counts)
        at = np.insert(coded.indices.to_numpy().astype(np.int64), before, len(words))  # the last row: the end of a text
        of_text = np.concatenate([[0], before + np.arange(1, len(texts) + 1)])
        times = np.bincount(at, minlength=len(words) + 1)[:-1]
        rows = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(rows < 0)
        if len(self.memo) + len(new) > 4 * MEMO // 5 and self.memo:
            self.forget()
            rows = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
            new = np.flatnonzero(rows < 0)
        learnt = self.learnt(coded.dictionary.take(pa.array(new)))
        old = np.flatnonzero(rows >= 0)
        self.seen[rows[old]] += times[old]
        row_of = np.empty(len(words) + 1, np.int64)
        row_of[old], row_of[new], row_of[-1] = np.arange(len(old)), np.arange(len(old), len(words)), len(words)
        ids, starts = taken(joined(taken(self.lists, rows[old]), learnt, (np.array([end], np.uint32), np.array([0, 1]))), row_of[at])
        if len(new):  # long words are not worth their memory
            names = [words[i] for i in new.tolist()]
            kept = np.flatnonzero(pc.utf8_length(coded.dictionary).to_numpy()[new] <= LONG)[: max(0, 4 * MEMO // 5 - len(self.memo))]
            self.memo.update(zip([names[i] for i in kept.tolist()], range(len(self.memo), len(self.memo) + len(kept))))
            self.lists, self.seen = joined(self.lists, taken(learnt, kept)), np.concatenate([self.seen, times[new[kept]]])
        return ids, starts[of_text]

    def encode_units(self, units: pa.Array, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for words at byte level. The memo's words are told apart with them, and come first."""
        known = len(self.memo)
        coded = pa.concat_arrays([self.memo, units]).dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy()[known:]
        times = np.bincount(at, minlength=len(words))
        lists = joined(self.lists, self.learnt(words.slice(known).take(pa.array(np.arange(len(words) - known)))))
        before = np.cumsum(counts)
        at = np.insert(at, before, len(words))  # the last row: the end of a text
        ids, starts = taken(joined(lists, (np.array([end], np.uint32), np.array([0, 1]))), at)
        seen = np.concatenate([self.seen, np.zeros(len(words) - known, np.int64)]) + times
        new = known + np.flatnonzero(pc.utf8_length(words.slice(known)).to_numpy() <= LONG)  # long words are not worth their memory
        old = np.arange(known)
        if known + len(new) > MEMO and known:
            self.seen = seen[:known]
            old = self.worth()
            seen[old] //= 2
        keep = np.concatenate([old, new])[:MEMO]
        self.memo, self.lists, self.seen = words.take(pa.array(keep)), taken(lists, keep), seen[keep]
        return ids, starts[np.concatenate([[0], before + np.arange(1, len(counts) + 1)])]
