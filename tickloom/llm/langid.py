"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. The likelihood of a word under a
language is the sum, over all ways to cut the word into pieces, of the product of their probabilities; a forward
pass over the positions of the word computes it. A text's likelihood is the product over its words, its prediction
the language of the largest posterior. Piece probabilities are fitted by expectation-maximisation with a forward and
backward pass over the same lattices.

Words are runs of letters of the lower-cased text; runs longer than BLOCK letters are cut into blocks of BLOCK.
Defined results: a null text, or one without letters, is `und` with score 0. Texts, languages or ids that are null
never train the model. Repeated rows are scored alike. If nothing can be learned, every text is `und`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import crc_mod, fresh, small_batches, table, thin

LETTERS = re.compile(r"[^\W\d_]+")
BLOCK = 48
LONGEST = 12
MARK = "▁"
#: Words whose scores a worker keeps; the memo is emptied when it is full.
MEMO = 400_000


def words_of(text: str | None) -> list[str]:
    found = LETTERS.findall(text.lower()) if text else []
    if not all(map(str.isalpha, found)):  # fractions, exponents and Roman numerals are no letters
        found = "".join(c if c.isalpha() else " " for c in " ".join(found)).split()
    if any(len(w) > BLOCK for w in found):
        found = [w[i : i + BLOCK] for w in found for i in range(0, len(w), BLOCK)]
    return found


def vocabulary(path: str) -> dict[str, int]:
    """Pieces of a public sentencepiece vocabulary, lower-case ones of at most LONGEST letters, numbered from 0."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    kept = sorted({p for p in pieces if len(p) <= LONGEST and p == p.lower()})
    return {p: i for i, p in enumerate(kept)}


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray  # log, by language
    pieces: dict[str, int]
    p: np.ndarray  # [pieces + 1, languages]; the last row is a letter outside the vocabulary


def lattices(words: list[str], pieces: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length: positions in `words`, and piece numbers [word, end, length - 1]; -1 where there is no piece."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w) + 1, []).append(i)
    unknown = len(pieces)
    get = pieces.get
    for n, members in by_length.items():
        step = max(1, 2_000_000 // (n * LONGEST))
        for s in range(0, len(members), step):
            part = members[s : s + step]
            out = np.full((len(part), n + 1, LONGEST), -1, np.int32)
            for r, i in enumerate(part):
                w = MARK + words[i]
                row = out[r]
                for end in range(1, n + 1):
                    for size in range(1, min(end, LONGEST) + 1):
                        piece = get(w[end - size : end])
                        if piece is not None:
                            row[end, size - 1] = piece
                    if row[end, 0] < 0:
                        row[end, 0] = unknown
            yield np.array(part), out


def forward(lattice: np.ndarray, p: np.ndarray) -> np.ndarray:
    """alpha[word, position, language]: probability of all segmentations up to the position."""
    padded = np.vstack([p, np.zeros((1, p.shape[1]))])
    count, ends, _ = lattice.shape
    alpha = np.zeros((count, ends, p.shape[1]))
    alpha[:, 0] = 1
    for end in range(1, ends):
        for size in range(1, min(end, LONGEST) + 1):
            alpha[:, end] += alpha[:, end - size] * padded[lattice[:, end, size - 1]]
    return alpha


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Log likelihood of every word under every language."""
    out = np.zeros((len(words), len(model.languages)))
    for at, lattice in lattices(words, model.pieces):
        out[at] = np.log(np.maximum(forward(lattice, model.p)[:, -1], 1e-300))
    return out


def fit(words: list[str], counts: np.ndarray, languages: list[str], rows: np.ndarray, pieces: dict[str, int], rounds: int = 3, smooth: float = 0.1) -> Model:
    """Expectation-maximisation of the piece probabilities from word counts [word, language]."""
    size = len(pieces) + 1
    p = np.full((size, len(languages)), 1.0 / size)
    kept = list(lattices(words, pieces))
    for _ in range(rounds):
        seen = np.zeros((size + 1, len(languages)))
        padded = np.vstack([p, np.zeros((1, len(languages)))])
        for at, lattice in kept:
            alpha = forward(lattice, p)
            ends = lattice.shape[1]
            beta = np.zeros_like(alpha)
            beta[:, -1] = counts[at] / np.maximum(alpha[:, -1], 1e-300)
            for end in range(ends - 1, 0, -1):
                for piece_size in range(1, min(end, LONGEST) + 1):
                    ids = lattice[:, end, piece_size - 1]
                    flow = beta[:, end] * padded[ids]
                    beta[:, end - piece_size] += flow
                    used = alpha[:, end - piece_size] * flow
                    for g in range(len(languages)):
                        seen[:, g] += np.bincount(ids + (ids < 0) * (size + 1), weights=used[:, g], minlength=size + 1)
        p = (seen[:size] + smooth) / (seen[:size].sum(0) + smooth * size)
    return Model(languages, np.log(rows / rows.sum()), pieces, p)


def train(spark: SparkSession, labelled: DataFrame, vocabulary_path: str, rows_per_language: int = 500) -> Model | None:
    """Fit on about `rows_per_language` different texts of each language, chosen by a hash of the text (the documented bound).

    Word counts are made by Spark; the driver gets the distinct words of that bounded sample.
    """
    labelled = labelled.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()
    if not counts:
        return None
    # Copies count once, or one text's copies could be the whole sample or none of it.
    sizes = labelled.groupBy("lang").agg(F.countDistinct(F.xxhash64("text")).alias("n"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                seen.update((lang, w) for w in words_of(text))
        yield pd.DataFrame([(a, w, n) for (a, w), n in seen.items()], columns=["lang", "word", "n"])

    sample = thin(labelled, F.col("text"), sizes, "lang", rows_per_language)
    sample = sample.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))
    found = sample.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    if found.empty:
        return None
    languages = [r["lang"] for r in counts]
    codes, words = pd.factorize(found["word"], sort=True)
    matrix = np.zeros((len(words), len(languages)))
    matrix[codes, found["lang"].map({v: i for i, v in enumerate(languages)}).to_numpy()] = found["n"].to_numpy()
    return fit(list(words), matrix, languages, np.array([float(r["n"]) for r in counts]), vocabulary(vocabulary_path))


class Scorer:
    """Scores texts in a worker; remembers the scores of up to MEMO words."""

    def __init__(self, model: Model):
        self.model, self.rows = model, np.zeros((0, len(model.languages)))
        self.memo: dict[str, int] = {}

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        words = [words_of(t) for t in texts]
        new = {w for ws in words for w in ws if w not in self.memo}
        if len(self.memo) + len(new) > MEMO and self.memo:
            self.memo, self.rows = {}, self.rows[:0]
            new = {w for ws in words for w in ws}
        fresh = sorted(new)
        self.memo.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh))))
        self.rows = np.vstack([self.rows, word_scores(fresh, self.model)])
        labels, scores = [], np.zeros(len(texts))
        memo = self.memo
        for i, ws in enumerate(words):
            if not ws:
                labels.append("und")
                continue
            total = self.rows[np.fromiter((memo[w] for w in ws), np.int64, len(ws))].sum(0) + self.model.prior
            best = int(total.argmax())
            labels.append(self.model.languages[best])
            scores[i] = 1.0 / np.exp(total - total[best]).sum()
        return labels, scores


def identify(docs: DataFrame, model: Model | None, label: str = "lang_pred", posterior: str = "score") -> DataFrame:
    """All columns of `docs` (any columns beside `text`) with the language and its posterior, replacing columns of the
    names they are given. Without a model, as where nothing could be learned, all languages are `und`."""
    docs = docs.drop(label, posterior)
    if model is None:
        return docs.withColumns({label: F.lit("und"), posterior: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary times languages: bounded by the fixed vocabulary

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            labels, scores = scorer.predict([t if isinstance(t, str) else None for t in batch["text"]])
            yield batch.assign(**{label: labels, posterior: scores})

    schema = T.StructType([*docs.schema.fields, T.StructField(label, T.StringType()), T.StructField(posterior, T.DoubleType())])
    return docs.mapInPandas(run, schema)


def piece_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def learned(spark: SparkSession, docs: DataFrame, vocabulary_path: str | None = None, rows_per_language: int = 500) -> Model | None:
    """A model from the documents whose crc32(doc_id as text) mod 4 is not 2."""
    return train(spark, docs.where(crc_mod("doc_id", 4) != 2), vocabulary_path or piece_vocabulary(), rows_per_language)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = learned(spark, docs)
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", held, "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, min_score: float = 0.3) -> DataFrame:
    """Keep documents whose language is recognised: not `und`, and a posterior of at least `min_score`. Where nothing
    could be learned, all stay. Columns of any name come back as they are."""
    small_batches(spark)
    model = learned(spark, table(spark, sf_dir, "documents"))
    if model is None:
        return docs
    label, posterior = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "score")
    scored = identify(docs, model, label, posterior)
    return scored.where((F.col(label) != "und") & (F.col(posterior) >= min_score)).select(*docs.columns)
