"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, look-alike letters of other scripts, digits and signs that stand for letters,
invisible characters) and lexicon terms are matched by an Aho-Corasick automaton at word boundaries. Matches inside an
exception phrase do not count. The sum of the matched weights is divided by a power of the text's number of words,
and a logistic curve turns it into a score.

The lexicon has a small fixed core, and terms with weights learned from labelled rows: smoothed log odds of the
number of toxic and clean texts that hold the term. A term needs several different preceding words in toxic texts,
so the vocabulary of one much-copied text does not become toxic. Exception phrases are fixed ones, and learned pairs
of neighbouring words that hold a term and stand in clean texts.

Defined results: null and empty texts have no match and get the score of a text without matches. Rows without a label
never train; repeated rows count once for each distinct text. Without labelled rows the fixed core and curve are used.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import crc_mod, cut, small_batches, table, thin

# The core lexicon and the core exception phrases.
CORE_TERMS = (
    "asshole bastard bitch clown cunt dickhead disgusting dumbass fool freak fuck fucking garbage idiot idiots imbecile jerk loser "
    "losers moron morons motherfucker nazi pathetic pig retard retarded scum shit slut stupid trash vermin whore worthless"
)
CORE_WEIGHT = 3.0
CORE_EXCEPTIONS = ("class clown", "clown fish", "circus clown", "trash can", "trash bin", "garbage can", "garbage collection", "guinea pig", "pond scum", "sore loser award")

# Letters of other scripts, digits and signs, with the Latin letter that they stand for.
LOOKALIKES = {
    "a": "аαɑ4@", "b": "вьβ8", "c": "сϲ", "d": "ԁ", "e": "еєε3", "g": "ɡ9", "h": "һн", "i": "іιıӏlł1|!", "j": "ј", "k": "кκ",
    "m": "м", "n": "ոη", "o": "оοσ0ø", "p": "рρ", "s": "ѕ5$ß", "t": "тτ7", "u": "υս", "v": "ν", "w": "ѡω", "x": "хχ", "y": "уγ",
    "z": "2",
}
INVISIBLE = "­​‌‍⁠﻿"
SIGN_IN_WORD = re.compile(r"(?<![^\W_])[@$](?=[^\W_])|(?<=[^\W_])[@$!|](?=[^\W_])")
SIGNS = re.compile("[@$!|]")
NOT_WORD = re.compile(r"[^\w]+|_+")


@functools.lru_cache(1)
def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {ord(c): None for c in INVISIBLE}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF10, 0xFF5B)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        if plain.isascii() and plain:
            out[code] = plain
    out |= {code: None for code in range(0x300, 0x370)}
    for latin, others in LOOKALIKES.items():
        out |= {ord(c): latin for c in others if c not in "@$!|"}
    return out


def fold(text: str | None) -> str:
    """The folded words of a text, joined by single spaces. Digits fold like the letters they resemble; l folds to i."""
    if not text:
        return ""
    text = text.lower()
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = SIGN_IN_WORD.sub(lambda m: {"@": "a", "$": "s"}.get(m[0], "i"), text)
    return " ".join(NOT_WORD.sub(" ", text.translate(_table())).split())


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: list[str]
    #: Logistic curve over the normalised sum, and the power of the number of words that divides it.
    slope: float = 2.0
    intercept: float = -3.0
    power: float = 0.5
    automaton: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}

    def matcher(self):
        if self.automaton is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for phrase in self.exceptions:
                made.add_word(f" {phrase} ", (len(phrase) + 2, None, phrase))
            for term, weight in self.weights.items():
                made.add_word(f" {term} ", (len(term) + 2, weight, term))
            made.make_automaton()
            self.automaton = made
        return self.automaton

    def matches(self, text: str | None) -> tuple[list[tuple[int, int, str, float]], int]:
        """Counted matches (start, end, term, weight) in the folded text, and the number of its words."""
        folded = fold(text)
        if not folded or not self.weights:
            return [], folded.count(" ") + bool(folded)
        terms, covered = [], []
        for last, (size, weight, term) in self.matcher().iter(f" {folded} "):
            at = (last - size + 1, last - 1)
            covered.append(at) if weight is None else terms.append((*at, term, weight))
        if covered and terms:
            starts = np.array([c[0] for c in covered])
            reach = np.maximum.accumulate(np.array([c[1] for c in sorted(covered)]))
            starts.sort()
            terms = [t for t in terms if (i := np.searchsorted(starts, t[0], "right")) == 0 or reach[i - 1] < t[1]]
        return terms, folded.count(" ") + 1

    def density(self, text: str | None) -> tuple[float, int]:
        """The sum of matched weights over the power of the number of words, and the number of matches."""
        found, words = self.matches(text)
        return sum(m[3] for m in found) / max(words, 1) ** self.power, len(found)

    def score(self, density: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * density, -30, 30)))


def core() -> Lexicon:
    return Lexicon({fold(t): CORE_WEIGHT for t in CORE_TERMS.split()}, [fold(p) for p in CORE_EXCEPTIONS])


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of a class-balanced logistic regression on one feature, by Newton steps."""
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    features = np.stack([x, np.ones_like(x)], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ b, -30, 30)))
        gradient = features.T @ (weight * (p - y)) + ridge * b * [1, 0]
        hessian = (features * (weight * p * (1 - p))[:, None]).T @ features + np.diag([ridge, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        b -= step
        if abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, rows_per_label: int) -> DataFrame:
    """(text, toxic) of about `rows_per_label` labelled documents of each label (documented bound), one for each text.

    Labels are thinned by a hash of their id before they meet the texts, so few ids are broadcast and no text moves
    that is not wanted.
    """
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    counts = marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))
    chosen = F.broadcast(thin(marks, F.col("doc_id"), counts, "toxic", rows_per_label))
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(chosen, "doc_id").select("text", "toxic")
    return cut(found.groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.first("text").alias("text")).select("text", "toxic"))


def train(sample: DataFrame, min_contexts: int = 4) -> Lexicon:
    """Learn from a bounded sample of (text, toxic) rows.

    Counts by word, and by word and preceding word, are made by Spark; the driver gets the telling words of the
    sample, their exception pairs, and one number for each sampled row.
    """
    lexicon, spark = core(), sample.sparkSession
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return lexicon

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[tuple[str, str], list[int]] = {}
            for text, toxic in zip(batch["text"], batch["toxic"]):
                words = fold(text).split()
                for pair in set(zip(["", *words], words)):
                    seen.setdefault(pair, [0, 0])[toxic] += 1
            yield pd.DataFrame([(a, b, *n) for (a, b), n in seen.items()], columns=["before", "word", "clean", "dirty"])

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, toxic in zip(batch["text"], batch["toxic"]):
                for word in set(fold(text).split()):
                    seen.setdefault(word, [0, 0])[toxic] += 1
            yield pd.DataFrame([(w, *n) for w, n in seen.items()], columns=["word", "clean", "dirty"])

    total = lambda label: F.log((F.col(label) + 0.5) / (n[int(label == "dirty")] + 1.0))
    odds = total("dirty") - total("clean")
    strength = odds / F.sqrt(1 / (F.col("dirty") + 0.5) + 1 / (F.col("clean") + 0.5))
    by_word = sample.mapInPandas(words, "word string, clean long, dirty long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("dirty").alias("dirty"))
    strong = by_word.where((odds > 1.0) & (strength > 4.0) & (F.length("word") > 2)).select("word", "dirty", odds.alias("weight"), strength.alias("strength"))
    top = strong.orderBy(F.desc("strength"), "word").toPandas()
    if len(top):
        candidates = spark.createDataFrame(top[["word"]], "word string")
        by_pair = sample.mapInPandas(pairs, "before string, word string, clean long, dirty long").join(F.broadcast(candidates), "word").groupBy("word", "before").agg(F.sum("clean").alias("clean"), F.sum("dirty").alias("dirty"))
        contexts = by_pair.groupBy("word").agg(F.count_if(F.col("dirty") > 0).alias("contexts"), F.collect_list(F.when((F.col("clean") >= 3) & (F.col("clean") > 4 * F.col("dirty")) & (F.col("before") != ""), F.col("before"))).alias("clean_after")).toPandas()
        contexts = contexts.set_index("word")
        for word, dirty, weight in zip(top["word"], top["dirty"], top["weight"]):
            if contexts.loc[word, "contexts"] >= max(min_contexts, dirty // 8):
                lexicon.weights[word] = max(float(weight), lexicon.weights.get(word, 0.0))
                lexicon.exceptions += [f"{before} {word}" for before in contexts.loc[word, "clean_after"]]
    shared = spark.sparkContext.broadcast(lexicon)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "x": [shared.value.density(t)[0] for t in batch["text"]]})

    x = sample.mapInPandas(measure, "toxic int, x double").toPandas()
    if x["toxic"].nunique() == 2:
        lexicon.slope, lexicon.intercept = fit_curve(x["x"].to_numpy(), x["toxic"].to_numpy(float))
    return lexicon


def score_texts(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """All columns of `docs` with `score`, `predicted`, `n_matches` and `terms`, replacing columns of these names."""
    docs = docs.drop("score", "predicted", "n_matches", "terms")
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most the learned terms, their exceptions and the core

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            found = [model.matches(t if isinstance(t, str) else None) for t in batch["text"]]
            density = np.array([sum(m[3] for m in ms) / max(words, 1) ** model.power for ms, words in found], float)
            score = model.score(density)
            yield batch.assign(score=score, predicted=(score >= 0.5).astype(np.int32), n_matches=[len(ms) for ms, _ in found], terms=[sorted({m[2] for m in ms}) for ms, _ in found])

    added = [("score", T.DoubleType()), ("predicted", T.IntegerType()), ("n_matches", T.LongType()), ("terms", T.ArrayType(T.StringType()))]
    return docs.mapInPandas(run, T.StructType([*docs.schema.fields, *(T.StructField(*a) for a in added)]))


def learned(docs: DataFrame, labels: DataFrame, rows_per_label: int = 10_000) -> Lexicon:
    """A lexicon from the labelled documents whose crc32(doc_id as text) mod 5 is not 0."""
    marks = labels.select("doc_id", "toxic").where(crc_mod("doc_id", 5) != 0)
    return train(labelled_sample(docs, marks, rows_per_label))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    lexicon = learned(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return score_texts(docs.select("doc_id", held, "text"), lexicon).select("doc_id", "held_out", "score", "predicted", "n_matches", "terms")
