"""Benchmark decontamination by spaced-seed hashing.

Texts are lower-cased and cut into words (runs of letters and digits). Fixed masks over SPAN neighbouring words, each of
which ignores some positions, give hashes of the windows of benchmark items and of documents; equal hashes of one mask
are hits, also where a word under an ignored position was replaced. Around a hit the item is laid on the document at the
hit's offset, and the words of up to CONTEXT positions to each side are compared: the passage counts as a leak if at
least MATCH of the compared positions agree. Items shorter than SPAN are hashed whole, all positions, and must agree.

Where no hit of an item in a document passes so, only a part of the item may stand there, or one with words put in or
left out. The longest stretch of at least LEAST positions of which MATCH agree is then looked for along the whole
diagonal (place in the document less place in the item) of each hit, and stretches that follow one another on
neighbouring diagonals are joined: `matched` and `compared` are then their sums, without differing words at the ends of
a stretch.

Everything is built from DataFrame functions. The benchmark's hashes are broadcast if they are few (counted first), and
joined by a shuffle else. The documents' windows are made and probed inside one stage; no text moves.

Hits are gathered by diagonal before any words are joined, so a text and an item that repeat one word take a row for
each diagonal, not one for each pair of equal windows.

Defined results: null and empty texts, items without words and empty tables give no rows. Repeated rows give repeated
results only once, as results are grouped by the two ids. Rows with null ids are matched like others. Of several texts
(or items) of one id the best passage of any of them is given. Of equally long passages the one compared on fewer places,
then the first one, is given. Texts are used whole, however long. Only the columns of ids and text are read; others, of
whatever names, stay in `decontaminate_stage` and have no part in `leaks`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import cut, fresh, if_small, table

SPAN = 11
# The positions that each mask compares.
MASKS = ((0, 1, 2, 4, 6, 7, 9, 10), (0, 1, 3, 4, 5, 8, 9, 10), (0, 2, 3, 5, 6, 7, 8, 10))
CONTEXT = 20
MATCH = 0.8
# A part of an item counts from this many words on; stretches of diagonals at most JOIN words apart are joined.
LEAST = 11
JOIN = 5


def word_codes(text: Column) -> Column:
    """64-bit hashes of the words of a text."""
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def coded(df: DataFrame, key: str, out: str) -> DataFrame:
    # The hash of the text tells texts of one id apart.
    return df.select(F.col(key).alias(out), F.xxhash64("text").alias(f"{out}_key"), word_codes(F.col("text")).alias(f"{out}_words"))


def _seeds(words: str, at: str, spans: list[tuple[int, tuple[int, ...]]]) -> Column:
    """The hashes of the window at `at` under all masks; null where a mask does not fit."""
    least = min(span for span, _ in spans)
    codes = [F.xxhash64(F.lit(k), F.lit(span), *[F.get(F.col(words), F.col(at) + o) for o in mask]) for k, (span, mask) in enumerate(spans)]
    return F.array(*[code if span == least else F.when(F.col(at) + span <= F.size(words), code) for code, (span, _) in zip(codes, spans)])


def leaks(docs: DataFrame, benchmark: DataFrame, match: float = MATCH) -> DataFrame:
    """(doc_id, item_id, matched, compared, position): the best passage of each item in each document that holds one."""
    docs = docs.select("doc_id", "text")
    items = cut(coded(benchmark, "item_id", "item_id").where(F.size("item_id_words") > 0))
    short = [r["n"] for r in items.where(F.size("item_id_words") < SPAN).select(F.size("item_id_words").alias("n")).distinct().orderBy("n").collect()]
    masks = [(SPAN, m) for m in MASKS]
    # Items of fewer than SPAN words: one mask for each length there is, at most SPAN - 1, for items of just that length.
    spans = masks + [(n, tuple(range(n))) for n in short]
    seeds = _item_seeds(items, spans)
    seeds = cut(seeds.withColumnRenamed("seed", "item_seed"))
    # Only ids, places and hashes leave a document here; its words are read again for the few documents with hits.
    coded_docs = coded(docs, "doc_id", "doc_id")
    least = min(span for span, _ in spans)
    starts = F.when(F.size("doc_id_words") >= least, F.sequence(F.lit(0), F.size("doc_id_words") - least))
    # The outer form keeps the optimiser from making the words twice. Up to the join all is one generated function, in
    # which rows refer to the document's words without copying them.
    places = coded_docs.select("doc_id", "doc_id_key", "doc_id_words", F.explode_outer(starts).alias("doc_at"))
    probes = places.select("doc_id", "doc_id_key", "doc_at", F.explode(_seeds("doc_id_words", "doc_at", spans)).alias("seed"))
    hits = probes.join(if_small(seeds.select("item_seed", "item_id", "item_id_key", "item_at")), F.col("seed") == F.col("item_seed"))
    hits = hits.select(F.col("doc_id").alias("hit_doc"), F.col("doc_id_key").alias("hit_key"), "item_id", F.col("item_id_key").alias("hit_item_key"), "doc_at", (F.col("doc_at") - F.col("item_at")).alias("diagonal"))
    # A diagonal holds as many places as its item has words, at most.
    hits = cut(hits.groupBy("hit_doc", "hit_key", "item_id", "hit_item_key", "diagonal").agg(F.collect_set("doc_at").alias("places")))
    wanted = if_small(cut(hits.select("hit_doc", "hit_key").distinct()))
    again = coded(docs, "doc_id", "doc_id").join(wanted, F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("doc_id_key") == F.col("hit_key")), "left_semi")
    texts = items.withColumnRenamed("item_id", "_item")
    laid = _laid(again, hits, texts).select("doc_id", "item_id", _passage(match).alias("best")).where(F.col("best").isNotNull())
    best = laid.groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    best = cut(best.select("doc_id", "item_id", F.col("best.matched").alias("matched"), (-F.col("best.fewer")).alias("compared"), (-F.col("best.earlier")).alias("position")))
    whole = best.select(F.col("doc_id").alias("_doc"), F.col("item_id").alias("_whole"))
    rest = hits.drop("places").join(if_small(whole), F.col("hit_doc").eqNullSafe(F.col("_doc")) & F.col("item_id").eqNullSafe(F.col("_whole")), "left_anti")
    return best.unionByName(_parts(_laid(again, cut(rest), texts), match))


def _laid(docs: DataFrame, hits: DataFrame, texts: DataFrame) -> DataFrame:
    """Hits with the words of their documents and items. The items are as many as the benchmark; hits hold a few numbers each."""
    own = F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("doc_id_key") == F.col("hit_key"))
    return docs.join(if_small(hits), own).join(if_small(texts), F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("item_id_key") == F.col("hit_item_key")))


def _agreement() -> Column:
    """1 where the words along the diagonal agree, 0 where not; its first place in the document is `_first()`."""
    first = _first()
    length = F.least(F.size("doc_id_words") - first, F.size("item_id_words") - (first - F.col("diagonal")))
    return F.zip_with(F.slice("doc_id_words", first + 1, length), F.slice("item_id_words", first - F.col("diagonal") + 1, length), lambda a, b: (a == b).cast("int"))


def _first() -> Column:
    return F.greatest(F.col("diagonal"), F.lit(0))


def _passage(match: float) -> Column:
    """The best passage around the places of one diagonal, by most words matched, fewest compared and first place; null for none."""

    def around(same: Column, p: Column) -> Column:
        before = F.least(p, p - F.col("diagonal"), F.lit(CONTEXT))
        compared = before + F.least(F.size("doc_id_words") - p, F.size("item_id_words") - p + F.col("diagonal"), F.lit(SPAN + CONTEXT))
        matched = F.aggregate(F.slice(same, p - before - _first() + 1, compared), F.lit(0), lambda s, x: s + x)
        return F.struct(matched.alias("matched"), (-compared).alias("fewer"), (before - p).alias("earlier"))

    def best(same: Column) -> Column:
        return F.array_max(F.filter(F.transform("places", lambda p: around(same, p)), lambda x: x["matched"] >= -match * x["fewer"]))

    return _once(_agreement(), best)


def _once(value: Column, use) -> Column:
    """use(value), with `value` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, step, first: Column) -> Column:
    """`first` and then step(the one before, x) for each x."""
    return F.aggregate(values, F.array(first), lambda made, x: F.concat(made, F.array(step(F.element_at(made, -1), x))))


def _longest(same: Column, match: float) -> Column:
    """(from, to): the longest stretch of an array of 0 and 1 whose mean is at least `match`, the first of equal ones.

    A stretch i..j qualifies if the sum of (x - match) up to j is not below that up to i. The least sum up to each i and
    the greatest from each j on only fall, so one walk over both finds the farthest pair.
    """
    unit = 1000
    sums = _running(F.transform(same, lambda x: (x * unit - round(match * unit)).cast("long")), lambda a, x: a + x, F.lit(0).cast("long"))

    def walk(s: Column) -> Column:
        low = _running(F.slice(s, F.lit(2), F.size(s)), F.least, F.get(s, F.lit(0)))
        high = F.reverse(_running(F.slice(F.reverse(s), F.lit(2), F.size(s)), F.greatest, F.element_at(s, -1)))
        zero = F.struct(*[F.lit(0).alias(c) for c in ("i", "j", "from", "to")], low.alias("low"), high.alias("high"))

        def step(w: Column, _: Column) -> Column:
            i, j = w["i"], w["j"]
            ends = (j >= F.size(w["high"])) | (i >= F.size(w["low"]))
            fits = F.coalesce(F.get(w["low"], i) <= F.get(w["high"], j), F.lit(False))
            far = fits & (j - i > w["to"] - w["from"])
            return F.struct(
                (i + F.when(ends | fits, 0).otherwise(1)).alias("i"), (j + F.when(~ends & fits, 1).otherwise(0)).alias("j"),
                F.when(far, i).otherwise(w["from"]).alias("from"), F.when(far, j).otherwise(w["to"]).alias("to"), w["low"].alias("low"), w["high"].alias("high"),
            )

        return F.aggregate(F.sequence(F.lit(1), 2 * F.size(s)), zero, step, lambda w: F.struct(w["from"].alias("from"), w["to"].alias("to")))

    return _once(sums, walk)


def _parts(laid: DataFrame, match: float) -> DataFrame:
    """The best joined stretches of each item in each document, from (doc_id, item_id, diagonal) with both texts' words."""

    def stretch(x: Column) -> Column:
        return _once(_longest(x, match), lambda w: F.struct(w["from"].alias("from"), F.slice(x, w["from"] + 1, w["to"] - w["from"]).alias("x")))

    rows = laid.where(F.size("item_id_words") >= LEAST).select("doc_id", "item_id", "diagonal", _first().alias("first"), _once(_agreement(), stretch).alias("s"))
    rows = rows.where(F.size("s.x") >= LEAST)
    head, tail = F.array_position("s.x", 1) - 1, F.array_position(F.reverse("s.x"), 1) - 1
    rows = rows.select(
        "doc_id", "item_id", (F.col("first") + F.col("s.from") + head).cast("int").alias("start"), "diagonal",
        (F.size("s.x") - head - tail).cast("int").alias("compared"), F.aggregate("s.x", F.lit(0), lambda s, x: s + x).alias("matched"),
    )
    pairs = rows.groupBy("doc_id", "item_id").agg(F.array_sort(F.collect_set(F.struct("start", "diagonal", "compared", "matched"))).alias("found"))
    names = ("matched", "compared", "position")
    zero = F.struct(*[F.lit(0).alias(c) for c in ("end", "diagonal", *names, "best_matched", "best_compared", "best_position")])

    def follow(w: Column, x: Column) -> Column:
        # The next stretch goes on where the last one ended, in the document and in the item.
        joins = (w["matched"] > 0) & (F.abs(x["diagonal"] - w["diagonal"]) <= JOIN) & (x["start"] >= w["end"]) & (x["start"] - w["end"] <= SPAN) & (x["start"] - x["diagonal"] >= w["end"] - w["diagonal"])
        run = [F.when(joins, w["matched"]).otherwise(0) + x["matched"], F.when(joins, w["compared"]).otherwise(0) + x["compared"], F.when(joins, w["position"]).otherwise(x["start"])]
        better = (run[0] > w["best_matched"]) | ((run[0] == w["best_matched"]) & (run[1] < w["best_compared"]))
        return F.struct((x["start"] + x["compared"]).alias("end"), x["diagonal"].alias("diagonal"), *[v.alias(c) for v, c in zip(run, names)], *[F.when(better, v).otherwise(w[f"best_{c}"]).alias(f"best_{c}") for v, c in zip(run, names)])

    best = pairs.select("doc_id", "item_id", F.aggregate("found", zero, follow).alias("w"))
    return best.select("doc_id", "item_id", *[F.col(f"w.best_{c}").alias(c) for c in names])


def _item_seeds(items: DataFrame, spans: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """Windows of the items under all masks; a mask shorter than SPAN serves the items of just its length."""
    out = None
    for n in sorted({span for span, _ in spans}):
        chosen = items.where(F.size("item_id_words") >= SPAN) if n == SPAN else items.where(F.size("item_id_words") == n)
        rows = chosen.withColumn("item_at", F.explode(F.sequence(F.lit(0), F.size("item_id_words") - n)))
        codes = [F.xxhash64(F.lit(k), F.lit(span), *[F.get(F.col("item_id_words"), F.col("item_at") + o) for o in mask]) for k, (span, mask) in enumerate(spans) if span == n]
        rows = rows.withColumn("seed", F.explode(F.array(*codes)))
        out = rows if out is None else out.unionByName(rows)
    return out


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("matched").cast("long").alias("matched"), F.col("compared").cast("long").alias("compared"), F.col("position").cast("long").alias("position"))


#: The same in DuckDB, with the words themselves in place of their hashes.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
masks(k, o) AS (VALUES %s),
short AS (SELECT DISTINCT len(w) AS n FROM i WHERE len(w) BETWEEN 1 AND 10),
all_masks AS (SELECT k, 11 AS span, o FROM masks UNION ALL SELECT 100 + n, n, range(0, n) FROM short),
ik AS (SELECT item_id, k, pos, list_transform(o, lambda x: w[pos + x + 1]) AS key
       FROM (SELECT item_id, w, k, o, unnest(range(0, len(w) - span + 1)) AS pos FROM i JOIN all_masks ON (len(w) >= 11 AND span = 11) OR (len(w) < 11 AND len(w) = span))),
dk AS (SELECT doc_id, k, pos, list_transform(o, lambda x: w[pos + x + 1]) AS key
       FROM (SELECT doc_id, w, k, o, unnest(range(0, len(w) - span + 1)) AS pos FROM d JOIN all_masks ON len(w) >= span)),
hits AS (SELECT DISTINCT doc_id, item_id, dk.pos AS da, ik.pos AS ia FROM dk JOIN ik USING (k, key)),
laid AS (SELECT doc_id, item_id, da, ia, d.w AS dw, i.w AS iw, least(da, ia, 20) AS before,
                least(da, ia, 20) + least(len(d.w) - da, len(i.w) - ia, 31) AS compared
         FROM hits JOIN d USING (doc_id) JOIN i USING (item_id)),
counted AS (SELECT doc_id, item_id, compared, da - before AS position,
                   list_sum(list_transform(range(0, compared), lambda x: (dw[da - before + x + 1] = iw[ia - before + x + 1])::INT)) AS matched
            FROM laid)
SELECT doc_id, item_id, b.m::BIGINT AS matched, (-b.c)::BIGINT AS compared, (-b.p)::BIGINT AS position
FROM (SELECT doc_id, item_id, max({'m': matched, 'c': -compared, 'p': -position}) AS b FROM counted WHERE matched >= 0.8 * compared GROUP BY 1, 2)
""" % ", ".join(f"({k}, {list(mask)})" for k, mask in enumerate(MASKS))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leak of any benchmark item."""
    leak = fresh(docs.columns, "leak")
    found = leaks(docs, table(spark, sf_dir, "benchmark"))
    ids = cut(found.select(F.col("doc_id").alias(leak)).distinct())
    return docs.join(if_small(ids), docs["doc_id"].eqNullSafe(ids[leak]), "left_anti")
