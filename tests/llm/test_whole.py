"""Operators against all pairs, plain recomputation, other compressors and held-out labels; the pipeline's stages."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import bag_minhash, components, html_crf, langid, line_dedup, order_minhash, packing, token_codec, toxicity
from tickloom.llm.tokens import TextEncoder

SF = "/root/testdata/sf0.001"
SF10 = "/root/testdata/sf0.01"


def classes_of(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def all_pairs(sets, similarity):
    """Pairs of sets of Jaccard similarity, by an index of their elements."""
    holders = {}
    for i, s in enumerate(sets):
        for e in s:
            holders.setdefault(e, []).append(i)
    common = {}
    for held in holders.values():
        for x in range(len(held)):
            for y in range(x):
                common[held[y], held[x]] = common.get((held[y], held[x]), 0) + 1
    return [(a, b) for (a, b), n in common.items() if n >= similarity * (len(sets[a]) + len(sets[b]) - n)]


def lines_of(text):
    return [re.sub(r"[\W_]+", " ", line.lower()).strip() for line in text.split("\n")]


def shingles(line):
    return frozenset(line[i : i + line_dedup.SHINGLE] for i in range(max(1, len(line) - line_dedup.SHINGLE + 1)))


def test_fuzzy_lines_are_those_of_all_pairs(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(120).collect() if r.text]
    places = [(r.doc_id, k, line) for r in rows for k, line in enumerate(lines_of(r.text)) if line]
    distinct = list(dict.fromkeys(line for *_, line in places))
    label = dict(zip(distinct, classes_of(len(distinct), all_pairs([shingles(x) for x in distinct], line_dedup.SIMILARITY))))
    seen, want = set(), set()
    for doc, k, line in places:
        if label[line] in seen:
            want.add((doc, k))
        seen.add(label[line])
    found = line_dedup.removed_lines(spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string"))
    assert {(r.doc_id, k) for r in found.collect() for k in r.removed} == want and want


@pytest.mark.parametrize("small", [64, 2])
def test_large_buckets_lose_no_link(spark, monkeypatch, small):
    """A group of copies with changes of their own, half of them near the threshold; with and without the prefix join."""
    monkeypatch.setattr(components, "SMALL", small)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(200), rng.choice([1, 2, 4, 6])):
            words[at] = f"x{rng.randrange(8)}"
        texts.append(" ".join(words))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bags = [frozenset(tuple(t.split()[i : i + 5]) for i in range(196)) for t in texts]
    want = classes_of(60, all_pairs(bags, bag_minhash.SIMILARITY))
    assert [r.class_id for r in bag_minhash.classes(frame).orderBy("doc_id").collect()] == want


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    a, b = "one line that is repeated in here\nsomething of its own entirely", "quite another opening sentence\nonly this text says so much"
    frame = spark.createDataFrame([(1, a), (2, a.split("\n")[0]), (2, b), (2, b)], "doc_id long, text string")
    kept = sorted(r.text for r in line_dedup.line_dedup_stage(spark, frame, SF).collect())
    assert kept == sorted([a, b, b])


def test_repeated_rows_and_shared_ids_in_near_dedup(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    frame = spark.createDataFrame([(1, a), (1, a), (1, b), (2, b), (3, a), (None, a), (None, a)], "doc_id long, text string")
    kept = bag_minhash.near_dedup_stage(spark, frame, SF).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in kept) == sorted([(0, a), (0, a), (1, a), (1, b)])


@pytest.mark.parametrize("name, byte_level", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_ids_are_those_of_the_library(name, byte_level):
    import public_tokenizers

    odd = ["", None, " a", " a  b", "a\n\nb\n\n\nc  \n", "x\r\ny\tz  ", "\x1c a b", "it's don't 's 'S A'LL", "É ÇÀ, İs ΑΣ. ΟΔΟΣ!", "q" * 200 + " tail$$$", "٣ ² ½ Ⅷ", "näive — “q”…", "日本語 Привет!!", "a_b __i__ b###", "\n", "  "]
    texts = odd + pd.read_parquet(f"{SF}/documents.parquet")["text"].tolist()
    encoder = TextEncoder(public_tokenizers.path(name), byte_level)
    want = [e.ids + [7] for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):  # the second time from the memo
        ids, offsets = encoder.encode(texts, 7)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want


def test_codec_is_smaller_than_other_compressors():
    texts = pd.read_parquet(f"{SF10}/documents.parquet").sort_values("doc_id")["text"].tolist()[:300]
    ids, _ = packing._encoder(token_codec.byte_tokenizer(), True).encode(texts, token_codec.END)
    grid = ids[: len(ids) // token_codec.BLOCK * token_codec.BLOCK].reshape(-1, token_codec.BLOCK)
    coded = token_codec.encode_blocks(grid)
    assert (token_codec.decode_blocks(coded, token_codec.BLOCK) == grid).all()
    others = sum(len(zlib.compress(row.astype("<u2").tobytes(), 9)) for row in grid)
    counts = np.bincount(ids)
    entropy = -(counts[counts > 0] / len(ids) * np.log2(counts[counts > 0] / len(ids))).sum()
    bits = 8 * sum(map(len, coded)) / grid.size
    assert bits < 8 * others / grid.size and bits < entropy


def test_order_minhash_digests(spark):
    rows = {r.doc_id: r for r in order_minhash.op2_order_minhash(spark, SF).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(texts, reverse=True)
    assert sorted(rows) == sorted(texts)
    for k, i in enumerate(ids):
        r, text, following = rows[i], texts[i], texts[ids[(k + 1) % len(ids)]]
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        own, changed, other = (order_minhash.sketch([x])[0] for x in (text, edited, following))
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (order_minhash.to_text(own), order_minhash.to_text(changed))
        assert r.near_edited == order_minhash.likeness(own[None], changed[None])[0] and r.near_next == order_minhash.likeness(own[None], other[None])[0]


def test_language_sums_all_segmentations(spark):
    model = langid.learned(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    number = lambda piece: model.pieces.get(piece, len(model.pieces) if len(piece) == 1 else None)
    for plain in ("the", "und", "nation", "ωx"):
        word = langid.MARK + plain
        want = np.zeros(len(model.languages))
        for cuts in range(1 << (len(word) - 1)):  # every way to cut the word
            pieces, last = [], 0
            for i in range(1, len(word) + 1):
                if i == len(word) or cuts >> (i - 1) & 1:
                    pieces.append(word[last:i])
                    last = i
            if all(number(p) is not None for p in pieces):
                want += np.prod([model.p[number(p)] for p in pieces], axis=0)
        assert np.allclose(np.exp(langid.word_scores([plain], model)[0]), want, rtol=1e-6)


def test_toxicity_held_out(spark):
    scored = toxicity.op4_toxicity(spark, SF10).join(spark.read.parquet(f"{SF10}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    rows = scored.where("held_out").collect()
    clean, toxic = [r for r in rows if not r.toxic], [r for r in rows if r.toxic]
    assert toxic and sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert np.mean([r.score for r in toxic]) > np.mean([r.score for r in clean]) + 0.3


def test_html_without_article_elements(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    chain = html_crf.train(pages)
    for r in pages.limit(40).collect():
        plain = re.sub(r"(?i)<(/?)(article|main)\b", r"<\1div", r.html)
        assert html_crf.main_text(plain, chain) == html_crf.main_text(r.html, chain)


def test_unclosed_tags_take_linear_time():
    import time

    began = time.process_time()
    assert [b.text for b in html_crf.blocks("<p>hi</p>" + "<div " * 200_000)][0] == "hi"
    assert [b.text for b in html_crf.blocks("<p>hi<!-- " + "<b> x" * 200_000)] == ["hi"]
    assert time.process_time() - began < 5


NAMES = ["removed", "gone", "mark_id", "mark_text", "other", "leak", "hit_doc", "lang_pred", "score", "node", "component", "bucket", "tkey"]


def test_pipeline_stages(spark):
    """Each stage keeps the columns, clashing ones too, and its decisions take effect; the last packs every id once."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    now = base.select("*", *[F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in NAMES])
    columns, before = now.columns, now.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, now, SF).collect()
        assert 0 < len(rows) <= before and list(rows[0].asDict()) == columns, name
        assert all(r[n] == f"{n} {r.doc_id}" for r in rows for n in NAMES)
        now, before = spark.createDataFrame(rows, now.schema), len(rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    texts = {r.doc_id: r.text for r in now.collect()}
    ids, offsets = packing._encoder(packing.word_tokenizer()).encode(list(texts.values()), packing.END)
    want = dict(zip(texts, np.diff(offsets).tolist()))
    found = {}
    for r in packed:
        found[r.doc_id] = found.get(r.doc_id, 0) + r.length
    assert found == want
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= packing.SEQUENCE


def test_pipeline_of_an_empty_table(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        assert now.count() == 0


def test_pipeline_of_odd_rows(spark):
    long = " ".join(f"the word{i} and" for i in range(30_000))
    now = spark.createDataFrame([(None, None), (1, None), (2, ""), (3, "the house and the tree\n\nthe river"), (3, "the house and the tree\n\nthe river"), (4, long)], "doc_id long, text string")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert {r.doc_id for r in now.collect()} == {3, 4}
