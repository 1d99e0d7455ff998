"""The operators against brute force, round trips and held-out accuracy, on small fixtures."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import bag_minhash, decontaminate, html_crf, langid, licences, line_dedup, order_minhash, packing, token_codec, toxicity
from tickloom.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, bucket string"


def docs(spark, texts, start=0):
    rows = [(start + i if t != "null id" else None, t, "en", "s", len(t or ""), "n", "b") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(n, seed=0):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) + str(rng.randrange(50)) for _ in range(n))


ODD = [None, "", "a", "a b", "!!!", prose(400), prose(400), "x" * 5000, "é\n\nß", "null id"]


def test_components_are_those_of_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in parent}


def test_bag_minhash_estimates_weighted_jaccard():
    words = [f"w{i}" for i in range(900)]
    rng = np.random.default_rng(1)
    errors = []
    for t in range(40):
        a = list(rng.choice(words, 500))
        b = a[: 50 * (t % 9)] * 2 + list(rng.choice(words, 200))
        text, window, weight, _ = bag_minhash.bags([" ".join(a), " ".join(b)])
        sig = bag_minhash.signatures(text, window, weight, 2)
        errors.append((sig[0] == sig[1]).mean() - bag_minhash.overlaps([" ".join(a)], [" ".join(b)])[0])
    assert abs(np.mean(errors)) < 0.015 and np.abs(errors).max() < 0.16


def test_near_classes_are_those_of_all_pairs(spark):
    base = [prose(150, s) for s in range(6)]
    texts = list(base)
    rng = random.Random(5)
    for k in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += ["", None, "a b", "A, b!"]
    got = {r.doc_id: r.class_id for r in bag_minhash.classes(docs(spark, texts)).collect()}
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if bag_minhash.overlaps([texts[i] or ""], [texts[j] or ""])[0] >= 0.8 or bag_minhash.bags([texts[i]])[3][0] == bag_minhash.bags([texts[j]])[3][0]:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i in range(len(texts))}


def test_order_minhash_edges(spark):
    got = {r.doc_id: r for r in order_minhash.edited_fingerprints(docs(spark, [t for t in ODD if t != "null id"]), 3).collect()}
    assert len(got) == 9 and got[5].fingerprint == got[6].fingerprint and got[0].fingerprint == got[1].fingerprint
    assert got[5].n_chars == len(ODD[5]) and got[6].near_next == 1.0 and got[5].near_next == 0.0 and got[0].near_edited == 1.0
    forward, swapped = prose(300), " ".join(prose(300).split()[150:] + prose(300).split()[:150])
    a, b = order_minhash.sketch([forward, swapped])
    assert 0.2 < order_minhash.likeness(a, b) < 0.8  # the same k-mers in another order


def test_codec_round_trip():
    rng = np.random.default_rng(0)
    for shape, high in (((1, 1), 2), ((5, 300), 50257), ((9, 700), 4)):
        ids = rng.zipf(1.3, shape) % high
        payloads = token_codec.encode_blocks(ids)
        assert (token_codec.decode_blocks(payloads, shape[1]) == ids).all()
        assert (token_codec.decode_blocks(payloads[:1], shape[1]) == ids[:1]).all()  # blocks don't depend on one another


def test_codec_files(spark):
    from tokenizers import Tokenizer

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    tokenizer, start, want = Tokenizer.from_file(token_codec.byte_tokenizer()), 0, []
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_codec.op9_token_codec(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == want


def test_packing(spark):
    from tokenizers import Tokenizer

    frame = docs(spark, ["", None, prose(3000), prose(10), *[prose(40 * i, i) for i in range(1, 60)]])
    rows = packing.packed(frame).collect()
    tokenizer = Tokenizer.from_file(packing.word_tokenizer())
    texts = {r.doc_id: r.text or "" for r in frame.collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for d, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SEQUENCE
    assert len(by_sequence) <= -(-sum(r.length for r in rows) // packing.SEQUENCE) + 2


def test_line_dedup(spark):
    line = "the quick brown fox jumps over the lazy dog near the river bank while it rains on the hills today and tomorrow"
    frame = docs(spark, [f"one two three\n{line}\n\n", f"{line}!\nother words here", line.replace("fox", "cat"), line, None, ""])
    got = {r.doc_id: list(r.removed) for r in line_dedup.removed_lines(frame).collect()}
    assert got == {1: [0], 2: [0], 3: [0]}
    kept = {r.doc_id: r.text for r in line_dedup.line_dedup_stage(spark, frame, SF).collect()}
    assert kept[1] == "other words here" and kept[0].startswith("one two three") and kept[4] is None


def test_decontamination(spark):
    item = prose(40, 9)
    words = item.split()
    changed = words[:]
    for i in (4, 15, 26, 33):
        changed[i] = "other"
    bench = spark.createDataFrame([(1, item), (2, "exact words only"), (3, None), (4, "")], "item_id long, text string")
    frame = docs(spark, [prose(50, 1) + " " + " ".join(changed) + " " + prose(50, 2), prose(300, 3), "so the EXACT words, only here", None, ""])
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, bench).collect()}
    assert got == {(0, 1), (2, 2)}
    assert decontaminate.leaks(frame.limit(0), bench).count() == 0 and decontaminate.leaks(frame, bench.limit(0)).count() == 0


def test_decontamination_of_parts(spark):
    words = prose(59, 9).split()
    assert len(set(words)) > 50
    spans = [(0, 24), (5, 33), (10, 49), (15, 50), (0, 11), (48, 59), (20, 31), (20, 30)]
    texts = [" ".join(["pre"] * 30 + words[a:b] + ["post"] * 30) for a, b in spans]
    put = [(k, words[:k] + ["extra"] + words[k:25]) for k in range(26)] + [(k, words[:k] + words[k + 1 : 25]) for k in range(25)]
    texts += [" ".join(["pre"] * 30 + w + ["post"] * 30) for _, w in put]
    texts.append(" ".join(w if i % 2 else "other" for i, w in enumerate(words)))  # every other word alone is no leak
    bench = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:25]))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs(spark, texts), bench).collect()}
    for d, (a, b) in enumerate(spans):
        row = got.get((d, 1))
        assert (row is not None) == (b - a >= 11), (a, b)
        assert row is None or (row.matched, row.compared, row.position) == (b - a, b - a, 30)
    for d, (k, w) in enumerate(put, len(spans)):
        assert got[d, 2].matched >= max(k, 24 - k) and got[d, 2].compared <= 25, k
        if 11 <= k <= 13:  # both sides long enough: joined
            assert got[d, 2].matched == len(w) - ("extra" in w), k
    assert not any(d == len(texts) - 1 for d, _ in got)


def test_longest_stretch_is_that_of_all_stretches(spark):
    rng = random.Random(4)
    rows = [([int(rng.random() < p) for _ in range(rng.randrange(1, 40))],) for p in (0.2, 0.6, 0.8, 0.95) for _ in range(25)]
    frame = spark.createDataFrame(rows, "x array<int>")
    for r in frame.select("x", decontaminate._longest(F.col("x"), 0.8).alias("w")).collect():
        n = len(r.x)
        best = max(j - i for i in range(n + 1) for j in range(i, n + 1) if 10 * sum(r.x[i:j]) >= 8 * (j - i))
        a, b = r.w["from"], r.w["to"]
        assert b - a == best and 10 * sum(r.x[a:b]) >= 8 * (b - a)


def test_language_held_out(spark):
    rows = langid.op10_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert rows.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    odd = langid.identify(docs(spark, ODD), langid.train(spark, docs(spark, [prose(30)] * 3), langid.piece_vocabulary())).collect()
    assert [r.lang_pred for r in odd[:5]] == ["und", "und", "en", "en", "und"]
    assert langid.train(spark, docs(spark, []), langid.piece_vocabulary()) is None


def test_toxicity_folding(spark):
    lexicon = toxicity.core()
    for text in ("you 1d10t", "you ІDІОТ", "you i​diot", "What a M0R0N!", "total l0ser.", "$cum"):
        assert lexicon.matches(text)[0], text
    for text in ("guinea pig", "the pond scum grew", "pigment", "", None, "a trash can"):
        assert not lexicon.matches(text)[0], text
    scored = toxicity.score_texts(docs(spark, ODD), lexicon).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score < 0.5 for r in scored)


def test_html_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    chain = html_crf.train(pages)
    for r in pages.collect():
        inside = r.html[r.html.index("<article>") :].split("</article>")[0]
        assert html_crf.main_text(r.html, chain) == "\n".join(b.text for b in html_crf.blocks(inside))
    assert html_crf.main_text(None, chain) == "" and html_crf.main_text("<p>&amp; <b>x", None) == "& x"
    assert html_crf.main_text("<script>a<b</script><!-- <p>no</p> --><p>a &eacute;\n b<p>c", None) == "a é b\nc"


def test_html_of_unclosed_elements():
    for tag in ("svg", "math", "canvas", "audio", "video", "object", "noscript", "template"):
        assert html_crf.main_text(f"<article><p>one</p><{tag} class='x'><p>two</p><p>three</article>", None) == "one\ntwo\nthree", tag
    for tag in ("math", "audio", "video", "object"):
        assert html_crf.main_text(f"<p>one <{tag}>inner</{tag}> two</p>", None) == "one inner two", tag
    for tag in ("script", "style", "iframe", "title"):
        assert html_crf.main_text(f"<p>one</p><{tag}><p>two</p>", None) == "one", tag


def test_viterbi_is_the_best_of_all_paths():
    import itertools

    rng = np.random.default_rng(2)
    chain = html_crf.Chain({}, np.zeros((0, 2)), rng.normal(size=(2, 2)))
    scores = rng.normal(size=(7, 2))
    value = lambda y: sum(scores[t, k] for t, k in enumerate(y)) + sum(chain.move[a, b] for a, b in zip(y, y[1:]))
    assert tuple(chain.decode(scores)) == max(itertools.product((0, 1), repeat=7), key=value)


def test_licences(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.txt", "words"), (3, "a/b/COPYING", "Licensed under the Apache License, Version 2.0."), (4, "a/b/c/y.txt", "z"), (5, "q/z.txt", None), (6, "q/h.txt", "text\nLicensed under CC BY-NC 4.0."), (7, None, "")]
    got = {r.file_id: (r.licence, r.origin) for r in licences.scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "file"), 2: ("Apache-2.0", "inherited"), 3: ("Apache-2.0", "file"), 4: ("Apache-2.0", "inherited"), 5: (None, "none"), 6: ("CC-BY-NC-4.0", "header"), 7: (None, "none")}


NOTICES = [
    ("Copyright 2020 Acme Corp. Released under the MIT License.", "MIT"),
    ("Copyright (c) 2021 Jane Doe. Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("This text was written by hand and is released under the MIT License.", "MIT"),
]


@pytest.mark.parametrize("others", [20, 600])
def test_licences_beside_other_words(spark, others):
    rows = [(i, text) for i, (text, _) in enumerate(NOTICES)] + [(1000 + i, prose(30, i)) for i in range(others)]
    got = {r.id: r.licence for r in licences.scan_lines(spark.createDataFrame(rows, "id long, text string"), "id").collect()}
    assert got == {i: name for i, (_, name) in enumerate(NOTICES)}


def test_licences_without_anchors_and_over_lines(spark):
    gpl = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
    mit = """Permission is hereby granted, free of charge, to any person
obtaining a copy of this software and associated
documentation files (the "Software"), to deal"""
    cases = [("CC BY 4.0", "CC-BY-4.0"), ("words\nCC BY-NC 4.0.", "CC-BY-NC-4.0"), (gpl, "GPL-3.0"), ("code\n\n" + gpl.replace("#", " *") + "\n\ncode", "GPL-3.0"), (mit, "MIT")]
    cases += [("// SPDX-License-Identifier: MIT", "MIT"), ("x\nSPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("SPDX-License-Identifier: ISC", "ISC")]
    cases += [("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nCopyright", "GPL-3.0"), ("Apache License\nVersion 2.0, January 2004", "Apache-2.0"), ("the licence of a driver is lost", None), ("4.0", None), (None, None)]
    rows = [(i, None, text) for i, (text, _) in enumerate(cases)] + [(1000 + i, None, prose(30, i)) for i in range(200)]
    got = {r.file_id: r.licence for r in licences.scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert {i: got[i] for i in range(len(cases))} == {i: name for i, (_, name) in enumerate(cases)}
    assert not any(got[1000 + i] for i in range(200))
    # One line of the notice, among texts in which "the", "of" and the like are common.
    one = spark.createDataFrame([(-1, gpl.split("\n")[0])], "doc_id long, text string")
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(one)
    assert [r.licence for r in licences.scan_lines(frame, "doc_id").where("doc_id = -1").collect()] == ["GPL-3.0"]


@pytest.mark.parametrize("texts", [[], ODD])
def test_odd_rows_pass_through_every_stage(spark, texts):
    frame = docs(spark, texts)
    assert bag_minhash.classes(frame).count() == len(texts)
    assert line_dedup.with_removed(frame, line_dedup.removed_lines(frame), 'gone').count() == len(texts)
    assert packing.packed(frame).select("doc_id").distinct().count() == len(texts)
    assert order_minhash.edited_fingerprints(frame, 2).count() == len(texts)
