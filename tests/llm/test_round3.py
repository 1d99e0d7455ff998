"""Byte-level BPE against the library; the Merkle manifest and vector codes against plain loops."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tickloom.llm import byte_bpe, langid, merkle, packing, vector_codes

SF = "/root/testdata/sf0.001"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def odd_texts():
    rng = random.Random(5)
    alphabet = ["a", "Z", "é", "ß", "1", "½", "٣", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "'s", "'re", "'ll", "'", "’", "!", "漢", "😀", "é", "՘", "￿", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(150)]
    runs = [c * n for c in ("x", " ", "\n", "!", "7", "'re", "՘") for n in (1, 15, 16, 17, 63, 64, 65, 200)]
    return [None, "", "a", *texts, *runs, *["".join(rng.choice(runs) for _ in range(4)) for _ in range(40)]]


@pytest.mark.parametrize(("chunk", "overlap"), [(32, 8), (64, 40), (16_384, 512)])
def test_ids_are_those_of_the_library(spark, library, chunk, overlap):
    texts = odd_texts()
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "clash")], "no long, text string, digest string")
    got = byte_bpe.decode(byte_bpe.encode(rows, PATH, PATTERN, chunk=chunk, overlap=overlap).withColumn("kept", F.col("ids")), PATH, PATTERN).collect()
    assert len(got) == len(texts) + 1
    for row in got:
        text = texts[row.no] or ""
        assert bytes(row.kept) == packed(library.encode_ordinary(text)), text
        assert bytes(row.decoded).decode() == text and row.digest == "clash"


def test_decoding_of_wrong_ids(spark):
    rows = spark.createDataFrame([(0, None), (1, bytearray(b"")), (2, bytearray(b"\1\0\0")), (3, bytearray(packed([50256]))), (4, bytearray(packed([72, 70])))], "k long, ids binary")
    got = {r.k: r.decoded for r in byte_bpe.decode(rows, PATH, PATTERN).collect()}
    assert got[0] is None and got[2] is None and got[3] is None and got[1] == b"" and got[4] == b"ig"


def test_bpe_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = byte_bpe.op13_byte_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_bpe_of_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert byte_bpe.op13_byte_bpe(spark, str(tmp_path)).count() == 0
    assert merkle.op12_merkle_manifest(spark, str(tmp_path)).count() == 0


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes, fanout):
    """The root, and for every node the siblings on its left and right at each level."""
    steps, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, place in enumerate(at):
            first = place // fanout * fanout
            steps[k].append(("".join(level[first:place]), "".join(level[place + 1 : first + fanout])))
        level = [h(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
        at = [place // fanout for place in at]
    return level[0], steps


def plain_manifest(rows, fanout):
    """(group, key, leaf) to (subroot, root, steps)."""
    groups = {}
    for row in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(row[0], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    low = {g: climb([r[2] for r in groups[g]], fanout) for g in names}
    root, high = climb([low[g][0] for g in names], fanout)
    return sorted((str(r), low[g][0], root, low[g][1][k] + high[i]) for i, g in enumerate(names) for k, r in enumerate(groups[g]))


@pytest.mark.parametrize(("fanout", "depth", "sizes"), [(2, 3, (0, 1, 37, 2)), (3, 1, (28, 5)), (4, 2, (1,)), (2, 8, (700, 1, 1, 3))])
def test_manifest_is_that_of_plain_loops(spark, fanout, depth, sizes):
    rng = random.Random(1)
    names = [None, "z", "é", "B"]
    rows = [(names[g], rng.choice([None, rng.randrange(50)]), h(str(rng.randrange(10**6)))) for g, n in enumerate(sizes) for _ in range(n)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "g string, k long, leaf string")
    got = [(str((r.g, r.k, r.leaf)), r.subroot, r.root, [tuple(s) for s in r.steps]) for r in merkle.manifest(df, "g", "k", "leaf", fanout, depth).collect()]
    assert sorted(got) == plain_manifest(rows, fanout)


def test_manifest_of_odd_documents(spark, tmp_path):
    """Nulls, empty texts, repeated rows and columns with clashing names; tampering shows but where n_chars is null."""
    rows = [(i % 30 if i % 9 else None, None if i % 7 == 0 else "", ["en", None, "de"][i % 3], None if i % 5 == 0 else "s:1", None if i % 4 == 0 else i, "x", 1) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()
    crc = lambda r: zlib.crc32(str(r.doc_id).encode()) % 7 == 0
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = sorted(h(*(part(r[k]) for k in (0, 3, 2, 4, 1))) for r in rows)
    assert sorted(r.leaf for r in got) == leaves and len({r.root for r in got}) == 1
    assert all(r.verified for r in got if r.doc_id is None or not crc(r)) and not all(r.verified for r in got)
    assert all(r.verified == (r.folded_root == r.root) for r in got)


def plain_codes(rows, parts, entries, rounds):
    """The contract in plain integers: (key, code, error) of usable rows and the final codebooks."""
    kept = [(k, v) for k, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = [(k, [[math.floor(4096 * x) for x in v[p * width : (p + 1) * width]] for p in range(parts)], v) for k, v in kept]
    books = [[x[1][p] for x in sorted(cut, key=lambda x: (x[0] is None, x[0] or 0, x[2]))[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for now in range(rounds + 1):
        held = [[min(range(len(books[p])), key=lambda e: (far(x[1][p], books[p][e]), e)) for p in range(parts)] for x in cut]  # noqa: B023
        if now < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [x[1][p] for x, h in zip(cut, held) if h[p] == e]
                    if mine:
                        books[p][e] = [sum(column) // len(mine) for column in zip(*mine)]
    return sorted((str(x[0]), "".join(f"{e:02x}" for e in h), sum(far(x[1][p], books[p][e]) for p, e in enumerate(h))) for x, h in zip(cut, held)), books


@pytest.mark.parametrize("kind", ["spread", "ties", "few"])
def test_codes_are_those_of_plain_rounds(spark, kind):
    rng = np.random.default_rng(4)
    n = {"spread": 260, "ties": 200, "few": 5}[kind]
    values = rng.integers(-1, 2, (n, 8)) / 4096 if kind == "ties" else rng.normal(0, 1, (n, 8)) + rng.integers(0, 4, (n, 1)) * 3
    rows = [(i // 2 if i % 11 else None, [float(x) for x in v]) for i, v in enumerate(values)]
    rows += [(1, None), (2, [1.0] * 7 + [None]), (3, [math.nan] + [0.0] * 7), (4, [math.inf] + [0.0] * 7), *rows[:3]]
    found, books = vector_codes.coded(spark.createDataFrame([(k, v, None) for k, v in rows], "vec_id long, e array<double>, code int"), "vec_id", "e", "code", parts=4, entries=7)
    want, plain = plain_codes(rows, 4, 7, 6)
    assert sorted((str(r.key), r.code, r.error) for r in found.collect()) == want
    assert books.tolist() == plain


def test_bounds_leave_scans_out_and_hold():
    """Fewer scans than without bounds, and every bound is one at each round."""
    rng = np.random.default_rng(2)
    x = np.floor(4096 * (rng.normal(0, 0.2, (3000, 8)) + rng.integers(0, 5, (3000, 1)))).astype(np.int64)
    history, state, scans = x[:16].reshape(16, 2, 4).transpose(1, 0, 2)[None], None, []
    for now in range(6):
        state, n = vector_codes.assigned(x, state, history)
        scans.append(n)
        book = history[now].copy()
        for p in range(2):
            mine = x[:, 4 * p : 4 * p + 4]
            d = ((mine[:, None] - book[p]) ** 2).sum(-1)
            assert (state["entry"][:, p] == d.argmin(1)).all()
            then = history[state["upper_at"][:, p], p, state["entry"][:, p]]
            assert np.allclose(state["upper"][:, p], np.sqrt(((mine - then) ** 2).sum(1)))
            for e in range(16):
                if (hit := state["entry"][:, p] == e).any():
                    book[p, e] = mine[hit].sum(0) // hit.sum()
        history = np.concatenate([history, book[None]])
    assert scans[0] == 6000 and max(scans[2:]) < 4000


def test_codes_of_odd_tables(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert vector_codes.op11_vector_codes(spark, str(tmp_path)).count() == 0
    rows = spark.createDataFrame([(1, [0.0] * 8, 1), (2, [1.0] * 8, None), (3, [2.0] * 16, 1)], "vec_id long, e array<double>, label int")
    found, books = vector_codes.coded(rows, "vec_id", "e", "label")
    assert {(r.key, r.code, r.error) for r in found.collect()} == {(1, "00" * 8, 0), (2, "01" * 8, 0)} and books.shape == (8, 2, 1)
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.coded(rows, "vec_id", "e", "label", parts=3)


def test_numbers_are_no_letters():
    assert langid.words_of("½ ² Ⅷ ٣ 5 _ !") == [] and langid.words_of("a½b Ünï² x5y") == ["a", "b", "ünï", "x", "y"]


def test_pieces_of_one_id_are_placed_alike_in_any_order(spark):
    rows = [(1, 0, 7, crc) for crc in range(60)] + [(2, 0, 2000, crc) for crc in range(5)]
    place = lambda made: sorted((r.doc_id, r.crc, r.sequence_id, r.offset) for r in packing.pack(spark.createDataFrame(made, "doc_id long, start long, length long, crc long").repartition(3)).collect())
    assert place(rows) == place(rows[::-1])
