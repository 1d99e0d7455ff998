"""What keeps the token codec within its time: few steps a block, few distinct words a batch."""

import numpy as np
import public_tokenizers
import pytest

from tickloom.llm import token_codec
from tickloom.llm.tokens import TextEncoder


def test_streams_of_a_block_step_together(monkeypatch):
    """A step of numpy costs the same for one lane as for hundreds, so a block must not take a step an id."""
    steps, predict = [], token_codec._Model.predict
    monkeypatch.setattr(token_codec._Model, "predict", lambda self: (steps.append(1), predict(self)))
    rng = np.random.default_rng(0)
    ids = np.concatenate([rng.zipf(1.2, (3, token_codec.BLOCK)) % 50257, rng.integers(0, 1 << 17, (2, token_codec.BLOCK)), np.zeros((1, token_codec.BLOCK), np.int64)])
    coded = token_codec.encode_blocks(ids)
    assert len(steps) <= token_codec.BLOCK // 8
    assert (token_codec.decode_blocks(coded, token_codec.BLOCK) == ids).all() and len(steps) <= token_codec.BLOCK // 4
    for shape in ((4, 1), (2, 127), (2, 1000), (1, 70_000)):  # streams of unequal length, and more ids than order 0 counts
        ids = rng.integers(0, 1 << 17, shape)
        assert (token_codec.decode_blocks(token_codec.encode_blocks(ids), shape[1]) == ids).all()


def test_damaged_block_ends(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"text {i} " * 400) for i in range(20)], "doc_id long, text string")
    token_codec.write_tokens(frame, f"{tmp_path}/good", token_codec.byte_tokenizer(), 1)
    rows = spark.read.parquet(f"{tmp_path}/good").toPandas()
    rows["payload"] = [bytes(p[:40]) + bytes(b ^ 0x5A for b in p[40:]) for p in rows["payload"]]
    spark.createDataFrame(rows, token_codec.FILE_SCHEMA).write.parquet(f"{tmp_path}/bad")
    with pytest.raises(Exception, match="is damaged"):
        token_codec.read_tokens(spark, f"{tmp_path}/bad").collect()


def test_signs_are_words_of_their_own():
    encoder = TextEncoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    texts = [" alpha, alpha. alpha! \u00e9t\u00e9, \u00e9t\u00e9. a\u00d7b. it's, x.y, alpha's. (alpha) alpha.\n, alpha,", None, "alpha,", " alpha,  alpha,", "\u2028alpha, \u0130. \u0142,"]
    want = [e.ids + [7] for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for _ in range(2):
        ids, offsets = encoder.encode(texts, 7)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want
    memo = list(encoder.memo) if isinstance(encoder.memo, dict) else encoder.memo.to_pylist()
    assert " alpha" in memo and " alpha," not in memo and " \u00e9t\u00e9." not in memo and " x.y," in memo
