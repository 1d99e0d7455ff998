"""The memo of words that the encoders keep in a worker process."""

import public_tokenizers
import pytest

from tickloom.llm import tokens


@pytest.mark.parametrize("name, byte_level", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_memo_of_words_stays_in_its_bound(monkeypatch, name, byte_level):
    """Worker processes keep the memo from query to query, so it must not outgrow its bound, whatever a batch brings."""
    assert tokens.MEMO * 270 <= 96 << 20
    monkeypatch.setattr(tokens, "MEMO", 500)
    encoder = tokens.TextEncoder(public_tokenizers.path(name), byte_level)
    for k in range(4):
        texts = [" ".join(f"{'often' if i % 3 else f'Rare{k}x{i}'}," for i in range(j, j + 600)) for j in range(0, 1800, 600)] + ["the end", None, "Often, often"]
        ids, offsets = encoder.encode(texts, 7)
        want = [e.ids + [7] for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want
        assert len(encoder.memo) == len(encoder.seen) == len(encoder.lists[1]) - 1 <= 500
