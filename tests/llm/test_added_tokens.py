"""Texts with the strings of added tokens, against a tokenizer loaded afresh."""

import pytest

from sparkredact.llm import tokens

TEXTS = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b c", "x <|endoftext| > y", "plain words\nhere", "end <|endoftext|>", "<|endoftext|> hi <|endoftext|>  z", " <|endoftext|>é"]


def test_added_tokens():
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    fresh = Tokenizer.from_file(path)
    want = [fresh.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert 50256 in want[0]
    encoder = tokens.TextEncoder(path, cache_parts=3)
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(TEXTS)] == want
