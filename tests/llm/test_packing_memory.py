"""What the tokenizer returns at once is bounded, however many new words a chunk has."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import public_tokenizers

from urbanspark.llm import packing


def test_words_reach_the_tokenizer_a_few_at_a_time():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokens, plain = packing.Tokens(path), packing.Tokens(path)
    real, calls = tokens.tokenizer, []

    class Noted:
        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return real.encode_batch_fast(texts, **options)

    tokens.tokenizer = Noted()
    letters = "abcdefghijklmnopqrst"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in "xyz"] + [f"{i}-{i}" for i in range(500)]
    texts = [" ".join(words), "", " ".join(words[::-7])]
    ids, bounds = tokens.batch(pa.array(texts))
    assert sum(calls) > 500 and max(calls) <= 64
    for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert np.array_equal(ids[a:b], [*plain.tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID])


def test_a_known_word_is_looked_up_once_a_chunk():
    tokens = packing.Tokens(public_tokenizers.path("word_bpe_49k.json"))
    texts = pa.array(["one two, three 4-4 five", None, "two five  four*** one"])
    before = [x.tolist() for x in tokens.batch(texts)]
    looks = []

    class Noted(dict):
        def __contains__(self, word):
            looks.append(word)
            return super().__contains__(word)

        def __getitem__(self, word):
            looks.append(word)
            return super().__getitem__(word)

        def get(self, word, other=None):
            looks.append(word)
            return super().get(word, other)

    tokens.known = Noted(tokens.known)
    assert [x.tolist() for x in tokens.batch(texts)] == before
    assert len(looks) == len(set(looks)) > 5
