"""What a worker holds while it looks up ids."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from loam.llm import tokenize


def test_new_words_are_encoded_a_few_at_a_time(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, sizes = tokenize.load_tokenizer(path), []

    class Counting:
        def encode_batch_fast(self, words, **options):
            sizes.append(len(words))
            return whole.encode_batch_fast(words, **options)

    words = [f"w{k}x{k * 7919}" for k in range(20_000)]
    monkeypatch.setattr(tokenize, "load_tokenizer", lambda path: Counting())
    ids, upto = tokenize.encode_texts(pa.array([" ".join(words[:9_000]), None, " ".join(words[5_000:])]).fill_null(""), tokenize.WordIds(path), 0)
    assert sum(sizes) == 20_000 and max(sizes) <= 5_000
    expected = [whole.encode(t, add_special_tokens=False).ids + [0] for t in (" ".join(words[:9_000]), "", " ".join(words[5_000:]))]
    assert np.array_equal(ids, np.concatenate(expected)) and upto.tolist() == np.cumsum([0, *map(len, expected)]).tolist()
