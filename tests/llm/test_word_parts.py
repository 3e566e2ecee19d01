"""Words are looked up by stem and signs, with the ids of the whole text."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from loam.llm import tokenize

ODD = [
    "", "***", "it's, 'Tis 's 't' don't! 'S'T'RE' x's's, y'll've!", "<|endoftext|> x<|ENDOFTEXT|>, <|EndOfText|>.", "İ, İstanbul! İ.", "H̱, É. é, É. á́, ñ.",
    "K, ſ. ŉ! ŉ's ß! ẞ, ÿ. Ÿ,", "»,«. a», ²,½.", "12,3 4.5% 1'000's 7.", "日本語, мир!", "a b, c ", "\x1ca\x1d, \x00b.", "ﬁ, Ǆ. ǅ,", "_a_ __ a_b_", "🙂, a🙂.",
]


def test_parts_of_words_have_the_ids_of_the_text():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, known = tokenize.load_tokenizer(path), tokenize.WordIds(path)
    for texts in (ODD, [" ".join(ODD)], ODD[::-1]):
        ids, upto = tokenize.encode_texts(pa.array(texts), known)
        assert [ids[a:b].tolist() for a, b in zip(upto, upto[1:], strict=False)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_take_whole_words():
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, texts = tokenize.load_tokenizer(path), ["Word", "", "it's,"]
    ids, upto = tokenize.encode_texts(pa.array(texts), tokenize.WordIds(path))
    assert [ids[a:b].tolist() for a, b in zip(upto, upto[1:], strict=False)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("joined", [32, 3])
def test_words_of_one_stem_are_encoded_once_and_stems_together(monkeypatch, joined):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, met = tokenize.load_tokenizer(path), []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            met.extend(texts)
            return whole.encode_batch_fast(texts, **options)

    monkeypatch.setattr(tokenize, "load_tokenizer", lambda path: Counting())
    monkeypatch.setattr(tokenize, "JOINED", joined, raising=False)
    stems = [f"stem{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(100)]
    text = " ".join(w + sign for w in stems for w in (w, w.upper(), w.title()) for sign in ("", ",", "!?"))
    ids, _ = tokenize.encode_texts(pa.array([text]), tokenize.WordIds(path))
    assert np.array_equal(ids, whole.encode(text, add_special_tokens=False).ids)
    assert len(met) == -(-100 // joined) + 2
