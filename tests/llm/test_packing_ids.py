"""Token ids against the library's own, whole text by whole text."""

from __future__ import annotations

import random

import numpy as np
import pytest

from groundwell.llm import packing
from groundwell.llm.queries import tokenizer_path

PARTS = [
    "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "<|", "|>", "The", "quick", "FOX", "it's", "we'LL", "don't", "\u2665", "\u2605x", "\u00c9t\u00e9", "e\u0301", "\u0301", "\u1e9e", "\u0130", "\u03a3\u03a3",
    "\u4e2d\u6587", "3.14", "1234", "!!", "...", "%$#", "a\u00a0b", "\u2003", "\x0b", "\x1f", "\ufffd", "\U0001f600", "stra\u00dfe,", "word.", "na\u00efve;", "x|", "\ufeff", "\u200d",
]


@pytest.mark.parametrize("name, kind, texts", [("word_bpe_49k.json", packing.WordIds, 20_000), ("byte_bpe_50k.json", packing.TextIds, 4_000)])
def test_ids_are_the_tokenizers(name, kind, texts):
    from tokenizers import Tokenizer

    t, r = Tokenizer.from_file(tokenizer_path(name)), random.Random(name)
    made = ["".join(r.choice(PARTS) + r.choice(("", " ", " ", "\n", "\t", "  ")) for _ in range(r.randint(0, 12))) for _ in range(texts)]
    known = packing.encoder(tokenizer_path(name))
    assert type(known) is kind
    for at in range(0, texts, 256):
        part = made[at : at + 256]
        for text, ids in zip(part, known.encode(part, 1)):
            assert np.frombuffer(ids, "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 1], text


def test_ids_do_not_depend_on_what_is_remembered(monkeypatch):
    known, r = packing.encoder(tokenizer_path("word_bpe_49k.json")), random.Random(3)
    texts = ["".join(r.choice(PARTS) + " " for _ in range(r.randint(0, 400))) for _ in range(60)] + [None, "", " \n "]
    want = [*known.encode(texts, 1)]
    for most, chars in ((0, 50), (10, 300), (10**6, 1)):
        monkeypatch.setattr(packing, "REMEMBERED", most)
        monkeypatch.setattr(packing, "AT_ONCE", chars)
        monkeypatch.setattr(packing, "CHUNK", chars)
        assert [*packing.WordIds(known.tokenizer).encode(iter(texts), 1)] == want


def test_only_the_known_kind_is_split_into_words():
    from tokenizers import Tokenizer, normalizers

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    assert packing.word_wise(t.to_str())
    t.add_special_tokens(["two words"])
    assert not packing.word_wise(t.to_str())
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    t.normalizer = normalizers.NFC()
    assert not packing.word_wise(t.to_str())
