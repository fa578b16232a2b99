"""Chunks that reach the tokenizer together get the ids of whole texts."""

import random

import numpy as np
import tokenizers
from ledgerloom.llm import packing
from ledgerloom.llm.common import remembered, vocabulary_file

ODD = ["", " ", "  a", "a  b", " x ", "a <|endoftext|> b", "\xa0x y  z", "a\tb c\n d", "don't 's  's a's",
       "̀ ́a b", "a \x00b", "a.b, c. d", "1 2  3\r\n 4", "x \x85 y", "\x1c a\x1f b"]


def odd_texts(number: int) -> list[str]:
    draw = random.Random(3)
    signs = [*"ab .,'é\n\t\xa0  1漢́\x85", "<|endoftext|>"]
    return ODD + ["".join(draw.choices(signs, k=draw.randint(1, 40))) for _ in range(number)]


def test_chunks_travel_together_and_keep_their_ids(monkeypatch):
    given = []

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return self.inner.encode_batch_fast(texts, **options)

    path = vocabulary_file("byte_bpe_50k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    remembered(packing.MEMORY, dict).clear()
    with open(path, encoding="utf-8") as file:
        vocabulary = file.read()
    real = tokenizers.Tokenizer
    monkeypatch.setattr(tokenizers, "Tokenizer", type("T", (), {
        "from_str": staticmethod(lambda text: Counting(real.from_str(text)))}))
    coder = packing.token_coder(vocabulary)
    monkeypatch.undo()
    text = "begin " + " ".join(f"word{chr(97 + i % 26)}{i}" for i in range(3200))
    try:
        for texts in ([text], odd_texts(2000)):
            want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
            assert coder.encode(texts) == want
            if texts == [text]:
                assert len(given) <= 3200 / packing.JOINED + 2
    finally:
        remembered(packing.MEMORY, dict).clear()
