"""What the toxicity reader spares changes no word."""

import random
import unicodedata

import numpy as np
from ledgerloom.llm import toxicity


def test_marks_go_letter_by_letter_as_from_the_whole_text():
    draw = random.Random(2)
    letters = [chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000]
    marks = [c for c in letters if unicodedata.combining(c)]
    texts = ["".join(draw.choice(draw.choice([marks, letters, "ab1 "])) for _ in range(12)).lower() for _ in range(20000)]
    want = ["".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower() for t in texts]
    assert [toxicity._WIDE.sub(toxicity._plain, t).lower() for t in texts] == want


def test_known_words_are_not_read_again(monkeypatch):
    reader = toxicity.Restorer(toxicity.trigram_costs(np.zeros(toxicity.SYMBOLS**3)))
    first = reader.words("plain words stay here")
    monkeypatch.setattr(reader, "word", lambda *a: 1 / 0)
    assert reader.words("plain words stay here") == first == {"plain", "words", "stay", "here"}
