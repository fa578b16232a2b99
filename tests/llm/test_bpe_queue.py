"""The queue of merge ranks against merging by plain search."""

import random

from ledgerloom.llm import bpe


def test_queue_words_are_single_digits_and_merge_like_the_plain_way():
    draw = random.Random(5)
    ranks = {bytes([b]): b for b in range(256)}
    made = [b"a", b"b", b"c"]
    for _ in range(3000):
        whole = draw.choice(made) + draw.choice([b"a", b"b", b"c", b"ab"])
        if whole not in ranks:
            ranks[whole] = len(ranks)
            made.append(whole)
    coder = bpe.Bpe(ranks, r"\S+|\s+")
    assert bpe.WORD == 30 and all(x < 1 << 30 and y < 1 << 30 for _, x, _, y, _ in coder.spot)
    for _ in range(300):
        piece = bytes(draw.choices(b"abcd", k=draw.randint(1, 60)))
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1 and piece not in ranks:
            least = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if least[0] == 1 << 60:
                break
            parts[least[1]:least[1] + 2] = [parts[least[1]] + parts[least[1] + 1]]
        want = [ranks[piece]] if piece in ranks else [ranks[p] for p in parts]
        assert coder.encode_piece(piece) == want
        assert not any(coder.low) and not any(coder.middle)
