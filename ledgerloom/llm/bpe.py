"""Byte-level BPE with a hierarchical-bitmap queue of merge ranks.

The pieces of a pre-token form a linked list. Each adjacent pair that has a rank
is an entry in that rank's bucket; a bitmap of three levels of words (of 30 bits, one
digit of a Python number; the top is one word) says which buckets hold entries, so the lowest rank is found by three find-first-set
steps however long the pre-token is. A merge adds at most two entries and
removes none: entries whose pair has changed are skipped when they come up.
Work grows with n log n for a pre-token of n bytes.

Defined results: a null text counts as empty and gives no ids; null and repeated
ids are rows like others; an empty table gives an empty result. Only the id and
text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.chunks import ChunkCoder, blocks
from ledgerloom.llm.common import arrow_rows, remembered


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


WORD = 30


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.find = regex.compile(pattern).findall
        # Every pair of ids whose bytes together have a rank, as left * size + right.
        self.pairs = {}
        for whole, rank in ranks.items():
            for at in range(1, len(whole)):
                left, right = ranks.get(whole[:at]), ranks.get(whole[at:])
                if left is not None and right is not None:
                    self.pairs[left * self.size + right] = rank
        # The rank of each pair of bytes, as left * 256 + right; -1 for none.
        self.first = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        # The bitmap: bit r of `low` says that rank r has entries, a bit of `middle`
        # that a word of `low` is not zero, a bit of the top that a word of `middle`
        # is not. All zero between pre-tokens.
        self.low = [0] * (self.size // WORD + 1)
        self.middle = [0] * (self.size // WORD**2 + 1)
        # Of each rank, its word and bit in `low`, in `middle`, and its bit in the top.
        bit = [1 << i for i in range(max(WORD, len(self.middle)))]
        self.spot = [(r // WORD, bit[r % WORD], r // WORD**2, bit[r // WORD % WORD], bit[r // WORD**2])
                     for r in range(self.size)]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        low, middle, size, pair, first = self.low, self.middle, self.size, self.pairs.get, self.first
        spot, top, buckets = self.spot, 0, {}
        ids = list(map(self.single.__getitem__, piece))
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # The rank of the pair that begins at each place, -1 for none.
        now = [first[a << 8 | b] for a, b in zip(piece, piece[1:])]
        now.append(-1)
        for i, rank in enumerate(now):
            if rank in buckets:
                buckets[rank].append(i)  # from the left, so a heap as it is
            elif rank >= 0:
                buckets[rank] = [i]
                b, x, a, y, z = spot[rank]
                low[b] |= x
                middle[a] |= y
                top |= z
        # Find first set, level by level; the leftmost entry of that rank is next.
        while top:
            a = (top & -top).bit_length() - 1
            bits = middle[a]
            b = a * WORD + (bits & -bits).bit_length() - 1
            bits = low[b]
            rank = b * WORD + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                low[b] = bits = bits & (bits - 1)
                if not bits:
                    middle[a] = bits = middle[a] & (middle[a] - 1)
                    if not bits:
                        top &= top - 1
            # Stale if one of the two has been merged since.
            if now[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], now[j] = rank, -1, -1
            if k < n:
                before[k] = i
                fresh = [(i, pair(rank * size + ids[k], -1))]
            else:
                fresh = [(i, -1)]
            h = before[i]
            if h >= 0:
                fresh.append((h, pair(ids[h] * size + rank, -1)))
            for i, rank in fresh:
                now[i] = rank
                if rank in buckets:
                    heappush(buckets[rank], i)
                elif rank >= 0:
                    buckets[rank] = [i]
                    b, x, a, y, z = spot[rank]
                    low[b] |= x
                    middle[a] |= y
                    top |= z
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.find(text) for i in self.encode_piece(piece.encode())]

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


MEMORY = "bpe"


def coder_of(content: bytes, pattern: str) -> tuple[Bpe, ChunkCoder]:
    key = hash((content, pattern))
    known = remembered(MEMORY, dict)
    if key not in known:
        bpe = Bpe(read_ranks(content), pattern)
        words: dict[str, bytes] = {}  # pre-tokens recur in many chunks

        def ids_of(piece: str) -> bytes:
            raw = words.get(piece)
            if raw is None:
                ids = bpe.encode_piece(piece.encode())
                raw = pack(f"<{len(ids)}I", *ids)
                if len(piece) <= 32:
                    if len(words) > 600_000:
                        words.clear()
                    words[piece] = raw
            return raw

        find = bpe.find
        many = lambda chunks: [b"".join([ids_of(p) for p in find(c)]) for c in chunks]
        known[key] = bpe, ChunkCoder(many, 600_000)
    return known[key]


def bpe_round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
                   text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``; with ``with_ids``
    also ``ids`` (array of int) and ``decoded`` (binary).

    ``vocabulary`` is the place of a rank file on the driver; its content is sent to
    the tasks.
    """
    with open(vocabulary, "rb") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    fields = [T.StructField(id_col, rows.schema["id"].dataType), T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]

    def run(batches):
        bpe, coder = coder_of(shipped.value, pattern)
        table = [bpe.bytes_of.get(i, b"") for i in range(bpe.size)]
        for batch in batches:
            for at, texts in blocks(batch.column(1)):
                encoded = coder.encode([t or "" for t in texts.to_pylist()])
                ids = [np.frombuffer(raw, "<u4") for raw in encoded]
                decoded = [b"".join(map(table.__getitem__, x.tolist())) for x in ids]
                columns = [batch.column(0).slice(at, len(texts)),
                           pa.array([len(x) for x in ids], pa.int64()),
                           pa.array([hashlib.sha256(raw).hexdigest() for raw in encoded], pa.string()),
                           pa.array([hashlib.sha256(b).hexdigest() for b in decoded], pa.string())]
                if with_ids:
                    columns += [pa.array([x.astype("i4") for x in ids], pa.list_(pa.int32())),
                                pa.array(decoded, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return arrow_rows(rows, run, T.StructType(fields), MEMORY)
