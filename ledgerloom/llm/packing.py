"""Pack tokenised documents into as few fixed-length sequences as the search finds.

Bin completion over sizes. Lengths are whole numbers up to the capacity, so
however many documents there are, the packing problem is a table of at most
``capacity`` counts. The search works on that table: it takes the largest
remaining size, lists the undominated fillings of the room beside it, applies a
filling as often as the counts allow, and goes on; branches are cut when the
waste so far and a lower bound for the rest reach the best packing known. The
first packing known is best-fit decreasing. Pieces then look up their sequence
by their rank among the pieces of their length, so no task or driver ever holds
the pieces themselves.

Defined results: a null text counts as empty and packs as its end mark alone;
null and repeated ids are packed like any other row; an empty table gives an
empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.chunks import ChunkCoder, blocks
from ledgerloom.llm.common import arrow_rows, remembered, settled

# Search steps after the first descent. More steps may save a few sequences.
STEPS = 4000
RANK_ROWS = 10_000


# ---------------------------------------------------------------- the search

def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: for every split of sizes into large, middle
    and small ones, the large ones alone plus the middle ones' share."""
    sizes = np.arange(capacity + 1)
    total = counts * sizes
    best = -(-int(total.sum()) // capacity)
    many, mass = np.cumsum(counts), np.cumsum(total)
    k = np.arange(capacity // 2 + 1)
    large = many[-1] - many[capacity - k]
    middle = many[capacity - k] - many[capacity // 2]
    below = np.where(k > 0, mass[np.maximum(k - 1, 0)], 0)
    small = mass[capacity // 2] - below
    free = middle * capacity - (mass[capacity - k] - mass[capacity // 2])
    extra = np.maximum(0, -(-(small - free) // capacity))
    return max(best, int((large + middle + extra).max()))


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing, a whole size at a time; bins of like content move together."""
    rooms: dict[int, dict[tuple[int, ...], int]] = {}
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        while left:
            room = min((r for r in rooms if r >= size), default=None)
            if room is None:
                fill = capacity // size
                whole, rest = divmod(left, fill)
                if whole:
                    put(rooms, capacity - fill * size, (size,) * fill, whole)
                if rest:
                    put(rooms, capacity - rest * size, (size,) * rest, 1)
                break
            held = rooms[room]
            content, number = next(iter(held.items()))
            moved = min(left, number)
            put(rooms, room, content, -moved)
            put(rooms, room - size, content + (size,), moved)
            left -= moved
    return [(c, n) for held in rooms.values() for c, n in held.items()]


def put(rooms: dict, room: int, content: tuple[int, ...], number: int) -> None:
    held = rooms.setdefault(room, {})
    held[content] = held.get(content, 0) + number
    if not held[content]:
        del held[content]
    if not held:
        del rooms[room]


def fillings(counts: np.ndarray, room: int, most_waste: int, want: int) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, fullest first; none wastes over ``most_waste``
    unless nothing better exists."""
    sizes = [int(s) for s in np.flatnonzero(counts[:room + 1])[::-1]]
    if not sizes:
        return [()]
    under = np.zeros(room + 1, int)  # largest present size at most this
    present = np.flatnonzero(counts[:room + 1])
    under[present] = present
    under = np.maximum.accumulate(under)

    def grow(part: tuple[int, ...], left: int) -> tuple[int, ...]:
        while left > 0 and (s := int(under[left])):
            while s and part.count(s) >= counts[s]:
                s = int(under[s - 1]) if s > 1 else 0
            if not s:
                break
            part += (s,)
            left -= s
        return part

    found = {tuple(sorted(grow((first,), room - first), reverse=True)) for first in sizes}
    if all(sum(f) < room for f in found):
        for i, first in enumerate(sizes[:64]):
            for second in sizes[i:i + 64]:
                if first + second > room or (first == second and counts[first] < 2):
                    continue
                found.add(tuple(sorted(grow((first, second), room - first - second), reverse=True)))
            if any(sum(f) == room for f in found):
                break
    # Of two fillings, the one with the larger largest part is to be preferred.
    ranked = sorted(found, key=lambda f: (-sum(f), tuple(-s for s in f)))
    kept: list[tuple[int, ...]] = []
    for f in ranked:
        if kept and room - sum(f) > most_waste:
            break
        if not dominated(f, room, under, counts):
            kept.append(f)
            if len(kept) == want:
                break
    return kept or ranked[:1]


def dominated(part: tuple[int, ...], room: int, under: np.ndarray, counts: np.ndarray) -> bool:
    """Whether one part, or two parts together, could give way to a larger unused size
    that still fits: then the other filling is never worse."""
    slack = room - sum(part)
    options = list(part) + [a + b for i, a in enumerate(part) for b in part[i + 1:]]
    for s in options:
        better = int(under[min(room, s + slack)])
        if better > s and better not in part:
            return True
        if better == s and s not in part:
            return True
    return False


def complete(counts: np.ndarray, capacity: int, steps: int = STEPS):
    """Contents and how often each is used: ``[((size, ...), times), ...]``."""
    counts = np.asarray(counts, np.int64)
    best = best_fit(counts, capacity)
    least, fewest = lower_bound(counts, capacity), sum(n for _, n in best)
    total = int((counts * np.arange(capacity + 1)).sum())
    # Depth first; each entry: what is left, contents so far, bins used, waste so far.
    stack = [(counts.copy(), (), 0, 0)]
    while stack and fewest > least and steps > 0:
        left, path, used, waste = stack.pop()
        while fewest > least and steps > 0:
            steps -= 1
            there = np.flatnonzero(left)
            if not len(there):
                if used < fewest:
                    fewest, best = used, unrolled(path)
                break
            spare = (fewest - 1) * capacity - total - waste
            if spare < 0 or used + lower_bound(left, capacity) >= fewest:
                break
            largest = int(there[-1])
            left[largest] -= 1
            options = fillings(left, capacity - largest, spare, 3)
            left[largest] += 1
            plans = []
            for part in options:
                content = (largest,) + part
                need = {s: content.count(s) for s in set(content)}
                times = min(int(left[s]) // k for s, k in need.items())
                empty = capacity - sum(content)
                if empty:
                    times = max(1, min(times, spare // empty))
                plans.append((content, need, times, empty))
            for content, need, times, empty in plans[:0:-1]:
                if empty <= spare:
                    other = left.copy()
                    for s, k in need.items():
                        other[s] -= k * times
                    stack.append((other, (path, content, times), used + times, waste + empty * times))
            content, need, times, empty = plans[0]
            for s, k in need.items():
                left[s] -= k * times
            path, used, waste = (path, content, times), used + times, waste + empty * times
    return best


def unrolled(path) -> list[tuple[tuple[int, ...], int]]:
    out = []
    while path:
        path, content, times = path
        out.append((content, times))
    return out


# ------------------------------------------------------------ pieces and ranks

def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``piece``, ``start``, ``length``, ``ids_crc32``: documents cut to the capacity.

    ``tokenizer`` is the place of the vocabulary on the driver; its content is sent
    to the tasks. Special tokens' strings in a text are ordinary text.
    """
    with open(tokenizer, encoding="utf-8") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = rows.schema["id"].dataType

    def cut(batches):
        coder = token_coder(shipped.value)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at, texts in blocks(batch.column(1)):
                ids = batch.column(0).slice(at, len(texts))
                encoded = coder.encode([t or "" for t in texts.to_pylist()])
                which, piece, start, length, crc = [], [], [], [], []
                for i, raw in enumerate(encoded):
                    raw += end
                    n = len(raw) // 4
                    head = n - (n - 1) // capacity * capacity
                    begin, upto, k = 0, head, 0
                    while begin < n:
                        which.append(i)
                        piece.append(k)
                        start.append(begin)
                        length.append(upto - begin)
                        crc.append(zlib.crc32(raw[4 * begin:4 * upto]))
                        begin, upto, k = upto, upto + capacity, k + 1
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    return arrow_rows(rows, cut, T.StructType([
        T.StructField("id", id_type), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType())]), MEMORY)


MEMORY = "packing"
JOINED = 32  # chunks given to the tokenizer as one text
_FOLLOWS = re.compile(r" \S(?:.*\S)?", re.DOTALL).fullmatch


def token_coder(vocabulary: str) -> ChunkCoder:
    """One coder for each worker process, so that what it has learnt serves later tasks. The
    strings of special tokens give their ids; none holds a space, so no cut parts one."""
    known = remembered(MEMORY, dict)
    if hash(vocabulary) not in known:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary)

        # Bytes that each id stands for: an added token's own, or one for each character.
        sizes = np.zeros(max(tokenizer.get_vocab(True).values(), default=0) + 1, np.int64)
        for token, i in tokenizer.get_vocab(False).items():
            sizes[i] = len(token)
        for i, token in tokenizer.get_added_tokens_decoder().items():
            sizes[i] = len(token.content.encode())

        def encode_many(chunks: list[str]) -> list[bytes]:
            # Chunks with a space before and no white space at the end may follow one another,
            # as a text may be cut between them; each is found again by its bytes.
            row = [i for i, c in enumerate(chunks) if _FOLLOWS(c)]
            out: list = [None] * len(chunks)
            for at in range(0, len(row), JOINED * 500):
                part = row[at:at + JOINED * 500]
                groups = [[chunks[i] for i in part[k:k + JOINED]] for k in range(0, len(part), JOINED)]
                done = tokenizer.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)
                ids = np.concatenate([np.array(e.ids, "<u4") for e in done])
                ends = np.cumsum(sizes[ids])
                want = np.cumsum([len(c.encode()) for g in groups for c in g])
                stop = np.searchsorted(ends, want)
                if stop[-1] != len(ids) - 1 or (ends[stop] != want).any():
                    continue  # a token of this vocabulary runs over a cut: one by one, below
                raw, begin = ids.tobytes(), 0
                for i, end in zip(part, (4 * stop + 4).tolist()):
                    out[i], begin = raw[begin:end], end
            left = [i for i, raw in enumerate(out) if raw is None]
            for at in range(0, len(left), 20_000):
                part = left[at:at + 20_000]
                done = tokenizer.encode_batch_fast([chunks[i] for i in part], add_special_tokens=False)
                for i, e in zip(part, done):
                    out[i] = np.array(e.ids, "<u4").tobytes()
            return out

        known[hash(vocabulary)] = ChunkCoder(encode_many)
    return known[hash(vocabulary)]


def ranked(rows: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0 among rows of equal ``length``. Lengths are split into
    buckets by a hash of the row, so one very common length is no single group."""
    count = rows.count()
    buckets = max(1, -(-count // RANK_ROWS))
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("length", "_bucket").orderBy("id", "piece", "ids_crc32")
    return (dealt.withColumn("_at", F.row_number().over(inside))
            .join(sizes, ["length", "_bucket"])
            .withColumn("rank", F.col("_before") + F.col("_at") - 1)
            .drop("_bucket", "_at", "_before"))


def slots(contents) -> dict[str, np.ndarray]:
    """For each place in a content: the ranks of its size that it takes, the first
    sequence and the offset. As many rows as contents have places, whatever the data."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for content, times in contents:
        offset = 0
        for size in content:
            begin = taken.get(size, 0)
            taken[size] = begin + times
            rows.append((size, begin, sequence, offset))
            offset += size
        sequence += times
    rows.sort()
    size, begin, first, offset = (np.array(x, np.int64) for x in zip(*rows)) if rows else [np.empty(0, np.int64)] * 4
    return {"key": (size << 44) + begin, "begin": begin, "first": first, "offset": offset}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2,
         id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``."""
    cut = settled(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # at most `capacity` rows
        counts[row["length"]] = row["count"]
    table = slots(complete(counts, capacity, steps))

    def place(batches):
        for batch in batches:
            key = (np.asarray(batch.column("length")) << 44) + np.asarray(batch.column("rank"))
            at = np.searchsorted(table["key"], key, "right") - 1
            sequence = table["first"][at] + np.asarray(batch.column("rank")) - table["begin"][at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
                + [pa.array(sequence), pa.array(table["offset"][at])],
                [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = T.StructType([T.StructField(id_col, cut.schema["id"].dataType)]
                          + [cut.schema[c] for c in ("piece", "start", "length", "ids_crc32")]
                          + [T.StructField("sequence_id", T.LongType()),
                             T.StructField("offset", T.LongType())])
    return arrow_rows(ranked(cut).select("id", "piece", "start", "length", "ids_crc32", "rank"), place, schema, MEMORY)
