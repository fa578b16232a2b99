"""Fill-in-the-middle: a text cut at two line ranks and written with its middle last.

The lines of a text stand in an indexable skip list. Lane 0 holds every line; a line
reaches lane j with a chance of 2^-j, by a hash of its rank. Each node of a lane knows
how many lines, and how many code points, lie between it and the next node of that
lane. To find rank r, one walks from the head along the highest lane as long as the
lines passed stay within r, then goes down a lane; the code points passed on the way
are the place to cut. About log2(n) steps of two numbers a rank, whatever the text.

Defined results: a null text is empty; an empty text, one that holds a mark, and those
beyond ``percent`` stay plain (the text itself). A null id draws as an empty one;
rows that repeat an id get the same draw, applied to their own text. An empty table
gives no rows. Extra columns are not read. Texts are taken whole; only one row's
lines are held at a time.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.chunks import blocks
from ledgerloom.llm.common import arrow_rows

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
_MIX = 0x9E3779B97F4A7C15


def tower(rank: int) -> int:
    """Highest lane of the line with this rank: trailing zero bits of a hash of it."""
    x = ((rank + 1) * _MIX) & (2**64 - 1)
    x ^= x >> 29
    x = (x * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x ^= x >> 32
    return (x & -x).bit_length() - 1


class SkipList:
    """Lines of a text by rank. ``lanes[j]`` is a list of nodes ``(units, points, below)``:
    lines and code points up to the next node of the lane, and the node's own number
    one lane below. Node 0 of every lane is the head, before the first line."""

    def __init__(self, widths: list[int]):
        self.size = len(widths)
        # On lane 0 node i + 1 is line i, and the head stands before line 0 without
        # width; so passing from node i to node i + 1 passes line i - 1 whole.
        units, points, heights = [0, *[1] * len(widths)], [0, *widths], [64, *map(tower, range(len(widths)))]
        self.lanes = [list(zip(units, points, range(len(units))))]
        level = 0
        while len(units) > 1:
            level += 1
            kept = [i for i, h in enumerate(heights) if h >= level]
            ends = [*kept[1:], len(units)]
            units, points = ([sum(w[a:b]) for a, b in zip(kept, ends)] for w in (units, points))
            heights = [heights[i] for i in kept]
            self.lanes.append(list(zip(units, points, kept)))

    def place(self, rank: int) -> int:
        """Code points before the line of this rank; ``rank`` may be the number of lines."""
        passed = place = node = 0
        for lane in reversed(self.lanes):
            while node < len(lane) and passed + lane[node][0] <= rank:
                passed, place, node = passed + lane[node][0], place + lane[node][1], node + 1
            if node == len(lane):
                return place
            node = lane[node][2]
        return place


def line_widths(text: str) -> list[int]:
    """Code points of each line, line break included."""
    widths = [len(line) + 1 for line in text.split("\n")]
    widths[-1] -= 1
    return widths if widths[-1] else widths[:-1]


def infilled(text: str, draws: tuple[int, int, int, int], percent: int, spm_percent: int):
    """Number of lines, form, code points of prefix and middle, and the output."""
    widths = line_widths(text)
    n = len(widths)
    one, two, whether, order = draws
    if not n or whether % 100 >= percent or any(mark in text for mark in MARKS):
        return n, "plain", None, None, text
    lines = SkipList(widths)
    low, high = sorted((one % (n + 1), two % (n + 1)))
    first, second = lines.place(low), lines.place(high)
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if order % 100 < spm_percent:
        return n, "spm", first, second - first, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, "psm", first, second - first, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def draws_of(key: Column, seed: int) -> list[Column]:
    """Four numbers from the hex digits of a hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"draw{i}") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7,
                   percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """Per row: id, ``n`` lines, ``form`` (plain, psm or spm), ``prefix_chars``,
    ``middle_chars`` (null if plain) and ``output``."""
    key = F.col(f"`{id_col}`")
    rows = docs.select(key.alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
                       *draws_of(key, seed))

    def run(batches):
        for batch in batches:
            for at, texts in blocks(batch.column("text"), 4_000_000):
                part = batch.slice(at, len(texts))
                drawn = zip(*(part.column(f"draw{i}").to_pylist() for i in range(4)))
                made = [infilled(t.as_py(), d, percent, spm_percent) for t, d in zip(texts, drawn)]
                n, form, prefix, middle, output = (list(c) for c in zip(*made))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                     pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                    ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n", T.LongType()),
                           T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
                           T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
    return arrow_rows(rows, run, schema).withColumnRenamed("id", id_col)


def restored(form: Column, output: Column) -> Column:
    """The text that ``output`` was made from. Marks occur in it only where they were put."""
    part = F.split(output, "<[PSM]>", -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))


def infill_digests(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    made = fill_in_middle(docs, id_col, **options)
    return made.select(
        id_col, "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")).cast("binary"), 256).alias("restored_sha256"))
