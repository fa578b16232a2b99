"""Remove passages of ``size`` words that occur anywhere else, by difference-cover anchors.

A difference cover modulo v is a set D such that for any two places i and j there
is a k < v with both i + k and j + k in D modulo v. So two equal windows of
``size`` words, wherever they start, hold equal anchors, ``size - v + 1`` words
long, at places that both are in D. Only those places are hashed: |D| / v of all.

1. Anchors are counted by hash. Those that occur once come back to their
   documents, a few bytes each; the counting keeps one row per hash and task, so
   a passage in a third of all documents is no large group.
2. A window can repeat only if it holds an anchor that occurs more than once.
   Such windows are extended to their whole length, hashed with 128 bits and
   counted in the same way; those that stand alone come back.
3. The other windows are repeated, and their words go.

Defined results: words are runs of bytes other than space and \\x09-\\x0d; a null
text has none; rows that repeat a text, with the same id or not, repeat each
other's passages; null ids are rows like others; an empty table gives an empty
result. Only the id and text columns are read. Places of words are kept in 27
bits: texts of over 134 million words are refused.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.chunks import blocks
from ledgerloom.llm.common import arrow_rows, settled, shipped
from ledgerloom.llm.wordhash import Words

SIZE, PERIOD, COVER = 35, 21, (0, 1, 4, 14, 16)
PLACE_BITS = 27


def text_key(text) -> list:
    """96 bits of the text's MD5 as two whole numbers of 60 and 36 bits."""
    md5 = F.md5(text)
    return [F.conv(F.substring(md5, 1, 15), 16, 10).cast("long").alias("k1"),
            F.conv(F.substring(md5, 16, 9), 16, 10).cast("long").alias("k2")]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _places(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """For every word: its place in its row, and the words from it to the row's end."""
    place = np.arange(len(words.start)) - np.repeat(words.first[:-1], words.counts)
    return place, np.repeat(words.counts, words.counts) - place


def anchors(docs: DataFrame, size: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """hash, k1, and k2 with the place: a row for each anchor."""
    length = size - period + 1
    in_cover = np.isin(np.arange(period), cover)

    def run(batches):
        for batch in batches:
            for at, texts in blocks(batch.column("text")):
                words = Words(texts)
                if len(words.counts) and words.counts.max() >= 1 << PLACE_BITS:
                    raise ValueError("a text has too many words")
                place, left = _places(words)
                enough = np.repeat(words.counts, words.counts) >= size
                take = np.flatnonzero(in_cover[place % period] & (left >= length) & enough)
                k1 = np.repeat(np.asarray(batch.column("k1").slice(at, len(texts))), words.counts)[take]
                k2 = np.repeat(np.asarray(batch.column("k2").slice(at, len(texts))), words.counts)[take]
                yield pa.RecordBatch.from_arrays(
                    [_signed(words.windows(length)[take]), pa.array(k1),
                     pa.array(k2 << PLACE_BITS | place[take])], ["h", "k1", "kp"])

    return arrow_rows(docs.select("k1", "k2", "text"), run, "h long, k1 long, kp long")


def alone(rows: DataFrame, keys: list[str]) -> DataFrame:
    """k1, k2, ``alone``: for each document the places whose hash occurs only once."""
    once = (rows.groupBy(*keys).agg(F.count("*").alias("n"), F.first("k1").alias("k1"),
                                    F.first("kp").alias("kp")).where("n = 1"))
    mask = (1 << PLACE_BITS) - 1
    return once.groupBy("k1", F.shiftright("kp", PLACE_BITS).alias("k2")).agg(
        F.collect_list(F.col("kp").bitwiseAND(F.lit(mask)).cast("int")).alias("alone"))


def _kept(raw: bytes, starts: np.ndarray, size: int) -> tuple[int, int, bytes]:
    """Number of words, number removed, the rest joined, for repeated windows' starts."""
    words = raw.split()
    if len(starts):
        edge = np.zeros(len(words) + 1, int)
        np.add.at(edge, starts, 1)
        np.add.at(edge, np.minimum(starts + size, len(words)), -1)
        covered = np.cumsum(edge[:-1]) > 0
        left = [w for w, gone in zip(words, covered.tolist()) if not gone]
    else:
        left = words
    return len(words), len(words) - len(left), b" ".join(left)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    size: int = SIZE, period: int = PERIOD, cover: tuple[int, ...] = COVER,
                    with_text: bool = False) -> DataFrame:
    """Per row: id, ``n_words``, ``n_removed``, ``kept_sha256``; with ``with_text`` also
    ``kept_text``, the words left, joined by one space."""
    if {(a - b) % period for a in cover for b in cover} != set(range(period)) or period > size:
        raise ValueError("cover is no difference cover of a period within the size")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.select("id", "text", *text_key(F.col("text")))
    id_field = T.StructField("id", rows.schema["id"].dataType)
    length, in_cover = size - period + 1, np.isin(np.arange(period), cover)

    def profile(batches):
        for batch in batches:
            split = [t.as_buffer().to_pybytes().split() for t in batch.column("text")]
            counts = np.array([len(w) for w in split], np.int64)
            ends = np.maximum(counts - length + 1, 0) * (counts >= size)
            anchored = ends // period * len(cover) + np.concatenate(([0], np.cumsum(in_cover)))[ends % period]
            columns = [batch.column(c) for c in ("id", "k1", "k2")] + [pa.array(counts), pa.array(anchored)]
            columns.append(pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in split], pa.string()))
            if with_text:
                columns.append(pa.array([b" ".join(w).decode() for w in split], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, profiled.names)

    text_field = [T.StructField("kept_text", T.StringType())] if with_text else []
    profiled = T.StructType([id_field] + [T.StructField(n, t) for n, t in (
        ("k1", T.LongType()), ("k2", T.LongType()), ("n_words", T.LongType()), ("n_anchors", T.LongType()),
        ("kept_sha256", T.StringType()))] + text_field)
    lonely = settled(alone(anchors(rows, size, period, cover), ["h"]), "anchors-alone")
    state = settled(
        arrow_rows(rows.select("id", "k1", "k2", "text"), profile, profiled)
        .join(lonely.select("k1", "k2", F.size("alone").alias("n_alone")), ["k1", "k2"], "left")
        .withColumn("suspect", F.col("n_anchors") > F.coalesce("n_alone", F.lit(0))), "profiles")
    # Only texts that share an anchor are shuffled, while the list of them is short.
    suspects = settled(state.where("suspect").select("k1", "k2").distinct(), "suspects")

    possible = T.StructType([id_field, T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()),
                             T.StructField("text", T.StringType()), T.StructField("starts", T.BinaryType())])

    def judge(batches):
        for batch in batches:
            out = []
            for text, single in zip(batch.column("text"), batch.column("alone")):
                n = len(text.as_buffer().to_pybytes().split())
                shared = np.zeros(n + 1, np.int64)
                shared[1:] = in_cover[np.arange(n) % period] & (np.arange(n) + length <= n)
                if single.values is not None:
                    shared[np.asarray(single.values) + 1] = 0
                before = np.cumsum(shared)
                at = np.arange(max(0, n - size + 1))
                out.append(at[before[at + period] > before[at]].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("id", "k1", "k2", "text")] + [pa.array(out, pa.binary())],
                possible.names)

    undecided = settled(arrow_rows(
        rows.join(shipped(suspects), ["k1", "k2"]).join(lonely, ["k1", "k2"], "left")
        .select("id", "k1", "k2", "text", "alone"), judge, possible), "windows")

    def extend(batches):
        for batch in batches:
            for at, texts in blocks(batch.column("text")):
                words = Words(texts)
                part = batch.slice(at, len(texts))
                starts = [np.frombuffer(s.as_buffer(), "<i4").astype(np.int64) for s in part.column("starts")]
                sizes = [len(s) for s in starts]
                place = np.concatenate(starts)
                take = place + np.repeat(words.first[:-1], sizes)
                k1, k2 = (np.repeat(np.asarray(part.column(c)), sizes) for c in ("k1", "k2"))
                yield pa.RecordBatch.from_arrays(
                    [_signed(words.windows(size, 1)[take]), _signed(words.windows(size, 2)[take]),
                     pa.array(k1), pa.array(k2 << PLACE_BITS | place)], ["h", "h2", "k1", "kp"])

    windows = arrow_rows(
        undecided.select("k1", "k2", "text", "starts"), extend, "h long, h2 long, k1 long, kp long")
    lonely_windows = settled(alone(windows, ["h", "h2"]), "windows-alone")

    fields = [id_field, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
              T.StructField("kept_sha256", T.StringType())]
    fields += text_field

    def remove(batches):
        for batch in batches:
            found = []
            for text, starts, single in zip(*(batch.column(c) for c in ("text", "starts", "alone"))):
                at = np.frombuffer(starts.as_buffer(), "<i4").astype(np.int64)
                if single.values is not None:
                    at = np.setdiff1d(at, np.asarray(single.values))
                found.append(_kept(text.as_buffer().to_pybytes(), at, size))
            words, gone, left = zip(*found) if found else ((), (), ())
            columns = [batch.column("id"), pa.array(words, pa.int64()), pa.array(gone, pa.int64()),
                       pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())]
            if with_text:
                columns.append(pa.array([x.decode() for x in left], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    late = arrow_rows(undecided.join(lonely_windows, ["k1", "k2"], "left")
                      .select("id", "text", "starts", "alone"), remove, T.StructType(fields))
    early = state.where("not suspect").withColumn("n_removed", F.lit(0).cast("long")).select(
        *[f.name for f in fields])
    return early.unionByName(late).withColumnRenamed("id", id_col)
