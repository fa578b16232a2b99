"""Toxicity of deobfuscated text: a noisy-channel decoder, then a word score.

1. A character trigram model is counted over all documents.
2. Tokens that may hide a word (any with a digit, a sign that reads as a letter or a
   doubled letter, with letters or without, and characters spaced out by any white
   space) become lattices: each character may stand for itself, for the letters it is
   used for, or for nothing, at a price, and signs and gaps may be word edges. Viterbi
   search under the trigram model finds the cheapest reading.
3. Words and word beginnings of the restored text are hashed to buckets. Their
   weights are smoothed log-odds over all labelled rows that may be used, and a
   logistic curve over a text's strongest weights gives the score. A labelled
   text's own label is taken out of the weights it is calibrated with.

The bound on fitting: at most ``labelled.LABELLED_ROWS`` labelled rows, drawn by a
hash of the id; the model has ``BUCKETS`` weights and ``SYMBOLS`` cubed trigrams,
whatever the data. Every text is scored over its whole length.

Defined results: null and empty texts have no words and get the curve's value for
that; rows with a null id are scored and never held out; repeated rows get equal
scores; without labels of both classes the score is the smoothed share of toxic
labels; an empty table gives an empty result. Only the id and text columns of
documents are read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.chunks import blocks
from ledgerloom.llm.common import arrow_rows, remembered, send_code, settled
from ledgerloom.llm.labelled import curve, fold, logistic, training_rows

SYMBOLS = 28  # word edge, a to z, any other letter
BUCKETS = 1 << 20
STRONGEST = 4
LEAST_ROWS = 3
KEPT_WORDS = 300_000

# Letters that digits and signs are commonly written for.
READINGS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t",
            "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c",
            "<": "c", "€": "e", "£": "l", "¢": "c", "¥": "y", "§": "s", "*": "aeiou"}
# Prices in nats: of a letter written as a sign; of leaving out a sign that reads as a
# letter, a sign that does not (or stands as punctuation at the token's edge), a letter,
# the same letter as before in a run of two or a longer one.
SIGN, STAR, READ_OUT, LEFT_OUT, LETTER_OUT, TWICE_OUT, RUN_OUT = 0.5, 2.0, 5.0, 0.3, 12.0, 6.0, 0.8

_SPACED = re.compile(r"(?<!\S)\S(?:\s++\S){2,}[.,;:!?]*(?!\S)")
_TWICE = re.compile(r"([a-z])\1+")
_READ = re.compile("[" + re.escape("".join(READINGS)) + "]")
_WIDE = re.compile(r"[^\x00-\x7f]")
_EDGE = ".,;:?!\"'()[]{}|-_=#%&*~`^/\\"

_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27


def trigram_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Counts over every byte of every text; letters beyond a to z are one symbol."""
    def count(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for _, texts in blocks(batch.column(0)):
                column = texts.cast(pa.large_binary()).fill_null(b"")
                raw = b" ".join(v.as_buffer().to_pybytes() for v in column)
                c = _CLASS[np.frombuffer(b"  " + raw + b" ", np.uint8)]
                # The bytes of one longer letter, and neighbouring edges, count once.
                keep = np.ones(len(c), bool)
                keep[2:] = ~((c[2:] == c[1:-1]) & ((c[2:] == 27) | (c[2:] == 0)))
                c = c[keep]
                total += np.bincount((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    rows = (arrow_rows(docs.select(F.col(f"`{text_col}`").alias("text")), count, "gram long, n long")
            .groupBy("gram").agg(F.sum("n").alias("n")).collect())  # at most SYMBOLS ** 3 rows
    counts = np.zeros(SYMBOLS**3)
    for r in rows:
        counts[r["gram"]] = r["n"]
    return counts


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """Minus log of P(c | a, b), smoothed by P(c | b) and P(c)."""
    cube = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = cube.sum((0, 1)) + 1
    two = cube.sum(0)
    p1 = one / one.sum()
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (cube + 5 * p2) / (cube.sum(2, keepdims=True) + 5)
    return -np.log(p3)


@lru_cache(1 << 16)
def _bare(letter: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))


def _plain(match) -> str:
    """Compatibility form of a letter beyond ASCII, without marks. Letter by letter it is that
    of the text, as only marks change places there."""
    return _bare(match.group())


class Restorer:
    """Reads hidden words; what it has read is remembered up to a bound."""

    def __init__(self, costs: np.ndarray):
        self.costs, self.kept, self.decoded = costs.ravel().tolist(), {}, {}

    def decode(self, token: str, spaced: bool = False) -> str:
        """The cheapest reading of a token's lattice, its words apart by blanks. A sign may
        be a word edge; if ``spaced``, so may every gap between two characters."""
        costs = self.costs
        # Marks at the edges are cheap to leave out.
        first = len(token) - len(token.lstrip(_EDGE.replace("!", "")))
        last = len(token.rstrip(_EDGE))
        # Beam of states: symbol before last * SYMBOLS + last symbol -> price, letters read.
        states = {0: (0.0, None)}
        for i, ch in enumerate(token):
            if ch.isalpha():
                code = ord(ch) - 96 if "a" <= ch <= "z" else 27
                options = [(code, ch, 0.0)]
                again = i > 0 and ch == token[i - 1]
                run = again and (token[i + 1:i + 2] == ch or token[max(i - 2, 0):i] == 2 * ch)
                skip = RUN_OUT if run else TWICE_OUT if again else LETTER_OUT
            else:
                price = STAR if ch == "*" else SIGN
                options = [(ord(x) - 96, x, price) for x in READINGS.get(ch, "")]
                skip = READ_OUT if options and first <= i < last else LEFT_OUT
                if ch == "*" and skip == READ_OUT and token[i - 1:i] == ch:
                    skip = RUN_OUT
            following: dict = {}
            found = following.get
            mark = ch != "*" and not ch.isalnum()
            for state, (cost, read) in states.items():
                best, total = found(state), cost + skip
                if best is None or total < best[0]:
                    following[state] = (total, read)
                base = state * SYMBOLS
                row = base % SYMBOLS**2  # the last symbol * SYMBOLS
                for code, letter, price in options:
                    best, total = found(row + code), cost + price + costs[base + code]
                    if best is None or total < best[0]:
                        following[row + code] = (total, (read, letter))
                if mark and row:
                    self.edge(following, state, cost + LEFT_OUT, read)
            if spaced and i + 1 < len(token):
                for state, (cost, read) in list(following.items()):
                    if state % SYMBOLS:
                        self.edge(following, state, cost, read)
            states = following
        # After an edge the word has ended, and its end is paid for; no word has no end to pay.
        end = min((cost + (costs[state * SYMBOLS] if state % SYMBOLS else 0.0), str(i), read)
                  for i, (state, (cost, read)) in enumerate(states.items()))[2]
        letters = []
        while end is not None:
            end, letter = end
            letters.append(letter)
        return "".join(reversed(letters)).strip()

    def run(self, match) -> str:
        """The cheapest number of letters of a run. In a token of letters each run's price
        depends on the letters next to it alone, so runs are read one by one."""
        costs, token, n = self.costs, match.string, len(match.group())
        code = lambda ch: 0 if not ch else ord(ch) - 96 if "a" <= ch <= "z" else 27
        u, x, v = code(token[:match.start()][-1:]), code(match.group(1)), code(token[match.end():match.end() + 1])
        cost = lambda a, b, c: costs[(a * SYMBOLS + b) * SYMBOLS + c]
        skip = RUN_OUT if n > 2 else TWICE_OUT
        prices = [cost(u, x, v) + skip * (n - 1)]
        prices += [cost(u, x, x) + cost(x, x, v) + (k - 2) * cost(x, x, x) + skip * (n - k) for k in range(2, n + 1)]
        return match.group(1) * (prices.index(min(prices)) + 1)

    def edge(self, following: dict, state: int, cost: float, read) -> None:
        """Ends a word in a state."""
        total = cost + self.costs[state * SYMBOLS]
        ended = state % SYMBOLS * SYMBOLS
        best = following.get(ended)
        if best is None or total < best[0]:
            following[ended] = (total, (read, " "))

    def word(self, token: str, spaced: bool = False) -> str:
        """The restored form of one token, perhaps empty or several words."""
        found = None if spaced else self.kept.get(token)
        if found is None:
            core = token.strip(_EDGE) if not token.isalpha() else token
            reads = _READ.search(token)
            if spaced and (core or reads):
                return self.remembered(token, True)
            elif not reads and not any(c.isalpha() for c in token):
                found = ""
            elif core.isalpha() and not reads:
                found = _TWICE.sub(self.run, core)
            else:
                return self.remembered(token)
            if len(token) <= 64:
                if len(self.kept) > KEPT_WORDS:
                    self.kept.clear()
                self.kept[token] = found
        return found

    def remembered(self, token: str, spaced: bool = False) -> str:
        """What ``decode`` gives. Readings are kept apart from plain words, which are
        more and cheaper, so that these do not drive them out."""
        found = self.decoded.get((token, spaced))
        if found is None:
            found = self.decode(token, spaced)
            if len(token) <= 64:
                if len(self.decoded) > KEPT_WORDS:
                    self.decoded.clear()
                self.decoded[token, spaced] = found
        return found

    def words(self, text: str) -> set[str]:
        """Restored words of a whole text."""
        text = text.lower()
        if not text.isascii():
            text = _WIDE.sub(_plain, text).lower()
        tokens = set(text.split())
        found = set(map(self.kept.get, tokens))
        if None in found:
            found.discard(None)
            found.update(map(self.word, [t for t in tokens if t not in self.kept]))
        for run in _SPACED.findall(text):
            found.add(self.word("".join(run.split()), True))
        return set(" ".join(found).split())


def buckets(words: set[str]) -> np.ndarray:
    """Sorted numbers of the words and of their beginnings of five letters."""
    hashes = {zlib.crc32(w.encode()) % BUCKETS for w in words}
    hashes |= {zlib.crc32(b"^" + w[:5].encode()) % BUCKETS for w in words if len(w) > 5}
    return np.array(sorted(hashes), np.int64)


class Model:
    """Counts of toxic and other labelled texts for each bucket; the curve."""

    def __init__(self, costs, toxic, other, n_toxic, n_other, weights=None):
        self.costs, self.toxic, self.other = costs, toxic, other
        self.n_toxic, self.n_other, self.weights = n_toxic, n_other, weights

    def features(self, at: np.ndarray, own: int | None = None) -> np.ndarray:
        """The strongest log-odds of the buckets and their mean; ``own`` is the label
        that the text itself has put into the counts."""
        out = np.zeros(STRONGEST + 1)
        if not len(at):
            return out
        t, o, nt, no = self.toxic[at], self.other[at], self.n_toxic, self.n_other
        if own is not None:
            t, o = np.maximum(t - own, 0), np.maximum(o - (1 - own), 0)
            nt, no = nt - own, no - (1 - own)
        odds = np.log((t + 0.2) / (nt + 0.4)) - np.log((o + 0.2 * max(no, 1) / max(nt, 1)) / (no + 0.4))
        odds = np.where(t + o >= LEAST_ROWS, odds, 0.0)
        top = np.sort(odds)[::-1][:STRONGEST]
        out[:len(top)] = np.maximum(top, 0)
        out[-1] = odds.mean()
        return out


def fit(docs: DataFrame, train: DataFrame, text_col: str) -> Model:
    costs = trigram_costs(trigram_counts(docs, text_col))

    def restore(batches):
        reader = reader_of(costs)
        for batch in batches:
            for at, texts in blocks(batch.column("text")):
                found = [buckets(reader.words(t)).astype("<i4").tobytes() for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").slice(at, len(texts)), pa.array(found, pa.binary())], ["label", "at"])

    marked = settled(arrow_rows(train, restore, "label int, at binary", MEMORY), "toxic-words")

    def count(batches):
        both = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            label = np.asarray(batch.column("label"))
            for i, raw in enumerate(batch.column("at")):
                both[label[i], np.frombuffer(raw.as_buffer(), "<i4")] += 1
        at = np.flatnonzero(both.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[1, at]), pa.array(both[0, at])],
                                         ["bucket", "toxic", "other"])

    counted = (arrow_rows(marked, count, "bucket long, toxic long, other long", MEMORY).groupBy("bucket")
               .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
               .where(F.col("toxic") + F.col("other") >= LEAST_ROWS))
    toxic, other = np.zeros(BUCKETS), np.zeros(BUCKETS)
    table = counted.toPandas()  # at most BUCKETS rows
    toxic[table["bucket"]], other[table["bucket"]] = table["toxic"], table["other"]
    shares = marked.agg(F.sum("label").alias("t"), F.count("*").alias("n")).first()
    n_toxic = int(shares["t"] or 0)
    model = Model(costs, toxic, other, n_toxic, shares["n"] - n_toxic)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            label = np.asarray(batch.column("label"))
            x = [sent.value.features(np.frombuffer(raw.as_buffer(), "<i4"), int(label[i]))
                 for i, raw in enumerate(batch.column("at"))]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.list_(pa.float64()))],
                                             ["label", "x"])

    # One short row for each of the bounded number of labelled texts.
    measured = arrow_rows(marked, measure, "label int, x array<double>", MEMORY).toPandas()
    x = np.array(measured["x"].tolist()).reshape(-1, STRONGEST + 1)
    model.weights = logistic(x, measured["label"].to_numpy(float))
    return model


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2,
             id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
             threshold: float = 0.3) -> DataFrame:
    """Per row: id, ``held_out``, ``score``, ``predicted``. Rows whose fold is ``held``
    are never fitted on."""
    train = training_rows(docs, labels, label, fold(F.col("doc_id"), parts) != held, id_col, text_col)
    scored = with_score(docs, fit(docs, train, text_col), text_col, "score").select(
        F.col(f"`{id_col}`"), F.coalesce(fold(F.col(f"`{id_col}`"), parts) == held, F.lit(False)).alias("held_out"),
        "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


MEMORY = "toxicity"


def reader_of(costs: np.ndarray) -> Restorer:
    """One reader for each worker process, so that words read once serve later tasks,
    those that fit and those that score alike."""
    key = zlib.crc32(costs.tobytes())
    known = remembered(MEMORY, dict)
    if key not in known:
        known.clear()
        known[key] = Restorer(costs)
    return known[key]


def with_score(docs: DataFrame, model: Model, text_col: str, name: str) -> DataFrame:
    """``docs`` with every column and a score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    send_code(docs.sparkSession)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        model = sent.value
        reader = reader_of(model.costs)
        x = np.array([model.features(buckets(reader.words(t))) for t in texts]).reshape(-1, STRONGEST + 1)
        return pd.Series(curve(x, model.weights))

    return docs.withColumn(name, score(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
