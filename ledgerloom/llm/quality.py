"""Quality by compression: which labelled class's dictionary shortens a text more?

One zstandard dictionary is built from good and one from bad labelled texts. A text
is compressed block by block with each; the difference of the two sizes, divided by
the text's or the compressed size, says which class it resembles, and how far the
better one shrinks it says how repetitive it is. A logistic curve, fitted on labelled
rows that built no dictionary, turns them into a score.

The bound on fitting: at most ``labelled.LABELLED_ROWS`` labelled rows are used, of
which the dictionaries see about ``DICTIONARY_ROWS`` different texts of each class and
the curve about ``CURVE_ROWS``, drawn by a hash of the text. Every text is
scored over its whole length.

Defined results: a null or empty text has difference 0 and gets the curve's value
there; rows with a null id are scored and never held out; repeated rows get equal
scores; without labels of both classes the score is the smoothed share of good
labels; an empty table gives an empty result. Only the id and text columns of
documents are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import send_code
from ledgerloom.llm.labelled import curve, fold, logistic, training_rows

DICTIONARY_ROWS, CURVE_ROWS = 2000, 3000
DICTIONARY_BYTES, BLOCK = 1 << 16, 2048
LEVEL = 3


def dictionary(samples: list[bytes]) -> bytes:
    """Content for zstandard's dictionary: trained, or for few samples simply joined."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-DICTIONARY_BYTES:]


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        self.each = [zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False,
            write_dict_id=False, write_checksum=False) for d in (good, bad)]

    def features(self, text: str) -> list[float]:
        """The sizes' difference per byte of text and per compressed byte, and the
        square and value of the shrinkage under the better dictionary."""
        raw = text.encode()
        if not raw:
            return [0.0] * 4
        good, bad = (sum(len(c.compress(raw[at:at + BLOCK])) for at in range(0, len(raw), BLOCK))
                     for c in self.each)
        shrunk = float(np.log(min(good, bad) / len(raw)))
        return [100 * (bad - good) / len(raw), 10 * (bad - good) / (bad + good), shrunk, shrunk**2]


def blocks_of(texts: list[str]) -> list[bytes]:
    return [raw[at:at + BLOCK] for t in texts for raw in [t.encode()]
            for at in range(0, len(raw), BLOCK)]


def fit(train: DataFrame) -> tuple[bytes, bytes, np.ndarray]:
    """The two dictionaries and the curve, from rows of ``label`` and ``text``."""
    drawn = train.withColumn("_h", F.xxhash64("text"))
    builders, rest, totals = {}, {}, {}
    for label in (0, 1):
        one = drawn.where(F.col("label") == label)
        totals[label] = one.count()
        # A share of the hashes that holds about as many texts as are wanted; copies
        # share a hash and count once.
        share = int(min(1.0, (DICTIONARY_ROWS + CURVE_ROWS) / max(totals[label], 1)) * 2**31)
        some = one.where(F.pmod("_h", F.lit(2**31)) < share).dropDuplicates(["_h"])
        texts = [r["text"] for r in sorted(some.collect(), key=lambda r: r["_h"])]
        cut = min(DICTIONARY_ROWS, len(texts) // 2)
        builders[label], rest[label] = texts[:cut], texts[cut:]
    good, bad = dictionary(blocks_of(builders[1])), dictionary(blocks_of(builders[0]))
    made = Compressors(good, bad)
    x = np.array([made.features(t) for label in (0, 1) for t in rest[label]]).reshape(-1, 4)
    y = np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])])
    weights = logistic(x, y)
    if len(rest[0]) and len(rest[1]):
        # The classes were drawn in equal numbers; restore their shares.
        weights[-1] += np.log(totals[1] / totals[0]) - np.log(len(rest[1]) / len(rest[0]))
    return good, bad, weights


def quality(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0,
            id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
            threshold: float = 0.3) -> DataFrame:
    """Per row: id, ``held_out``, ``score``, ``predicted``. Rows whose fold is ``held``
    are never fitted on."""
    train = training_rows(docs, labels, label, fold(F.col("doc_id"), parts) != held, id_col, text_col)
    good, bad, weights = fit(train)
    cache = {}
    send_code(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        made = cache.setdefault("made", Compressors(good, bad))
        x = np.array([made.features(t) for t in texts]).reshape(-1, 4)
        return pd.Series(curve(x, weights))

    doc_id = F.col(f"`{id_col}`")
    return docs.select(
        doc_id.alias(id_col), F.coalesce(fold(doc_id, parts) == held, F.lit(False)).alias("held_out"),
        score(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
