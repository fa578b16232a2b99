"""What the classifiers share: labelled rows, their folds, and a calibrated curve."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# At most about this many labelled rows are fitted on, drawn by a hash of the id.
LABELLED_ROWS = 200_000


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)).cast("int")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column, id_col: str,
                  text_col: str, most: int = LABELLED_ROWS) -> DataFrame:
    """``label`` (0 or 1) and ``text`` of the labelled rows to fit on. ``usable`` is a
    condition on the id, called ``doc_id`` here. Ids labelled twice count once, as 1
    if any label is 1; rows without id or label are left out.

    The list of labels is bounded by ``most``, so it may be broadcast.
    """
    marks = (labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
             .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & usable)
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    count = marks.count()
    if count > most:
        share = int(most / count * 2**31)
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < share)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(marks), "doc_id").select("label", "text")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights (the last one is the constant) of a logistic curve, by Newton's method.
    With no rows, or one class only, the curve is flat at the smoothed share."""
    x = np.column_stack([x, np.ones(len(x))]) if len(x) else np.empty((0, x.shape[1] + 1))
    w = np.zeros(x.shape[1])
    share = (y.sum() + 1) / (len(y) + 2)
    w[-1] = np.log(share / (1 - share))
    if len(y) == 0 or y.min() == y.max():
        return w
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - penalty * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return w


def curve(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
