"""Text similarity: the longest-common-block ratio of two strings."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.base import col, ship

ship(__name__)


def _ratio(left: str, right: str) -> float:
    if left == right:
        return 1.0
    if not left or not right or set(left).isdisjoint(right):
        return 0.0
    return SequenceMatcher(None, left, right).ratio()


def _ratios(left: pd.Series, right: pd.Series) -> pd.Series:
    seen: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(left, right):
        if pair not in seen:
            seen[pair] = _ratio(*pair)
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")


def similarity(left: Column | str, right: Column | str) -> Column:
    """Order of arguments matters. Null gives 0, two empty strings give 1.

    Equal and empty pairs are decided in the JVM; the rest go to Python in
    Arrow batches, so call this on blocked pairs only.
    """
    a, b = col(left).cast("string"), col(right).cast("string")
    settled = (
        F.when(a.isNull() | b.isNull(), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when((a == "") | (b == ""), F.lit(0.0))
    )
    open_pair = settled.isNull()
    scored = F.pandas_udf(_ratios, T.DoubleType())(
        F.when(open_pair, a).otherwise(F.lit("")), F.when(open_pair, b).otherwise(F.lit(""))
    )
    return F.coalesce(settled, scored)
