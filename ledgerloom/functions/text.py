"""Text cleaning."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.base import blank, col, ship, squeeze, strip

ship(__name__)


def _compose(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def compose(value: Column | str) -> Column:
    """Unicode compatibility form. ASCII text never leaves the JVM: it is passed as null."""
    text = col(value)
    exotic = text.rlike(r"[^\x00-\x7F]")
    composed = F.pandas_udf(_compose, T.StringType())(F.when(exotic, text))
    return F.when(exotic, composed).otherwise(text)


def clean_text(value: Column | str, compatibility: bool = True) -> Column:
    text = compose(value) if compatibility else col(value)
    text = F.lower(text)
    text = F.regexp_replace(text, r"[-/\\|_]", " ")
    text = F.regexp_replace(text, "[₹$€£¥,;:\"'`]", "")
    return F.coalesce(squeeze(text), F.lit(""))


def clean_narration(value: Column | str, compatibility: bool = True) -> Column:
    """Drop leading transfer words, each at most once and only in this order."""
    text = clean_text(value, compatibility)
    for word in ("neft", "rtgs", "imps", "upi", "cr", "dr", "trf"):
        text = F.regexp_replace(text, rf"^{word}\s+", "")
    return squeeze(text)


def clean_name(value: Column | str, compatibility: bool = True) -> Column:
    text = clean_text(value, compatibility)
    for suffix in ("pvt", "ltd", "llp"):
        text = F.regexp_replace(text, rf"\b{suffix}\b\.?", suffix)
    return strip(text)


def clean_gstin(value: Column | str) -> Column:
    return F.coalesce(F.upper(F.regexp_replace(col(value), r"(?U)[\s\-]", "")), F.lit(""))


def is_empty(value: Column | str) -> Column:
    return blank(value)


def standard_header(name: str) -> str:
    """Snake-case one header on the driver; headers are schema, not data."""
    return re.sub(r"[^a-z0-9_]+", "_", name.strip().lower()).strip("_")


def word_set(value: Column | str) -> Column:
    """Distinct upper-case alphanumeric words."""
    return F.array_distinct(
        F.regexp_extract_all(F.upper(col(value).cast("string")), F.lit(r"([A-Za-z0-9]+)"), 1)
    )


def token_overlap(left: Column | str, right: Column | str) -> Column:
    """Shared words over all words; 0 when either side has none."""
    a, b = word_set(left), word_set(right)
    shared = F.size(F.array_intersect(a, b)).cast("double")
    total = F.size(F.array_union(a, b))
    usable = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(F.coalesce(usable, F.lit(False)), shared / total).otherwise(F.lit(0.0))


def mask_settlement_ids(value: Column | str) -> Column:
    return F.regexp_replace(col(value), r"(?i)STL_\d+", "SETTLEMENT")
