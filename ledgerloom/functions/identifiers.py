"""Identifier forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import vocab
from ledgerloom.functions.base import col, lookup, strip

_FAMILY_OF = {name: prefix for prefix, names in vocab.ID_FAMILIES.items() for name in names}
_ALIAS_OF = {name: prefix for prefix, names in vocab.LOOKUP_ALIASES.items() for name in names}
_ID_PATTERN = r"^(?i)(" + "|".join(sorted(_FAMILY_OF, key=len, reverse=True)) + r")[-_/]?(\d+)$"


def padded(prefix: str | Column, number: Column) -> Column:
    """``PREFIX_000123``; numbers wider than the pad are kept whole."""
    digits = number.cast("string")
    width = F.greatest(F.length(digits), F.lit(vocab.ID_WIDTH))
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(head, F.lit("_"), F.lpad(digits, width, F.lit("0")))


def canonical_id(value: Column | str) -> Column:
    """Canonical id, or null when no known family matches the whole text."""
    text = strip(value)
    family = lookup(_FAMILY_OF, F.upper(F.regexp_extract(text, _ID_PATTERN, 1)))
    number = F.regexp_replace(F.regexp_extract(text, _ID_PATTERN, 2), r"^0+(?=\d)", "")
    return F.when(family.isNotNull(), padded(family, number))


def canonical_id_error(value: Column | str) -> Column:
    """Why :func:`canonical_id` is null, or null when it is not."""
    raw = col(value)
    return (
        F.when(raw.isNull() | (raw == ""), F.lit("ID is empty"))
        .when(strip(raw) == "", F.lit("ID is blank"))
        .when(canonical_id(raw).isNull(),
              F.concat(F.lit("Cannot canonicalize ID '"), raw, F.lit("'")))
    )


def lookup_key(value: Column | str) -> Column:
    """Comparable key: upper case, separators dropped, prefix alias resolved, digits kept."""
    text = F.regexp_replace(F.upper(strip(value)), r"(?U)[-/_\s]", "")
    shape = r"^([A-Z]+)(\d+)(.*)$"
    head = F.regexp_extract(text, shape, 1)
    keyed = F.concat(
        F.coalesce(lookup(_ALIAS_OF, head), head),
        F.regexp_extract(text, shape, 2),
        F.regexp_extract(text, shape, 3),
    )
    return F.coalesce(F.when(text.rlike(shape), keyed).otherwise(text), F.lit(""))


def utr(value: Column | str) -> Column:
    return F.coalesce(F.upper(F.regexp_replace(col(value), r"(?U)\s+", "")), F.lit(""))


bank_reference = utr


def gateway_reference(value: Column | str) -> Column:
    return F.coalesce(strip(value), F.lit(""))


def invoice_number(value: Column | str) -> Column:
    return F.coalesce(
        F.upper(F.regexp_replace(strip(value), r"(?U)\s*/\s*", "/")), F.lit("")
    )


def dedup_key(source: Column | str, record_id: Column | str) -> Column:
    return F.concat(F.upper(col(source)), F.lit("::"), lookup_key(record_id))


def match_key(value: Column | str) -> Column:
    """Letters and digits only, upper case; null becomes empty."""
    return F.coalesce(
        F.upper(F.regexp_replace(col(value).cast("string"), r"[^A-Za-z0-9]", "")), F.lit("")
    )


def entity_code(value: Column | str) -> Column:
    name = strip(value)
    return (
        F.when(col(value).isNull() | (col(value) == ""), F.lit("UNK"))
        .otherwise(F.coalesce(
            lookup(vocab.ENTITY_CODES, F.lower(name)),
            F.substring(F.upper(name), 1, 3),
        ))
    )


def mention(value: Column | str) -> Column:
    """First record id mentioned in a question, as ``struct(id, kind)``, or null."""
    text = col(value)
    picked = None
    for pattern, kind in vocab.MENTION_PATTERNS:
        rule = "(?iU)" + pattern
        found = F.struct(F.regexp_extract(text, rule, 1).alias("id"), F.lit(kind).alias("kind"))
        hit = text.rlike(rule)
        picked = F.when(hit, found) if picked is None else picked.when(hit, found)
    return picked


def content_hash(fields: list[Column]) -> Column:
    """Hash of trimmed lower-case field values; only equality is meaningful."""
    parts = [F.lower(strip(F.coalesce(f.cast("string"), F.lit("")))) for f in fields]
    return F.sha2(F.to_json(F.array(*parts)), 256)
