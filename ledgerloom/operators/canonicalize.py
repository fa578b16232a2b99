"""Batch canonicalisation of ids with foreign-key checks in dependency order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import vocab
from ledgerloom.functions.base import blank
from ledgerloom.functions.identifiers import canonical_id
from ledgerloom.operators.dedup import first_per_key, prefer_authoritative
from ledgerloom.operators.normalize import lineage
from ledgerloom.operators.validate import parents_present

ERROR_TYPE = "FK_ORPHAN_OR_UNRESOLVABLE_ID"


@dataclass
class Split:
    good: DataFrame
    quarantine: DataFrame


def _read(name: str) -> Column:
    """Working column with the canonical form of an id, so it is read once per row."""
    return F.col(f"_read_{name}")


def _reason(primary: str, foreign: list[str]) -> tuple[Column, Column]:
    """First thing wrong with the ids of a row, and the field it concerns."""
    missing = blank(primary)
    reason = F.when(missing, F.lit(f"Missing PK field '{primary}'")).when(
        _read(primary).isNull(), F.concat(F.lit("Cannot canonicalize PK: "), F.col(primary)))
    field = F.when(_read(primary).isNull(), F.lit(primary))
    for name in foreign:
        bad = ~blank(name) & _read(name).isNull()
        reason = reason.when(bad, F.concat(F.lit(f"Cannot canonicalize FK '{name}': "),
                                           F.col(name)))
        field = field.when(bad, F.lit(name))
    return reason, field


def _quarantined(df: DataFrame, entity: str, reason: Column, field: Column,
                 raw: str = "_raw") -> DataFrame:
    return df.select(
        F.lit(entity).alias("entity_type"), F.col("_source").alias("source"),
        F.col("_row").alias("source_row_number"), reason.alias("error_message"),
        field.alias("failed_field"), F.lit(ERROR_TYPE).alias("error_type"),
        F.col(raw).alias("raw_record"),
    )


def canonicalize(df: DataFrame, entity: str, primary: str, foreign: list[str], source: str,
                 row: str, file: str, ingested_at: Column | None = None) -> Split:
    """Canonical ids, or quarantine with the first bad id. Other fields keep their noise."""
    reason, field = _reason(primary, foreign)
    ids = [primary, *foreign]
    read = df.withColumns({f"_read_{n}": canonical_id(n) for n in ids})
    prepared = read.withColumns({
        "_raw": F.to_json(F.struct(*df.columns)), "_source": F.lit(source),
        "_row": F.col(row), "_reason": reason, "_field": field,
        "_original": F.col(primary),
    })
    fixed = prepared.filter(F.col("_reason").isNull()).withColumns({
        primary: _read(primary),
        **{f: F.coalesce(_read(f), F.col(f)) for f in foreign},
    }).withColumn("_lineage", lineage(source, F.col("_original"), F.lit(file), F.col("_row"),
                                      ingested_at, vocab.CANONICALIZER_VERSION))
    bad = prepared.filter(F.col("_reason").isNotNull())
    return Split(fixed.drop("_reason", "_field", "_original", *[f"_read_{n}" for n in ids]),
                 _quarantined(bad, entity, F.col("_reason"), F.col("_field")))


def merge_sources(authoritative: Split, secondary: Split, primary: str) -> Split:
    """Two canonicalised sources of one entity folded into one row per key."""
    return Split(
        prefer_authoritative(authoritative.good, secondary.good, primary, "_row"),
        authoritative.quarantine.unionByName(secondary.quarantine),
    )


def require_parents(split: Split, entity: str,
                    parents: list[tuple[str, DataFrame, str, bool]]) -> Split:
    """Quarantine rows whose parent is absent; parents are tried in the order given.

    Each parent is (column, frame, key, null_passes).
    """
    rows, reason, field = split.good, None, None
    flags = []
    for i, (column, frame, key, null_passes) in enumerate(parents):
        flag = f"_has{i}"
        flags.append(flag)
        rows = parents_present(rows, column, frame, key, flag)
        absent = ~F.col(flag)
        if null_passes:
            absent = absent & F.col(column).isNotNull()
        text = F.concat(F.lit(f"Orphan {column}: "), F.coalesce(F.col(column), F.lit("null")))
        reason = F.when(absent, text) if reason is None else reason.when(absent, text)
        field = F.when(absent, F.lit(column)) if field is None else field.when(
            absent, F.lit(column))
    judged = rows.withColumn("_reason", reason).withColumn("_field", field)
    good = judged.filter(F.col("_reason").isNull()).drop("_reason", "_field", *flags)
    bad = _quarantined(judged.filter(F.col("_reason").isNotNull()), entity, F.col("_reason"),
                       F.col("_field"))
    return Split(good, split.quarantine.unionByName(bad))


def note_soft_parent(df: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Keep every row; note the ones whose parent is absent."""
    flagged = parents_present(df, column, parents, key, "_has")
    note = F.when(F.col(column).isNotNull() & ~F.col("_has"),
                  F.concat(F.lit(f"Unresolved {column}: "), F.col(column)))
    return flagged.withColumn("_note", note).drop("_has")


def check_links(links: DataFrame, settlements: DataFrame, payments: DataFrame, source: str,
                row: str) -> Split:
    """Both ids present, canonical and existing; then the first row of each pair."""
    ids = ["settlement_id", "payment_id"]
    missing = blank(ids[0]) | blank(ids[1])
    reason = F.when(missing, F.lit("Missing settlement_id or payment_id"))
    field = F.when(blank(ids[0]), F.lit(ids[0])).when(blank(ids[1]), F.lit(ids[1]))
    for name in ids:
        bad = _read(name).isNull()
        reason = reason.when(bad, F.concat(F.lit(f"Cannot canonicalize FK '{name}': "),
                                           F.col(name)))
        field = field.when(bad, F.lit(name))
    work = [f"_read_{n}" for n in ids]
    prepared = links.withColumns({f"_read_{n}": canonical_id(n) for n in ids}).withColumns({
        "_raw": F.to_json(F.struct(*links.columns)), "_source": F.lit(source),
        "_row": F.col(row), "_reason": reason, "_field": field,
    })
    readable = prepared.filter(F.col("_reason").isNull()).withColumns(
        {n: _read(n) for n in ids}).drop("_reason", "_field", *work)
    unread = _quarantined(prepared.filter(F.col("_reason").isNotNull()), "settlement_payment",
                          F.col("_reason"), F.col("_field"))
    checked = require_parents(Split(readable, unread), "settlement_payment", [
        ("settlement_id", settlements, "settlement_id", False),
        ("payment_id", payments, "payment_id", False),
    ])
    return Split(first_per_key(checked.good, ids, F.col("_row")), checked.quarantine)


def fold_quarantine(current: DataFrame, earlier: DataFrame) -> DataFrame:
    """Earlier quarantine rows carried into this run's."""
    return current.unionByName(earlier, allowMissingColumns=True)


def canonicalize_record(df: DataFrame, primary: str, foreign: list[str]) -> DataFrame:
    """Best-effort form: ids that can be read are replaced, the others are listed in ``_errors``."""
    problems = [
        F.when(~blank(n) & canonical_id(n).isNull(),
               F.concat(F.lit(f"{n}: Cannot canonicalize ID '"), F.col(n), F.lit("'")))
        for n in [primary, *foreign]
    ]
    return df.withColumns({
        "_source_record_id": F.when(canonical_id(primary).isNotNull(), F.col(primary)),
        "_errors": F.array_compact(F.array(*problems)),
    }).withColumns({
        n: F.when(~blank(n), F.coalesce(canonical_id(n), F.col(n))).otherwise(F.col(n))
        for n in [primary, *foreign]
    })
