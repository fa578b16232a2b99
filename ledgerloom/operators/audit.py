"""Integrity checks. Each gives one row per finding group; the report folds them to a verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import vocab
from ledgerloom.operators.matching import expected_net
from ledgerloom.operators.ordering import top_per_group
from ledgerloom.session import written

ROW = ["num", "name", "status", "failure_count", "severity", "notes"]

# Columns that must be filled, per table.
REQUIRED = {
    "merchants": ["merchant_id", "merchant_name"],
    "customers": ["customer_id", "merchant_id"],
    "orders": ["order_id", "merchant_id", "taxable_amount", "total_tax", "total_amount",
               "status"],
    "invoices": ["invoice_id", "order_id", "merchant_id", "invoice_number", "taxable_amount",
                 "total_tax", "total_amount"],
    "gst_records": ["gst_record_id", "invoice_id", "merchant_id", "seller_gstin", "supply_type",
                    "taxable_amount", "total_tax", "total_amount"],
    "payments": ["payment_id", "order_id", "merchant_id", "amount", "status"],
    "fees": ["fee_id", "payment_id", "merchant_id", "fee_amount", "tax_amount", "total_fee"],
    "refunds": ["refund_id", "payment_id", "order_id", "merchant_id", "refund_amount"],
    "settlements": ["settlement_id", "merchant_id", "gross_amount", "net_amount"],
    "settlement_payments": ["settlement_id", "payment_id", "allocated_amount"],
    "bank_records": ["bank_record_id", "merchant_id", "transaction_date", "amount",
                     "transaction_type"],
    "books": ["entry_id", "merchant_id", "account_code", "debit", "credit"],
    "adjustments": ["adjustment_id", "settlement_id", "merchant_id", "amount"],
}
UNIQUE = [
    ("merchants", "merchant_id"), ("customers", "customer_id"), ("orders", "order_id"),
    ("invoices", "invoice_id"), ("invoices", "invoice_number"), ("payments", "payment_id"),
    ("fees", "fee_id"), ("refunds", "refund_id"), ("settlements", "settlement_id"),
    ("bank_records", "bank_record_id"), ("books", "entry_id"),
    ("gst_records", "gst_record_id"), ("adjustments", "adjustment_id"),
]
# Natural keys whose fill share is reported.
NATURAL_KEYS = [("payments", "gateway_reference"), ("settlements", "utr"),
                ("bank_records", "reference"), ("invoices", "invoice_number"),
                ("books", "reference_id")]
# Names that only truth files may hold.
TRUTH_COLUMNS = ["exception_class", "exception_subclass", "corruption_type", "expected_result",
                 "expected_status", "is_match", "ground_truth", "label"]
MONEY_NAMES = ["amount", "total", "debit", "credit", "tax", "cgst", "sgst", "igst", "fees",
               "refunds", "subtotal", "discount"]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _literals(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def verdict_row(num: int, name: str, failures: DataFrame, bad: str, severity: str | Column,
                notes: Column | None = None) -> DataFrame:
    """One report row from a one-row frame with a ``failures`` column."""
    count = F.coalesce(F.col("failures"), F.lit(0)).cast("bigint")
    failed = count > 0
    return failures.select(
        F.lit(num).alias("num"), F.lit(name).alias("name"),
        F.when(failed, bad).otherwise("PASS").alias("status"), count.alias("failure_count"),
        F.when(failed, severity).otherwise("INFO").alias("severity"),
        (F.when(failed, notes) if notes is not None else F.lit(None).cast("string"))
        .alias("notes"))


# --- single checks ---------------------------------------------------------------


def expected_tables(spark, present: list[str]) -> DataFrame:
    """Expected tables and whether they exist; catalog metadata only."""
    have = set(present)
    rows = [(t, t in have) for t in sorted(REQUIRED)]
    return spark.createDataFrame(rows, "table_name string, present boolean")


def row_count_drift(raw: DataFrame, normalized: DataFrame, loaded: DataFrame) -> DataFrame:
    """Counts per table at three stages (frames of table_name, row_count)."""

    def named(df: DataFrame, name: str) -> DataFrame:
        return df.select("table_name", F.col("row_count").alias(name))

    return (
        named(raw, "raw_count").join(named(normalized, "normalized_count"), "table_name", "left")
        .join(named(loaded, "loaded_count"), "table_name", "left")
        .withColumn("lost", F.col("normalized_count") - F.coalesce("loaded_count", F.lit(0))))


def duplicate_values(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def unique_violations(tables: dict[str, DataFrame],
                      pairs: list[tuple[str, str]] = UNIQUE) -> DataFrame:
    return _union([
        _literals(duplicate_values(tables[t], c).agg(F.count(F.lit(1)).alias("duplicates")),
                  table_name=t, column_name=c).select("table_name", "column_name", "duplicates")
        for t, c in pairs if t in tables])


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Filled keys of child rows with no parent."""
    return child.filter(F.col(column).isNotNull()).select(F.col(column).alias("orphan_id")).join(
        parent.select(F.col(key).alias("orphan_id")), "orphan_id", "left_anti")


def _lost(tables: dict[str, DataFrame], pairs) -> DataFrame:
    """(child_table, column_name, parent_table, orphan_id, rows) of keys without a parent.

    Keys are counted per id first; all children of one parent meet it in one join.
    """
    out = []
    for parent in dict.fromkeys(p for _, _, p in pairs):
        named = _union([
            tables[child].filter(F.col(column).isNotNull())
            .groupBy(F.col(column).alias("orphan_id")).agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit(child).alias("child_table"), F.lit(column).alias("column_name"),
                    F.lit(parent).alias("parent_table"), "orphan_id", "rows")
            for child, column, p in pairs if p == parent])
        held = tables[parent].select(F.col(vocab.PRIMARY_KEYS[parent]).alias("orphan_id"))
        out.append(named.join(held, "orphan_id", "left_anti").select(named.columns))
    return _union(out)


def orphan_counts(tables: dict[str, DataFrame], pairs=None, samples: int = 10) -> DataFrame:
    """Orphans per foreign key, with the first few ids in order."""
    pairs = list(pairs or vocab.FOREIGN_KEYS)
    key = ["child_table", "column_name", "parent_table"]
    lost = written(_lost(tables, pairs), "orphans")
    firsts = top_per_group(lost, key, [F.col("orphan_id")], samples).groupBy(*key).agg(
        F.array_join(F.sort_array(F.collect_list("orphan_id")), ",").alias("sample_ids"))
    few = lost.groupBy(*key).agg(F.sum("rows").alias("orphans")).join(firsts, key)
    spark = few.sparkSession
    return spark.createDataFrame(pairs, "child_table string, column_name string, "
                                 "parent_table string").join(few, key, "left").select(
        *key, F.coalesce("orphans", F.lit(0)).alias("orphans"),
        F.coalesce("sample_ids", F.lit("")).alias("sample_ids"))


def orphan_totals(tables: dict[str, DataFrame], pairs=None) -> DataFrame:
    """Orphans per column of the foreign keys that have some."""
    return _lost(tables, list(pairs or vocab.FOREIGN_KEYS)).groupBy("column_name").agg(
        F.sum("rows").alias("orphans"))


def null_counts(tables: dict[str, DataFrame], required: dict[str, list[str]] = REQUIRED
                ) -> DataFrame:
    """Nulls per required column; one scan per table, whatever the number of columns."""
    out = []
    for table, columns in required.items():
        if table not in tables:
            continue
        held = [c for c in columns if c in tables[table].columns]
        wide = tables[table].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in held])
        long = wide.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in held]))
            .alias("x")).select("x.*")
        out.append(long.withColumn("table_name", F.lit(table)))
    return _union(out).select("table_name", "column_name", "nulls")


def arithmetic_gaps(invoices: DataFrame, settlements: DataFrame) -> DataFrame:
    """Rows whose identity is off, with the sum and the largest of the differences."""
    inv = F.abs(F.col("taxable_amount") + F.col("cgst") + F.col("sgst") + F.col("igst")
                - F.col("total_amount"))
    stl = F.abs(expected_net() - F.col("net_amount"))

    def summed(df: DataFrame, gap: Column, tolerance: str, name: str) -> DataFrame:
        off = gap > F.lit(tolerance).cast("decimal(5,3)")
        return df.agg(
            F.count_if(off).alias("failures"),
            F.coalesce(F.sum(F.when(off, gap)), F.lit(0)).alias("total_difference"),
            F.coalesce(F.max(F.when(off, gap)), F.lit(0)).alias("largest")).withColumn(
            "identity", F.lit(name))

    return summed(invoices, inv, "0.005", "invoice").unionByName(
        summed(settlements, stl, "0.010", "settlement")).select(
        "identity", "failures", "total_difference", "largest")


def ledger_totals(books: DataFrame) -> DataFrame:
    gap = F.abs(F.sum("debit") - F.sum("credit"))
    return books.agg(
        F.sum("debit").alias("debit"), F.sum("credit").alias("credit"), gap.alias("difference"),
        F.count_if((F.col("debit") > 0) & (F.col("credit") > 0)).alias("two_sided"))


def unbalanced(books: DataFrame, key: str) -> DataFrame:
    """Groups whose debits and credits differ by more than a cent."""
    return books.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.sum("debit").alias("debit"), F.sum("credit").alias("credit"),
        F.abs(F.sum("debit") - F.sum("credit")).alias("difference")).filter(
        F.col("difference") > F.lit("0.01").cast("decimal(3,2)"))


def children_per_parent(parents: DataFrame, kids: DataFrame, key: str, name: str) -> DataFrame:
    """Average, least and most children of parents that have any; parents with none or several."""
    sizes = kids.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    childless = parents.select(key).join(kids.select(key), key, "left_anti").agg(
        F.count(F.lit(1)).alias("without_children"))
    shape = sizes.agg(F.avg("n").alias("average"), F.min("n").alias("least"),
                      F.max("n").alias("most"), F.count_if(F.col("n") > 1).alias("with_several"))
    return shape.withColumns({"without_children": childless.scalar(),
                              "relation": F.lit(name)}).select(
        "relation", "average", "least", "most", "with_several", "without_children")


def cardinalities(t: dict[str, DataFrame]) -> DataFrame:
    return _union([
        children_per_parent(t["merchants"], t["customers"], "merchant_id",
                            "merchants-customers"),
        children_per_parent(t["orders"], t["invoices"], "order_id", "orders-invoices"),
        children_per_parent(t["orders"], t["payments"], "order_id", "orders-payments"),
        children_per_parent(t["invoices"], t["gst_records"], "invoice_id", "invoices-gst"),
    ])


def link_problems(links: DataFrame, settlements: DataFrame, payments: DataFrame) -> DataFrame:
    pairs = links.groupBy("settlement_id", "payment_id").agg(F.count(F.lit(1)).alias("n"))
    counts = {
        "orphan_settlement": orphans(links, "settlement_id", settlements, "settlement_id").agg(
            F.count(F.lit(1)).alias("failures")),
        "orphan_payment": orphans(links, "payment_id", payments, "payment_id").agg(
            F.count(F.lit(1)).alias("failures")),
        "duplicate_pair": pairs.agg(F.count_if(F.col("n") > 1).alias("failures")),
        "bad_allocation": links.agg(F.count_if(
            F.col("allocated_amount").isNull() | (F.col("allocated_amount") < 0))
            .alias("failures")),
    }
    return _union([df.withColumn("problem", F.lit(k)) for k, df in counts.items()]).select(
        "problem", "failures")


def bank_gaps(bank: DataFrame, settlements: DataFrame) -> DataFrame:
    """Distance of every linked bank record from its settlement amount."""
    linked = bank.filter(F.col("settlement_id").isNotNull()).join(
        settlements.select("settlement_id", "net_amount"), "settlement_id")
    gap = F.abs(F.col("amount") - F.col("net_amount"))
    return linked.select("bank_record_id", "amount", "net_amount", gap.alias("difference"))


def largest_bank_gaps(bank: DataFrame, settlements: DataFrame, top: int = 20) -> DataFrame:
    """Linked bank records furthest from their settlement amount: a listing of the top few."""
    return bank_gaps(bank, settlements) \
        .orderBy(F.col("difference").desc(), "bank_record_id").limit(top)


def tax_gaps(invoices: DataFrame, gst: DataFrame) -> DataFrame:
    """Invoice and tax rows that disagree, counted per component."""
    parts = ["taxable_amount", "cgst", "sgst", "igst", "total_tax"]
    g = gst.select("invoice_id", *[F.col(p).alias(f"g_{p}") for p in parts])
    both = invoices.join(g, "invoice_id")
    off = {p: F.abs(F.col(p) - F.col(f"g_{p}")) > F.lit("0.01").cast("decimal(3,2)")
           for p in parts}
    # The integrated part is reported but does not select rows.
    any_off = reduce(lambda a, b: a | b, [off[p] for p in parts if p != "igst"])
    return both.filter(any_off).agg(
        F.count(F.lit(1)).alias("rows_off"), *[F.count_if(off[p]).alias(f"{p}_off") for p in parts])


def payment_order_mismatches(payments: DataFrame, orders: DataFrame) -> DataFrame:
    o = orders.select("order_id", *[F.col(c).alias(f"o_{c}") for c in
                                    ("merchant_id", "customer_id", "currency")])
    both = payments.join(o, "order_id", "left")
    known = F.col("o_merchant_id").isNotNull()
    return both.agg(
        *[F.count_if(F.col(c) != F.col(f"o_{c}")).alias(f"{c}_mismatch")
          for c in ("merchant_id", "customer_id", "currency")],
        F.count_if(~known).alias("orphan_payments"))


def over_refunds(refunds: DataFrame, payments: DataFrame) -> DataFrame:
    """Single refunds and refund totals that exceed their payment."""
    amounts = payments.select("payment_id", "amount")
    single = refunds.join(amounts, "payment_id").agg(
        F.count_if(F.col("refund_amount") > F.col("amount")).alias("single"))
    total = refunds.groupBy("payment_id").agg(F.sum("refund_amount").alias("refunded")).join(
        amounts, "payment_id").agg(
        F.count_if(F.col("refunded") > F.col("amount")).alias("cumulative"))
    return single.withColumn("cumulative", total.scalar())


def source_duplicates(tables: dict[str, DataFrame]) -> DataFrame:
    """Repeated (source, source record id) pairs per table with lineage columns."""
    out = []
    for name, df in tables.items():
        pairs = df.filter(F.col("lineage_source").isNotNull()
                          & F.col("lineage_source_record_id").isNotNull()).groupBy(
            "lineage_source", "lineage_source_record_id").agg(F.count(F.lit(1)).alias("n"))
        out.append(pairs.agg(F.count_if(F.col("n") > 1).alias("duplicates")).withColumn(
            "table_name", F.lit(name)))
    return _union(out).select("table_name", "duplicates")


LINEAGE = {"lineage_source": "source_percent", "lineage_source_record_id": "record_percent",
           "lineage_ingested_at": "ingested_percent", "lineage_normalizer_ver": "version_percent"}


def lineage_coverage(tables: dict[str, DataFrame], least: float = 90.0) -> DataFrame:
    """Filled share of the lineage columns per table; the source's share decides."""
    out = []
    for name, df in tables.items():
        shares = [F.round(100.0 * F.count(c) / F.count(F.lit(1)), 2).alias(label)
                  for c, label in LINEAGE.items()]
        out.append(df.agg(*shares).select(
            F.lit(name).alias("table_name"), *LINEAGE.values(),
            F.when(F.col("source_percent") < least, "WARN").otherwise("PASS").alias("status")))
    return _union(out)


def key_fill(tables: dict[str, DataFrame], keys=NATURAL_KEYS) -> DataFrame:
    return _union([
        tables[t].agg(
            F.count(F.lit(1)).alias("row_count"), F.count(c).alias("filled"),
            F.round(100.0 * F.count(c) / F.count(F.lit(1)), 2).alias("percent")).select(
            F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), "row_count", "filled",
            "percent")
        for t, c in keys if t in tables])


def by_group(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("row_count"))


def truth_gaps(edges: DataFrame, tables: dict[str, DataFrame], kinds: dict[str, str]
               ) -> DataFrame:
    """Ids named by truth edges that the tables do not hold, per record type."""
    out = []
    for kind, table in kinds.items():
        key = vocab.PRIMARY_KEYS[table]
        named = edges.filter(F.col("target_type") == kind).select(F.col("target_id").alias(key))
        missing = named.distinct().join(tables[table].select(key), key, "left_anti")
        out.append(missing.agg(F.count(F.lit(1)).alias("missing")).withColumn(
            "record_type", F.lit(kind)))
    return _union(out).select("record_type", "missing")


def schema_findings(spark, tables: dict[str, DataFrame]) -> DataFrame:
    """Truth columns inside source tables, and money held in floating point."""
    rows = []
    for name, df in tables.items():
        for field in df.schema.fields:
            if field.name in TRUTH_COLUMNS:
                rows.append((name, field.name, "TRUTH_COLUMN"))
            money = any(part in field.name.split("_") for part in MONEY_NAMES)
            if money and isinstance(field.dataType, (T.DoubleType, T.FloatType)):
                rows.append((name, field.name, "FLOAT_MONEY"))
    return spark.createDataFrame(rows, "table_name string, column_name string, finding string")


def invariants(t: dict[str, DataFrame]) -> DataFrame:
    """The eight identities of clean data and how many rows break each."""
    orders = t["orders"].select("order_id", F.col("total_amount").alias("order_total"))
    cent = F.lit("0.01").cast("decimal(3,2)")
    checks = {
        "order_total": t["orders"].agg(F.count_if(
            F.col("total_amount") != F.col("taxable_amount") + F.col("total_tax"))),
        "invoice_order": t["invoices"].join(orders, "order_id").agg(F.count_if(
            F.col("total_amount") != F.col("order_total"))),
        "payment_order": t["payments"].filter(F.col("status") == "CAPTURED").join(
            orders, "order_id").agg(F.count_if(F.col("amount") != F.col("order_total"))),
        "fee_tax": t["fees"].agg(F.count_if(F.col("tax_amount") != F.round(
            F.col("fee_amount") * F.lit(vocab.GST_RATE).cast("decimal(5,4)"), 2))),
        "settlement_net": t["settlements"].agg(F.count_if(
            F.col("net_amount") != expected_net())),
        "bank_settlement": t["bank_records"].join(
            t["settlements"].select("settlement_id", "net_amount"), "settlement_id").agg(
            F.count_if(F.col("amount") != F.col("net_amount"))),
        "gst_parts": t["gst_records"].agg(F.count_if(
            F.col("total_tax") != F.col("cgst") + F.col("sgst") + F.col("igst"))),
        "merchant_ledger": t["books"].groupBy("merchant_id").agg(
            F.abs(F.sum("debit") - F.sum("credit")).alias("gap")).agg(
            F.count_if(F.col("gap") >= cent)),
    }
    return _union([df.toDF("failures").withColumn("invariant", F.lit(k))
                   for k, df in checks.items()]).select("invariant", "failures")


# --- report ------------------------------------------------------------------------


def _presence_row(num: int, name: str, rows: DataFrame) -> DataFrame:
    """Passes when there is any row; an empty table is worth a note, no failure."""
    none = F.col("n") == 0
    return rows.limit(1).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(num).alias("num"), F.lit(name).alias("name"),
        F.when(none, "WARN").otherwise("PASS").alias("status"),
        F.lit(0).cast("bigint").alias("failure_count"),
        F.when(none, "LOW").otherwise("INFO").alias("severity"),
        F.lit(None).cast("string").alias("notes"))


def provenance(drift: DataFrame, lineage: dict[str, DataFrame], seen: DataFrame,
               quarantine: DataFrame, edges: DataFrame, payments: DataFrame) -> DataFrame:
    """Report rows of the checks on where rows came from: stage counts (2), repeated sources
    (14), lineage (15), source map (16), quarantine (17) and truth edges (18)."""
    none = F.lit(0).cast("bigint")
    missing = truth_gaps(edges, {"payments": payments}, {"payment": "payments"})
    rows = [
        verdict_row(2, "Row Counts", drift.agg(F.count_if(F.col("lost") > 0).alias("failures")),
                    "WARN", "MEDIUM"),
        verdict_row(14, "Duplicate Detection", source_duplicates(lineage).agg(
            F.coalesce(F.sum("duplicates"), none).alias("failures")), "INFO", "LOW"),
        verdict_row(15, "Lineage Check", lineage_coverage(lineage).agg(
            F.count_if(F.col("status") == "WARN").alias("failures")), "WARN", "MEDIUM"),
        _presence_row(16, "Normalization Source Map", seen),
        _presence_row(17, "Quarantine Check", quarantine),
        verdict_row(18, "GT: event_links→payments", missing.select(
            F.col("missing").alias("failures")), "WARN", "MEDIUM"),
    ]
    return _union([r.select(*ROW) for r in rows])


def report(t: dict[str, DataFrame], more: DataFrame | None = None) -> DataFrame:
    """All table-level checks as rows of (num, name, status, failure_count, severity, notes).

    ``more`` adds rows, such as those of ``provenance``, so that the verdict sees them.
    """
    fk = orphan_totals(t).agg(
        F.sum("orphans").alias("failures"),
        F.sum(F.when(F.col("column_name").isin(vocab.CRITICAL_FK_COLUMNS), F.col("orphans"))
              .otherwise(0)).alias("critical"))
    grave = F.when(F.col("critical") > 0, "CRITICAL").otherwise("HIGH")
    fk_row = verdict_row(4, "FK/Orphan Checks", fk, "FAIL", grave, F.concat(
        F.lit("Critical FK orphans: "), F.col("critical").cast("string")))
    gaps = arithmetic_gaps(t["invoices"], t["settlements"])
    totals = ledger_totals(t["books"])
    links = link_problems(t["settlement_payments"], t["settlements"], t["payments"])
    shape = cardinalities(t)
    suspicious = F.count_if(
        ((F.col("relation") == "merchants-customers") & (F.col("without_children") > 0))
        | (F.col("relation").isin("orders-invoices", "invoices-gst")
           & (F.col("with_several") > 0))
        | ((F.col("relation") == "orders-payments") & (F.col("with_several") > 5)))
    mismatch = payment_order_mismatches(t["payments"], t["orders"])
    refunded = over_refunds(t["refunds"], t["payments"])

    def total(df: DataFrame, value: Column) -> DataFrame:
        return df.agg(F.coalesce(F.sum(value), F.lit(0)).alias("failures"))

    rows = [
        verdict_row(3, "PK/Unique Integrity", total(unique_violations(t), F.col("duplicates")),
                    "FAIL", "CRITICAL"),
        fk_row,
        verdict_row(5, "NULL/Required Field Checks", total(null_counts(t), F.col("nulls")),
                    "FAIL", "HIGH"),
        verdict_row(6, "Invoice Arithmetic", gaps.filter(F.col("identity") == "invoice").select(
            "failures"), "FAIL", "HIGH"),
        verdict_row(6, "Settlement Arithmetic", gaps.filter(
            F.col("identity") == "settlement").select("failures"), "FAIL", "MEDIUM"),
        verdict_row(7, "Ledger Balance (Overall)", totals.select(
            (F.col("difference") >= 1).cast("int").alias("failures")), "FAIL", "HIGH"),
        verdict_row(7, "Ledger Double-Sided Entries", totals.select(
            F.col("two_sided").alias("failures")), "FAIL", "HIGH"),
        verdict_row(7, "Ledger Balance per Reference", unbalanced(
            t["books"], "canonical_reference_id").agg(F.count(F.lit(1)).alias("failures")), "WARN",
            "MEDIUM"),
        verdict_row(8, "Cardinality Checks", shape.agg(suspicious.alias("failures")), "WARN",
                    "MEDIUM"),
        verdict_row(9, "Settlement-Payment Consistency", total(links, F.when(
            F.col("problem") != "bad_allocation", F.col("failures"))), "FAIL", "HIGH"),
        verdict_row(10, "Bank↔Settlement Consistency", bank_gaps(
            t["bank_records"], t["settlements"]).agg(F.count_if(
                F.col("difference") > 1).alias("failures")), "WARN", "MEDIUM"),
        verdict_row(11, "Invoice↔GST Consistency", tax_gaps(
            t["invoices"], t["gst_records"]).select(F.col("rows_off").alias("failures")),
            "WARN", "MEDIUM"),
        verdict_row(12, "Payment↔Order Consistency", mismatch.select(
            (F.col("merchant_id_mismatch") + F.col("orphan_payments")).alias("failures")),
            "WARN", "MEDIUM"),
        verdict_row(13, "Refund Consistency", refunded.select(
            (F.col("single") + F.col("cumulative")).alias("failures")), "WARN", "MEDIUM"),
    ]
    own = _union([r.select(*ROW) for r in rows])
    return own if more is None else own.unionByName(more.select(*ROW))


def final_verdict(rows: DataFrame) -> DataFrame:
    """Ready only when nothing critical or high has failed."""
    grave = (F.col("status") == "FAIL") & F.col("severity").isin("CRITICAL", "HIGH")
    return rows.agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "WARN").alias("warned"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
        F.count_if(grave).alias("blocking")).withColumn(
        "verdict", F.when(F.col("blocking") == 0, "READY").otherwise("NOT READY"))
