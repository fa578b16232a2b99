"""Dashboard totals, listings and dossiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconciliation_totals(bank: DataFrame) -> DataFrame:
    """Counts, rate and the unreconciled credit sum in one pass."""
    linked = F.col("settlement_id").isNotNull()
    open_credit = ~linked & (F.col("transaction_type") == "CREDIT")
    return bank.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(linked).alias("reconciled"),
        F.count_if(~linked).alias("unreconciled"),
        F.coalesce(F.sum(F.when(open_credit, F.col("amount"))), F.lit(0))
        .alias("total_discrepancy_amount"),
    ).withColumn("rate", F.when(F.col("total") > 0, F.round(
        F.col("reconciled") * 100.0 / F.col("total"), 2)).otherwise(0.0))


def breakdown(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, the unknown named, with each value's share of all rows.

    The share is taken from the few grouped rows, not from a window over the table.
    """
    grouped = df.groupBy(F.coalesce(column, F.lit("UNKNOWN")).alias(column)).agg(
        F.count(F.lit(1)).alias("row_count"))
    whole = grouped.agg(F.sum("row_count")).scalar()
    return grouped.select(column, "row_count", (F.col("row_count") / whole).alias("share"))


def settlement_totals(settlements: DataFrame) -> DataFrame:
    def total(name: str):
        return F.coalesce(F.sum(name), F.lit(0))

    return settlements.agg(
        F.count(F.lit(1)).alias("settlements"), total("gross_amount").alias("gross_amount"),
        total("net_amount").alias("net_amount"), total("total_fees").alias("total_fees"))


def recent_records(bank: DataFrame, limit: int = 10) -> DataFrame:
    return bank.orderBy(F.col("transaction_date").desc_nulls_first(),
                        F.col("bank_record_id").desc()).limit(limit).select(
        "bank_record_id", "merchant_id", "transaction_date", "amount", "transaction_type",
        "category", F.col("settlement_id").isNotNull().alias("reconciled"))


def unmatched_bank(bank: DataFrame) -> DataFrame:
    return bank.filter(F.col("settlement_id").isNull())


def unmatched_payments(payments: DataFrame, links: DataFrame) -> DataFrame:
    return payments.join(links.select("payment_id"), "payment_id", "left_anti")


def unmatched_listing(bank: DataFrame, payments: DataFrame, links: DataFrame, limit: int = 10
                      ) -> DataFrame:
    """Newest unmatched bank records and payments together."""
    both = unmatched_bank(bank).select(
        F.lit("bank_record").alias("source_type"), F.col("bank_record_id").alias("id"),
        F.col("transaction_date").cast("timestamp").alias("date")).unionByName(
        unmatched_payments(payments, links).select(
            F.lit("payment").alias("source_type"), F.col("payment_id").alias("id"),
            F.col("payment_date").alias("date")))
    return both.orderBy(F.col("date").desc_nulls_first(), "id").limit(limit)


def open_item_summary(bank: DataFrame, payments: DataFrame, links: DataFrame) -> DataFrame:
    waiting = unmatched_payments(payments, links)
    return bank.agg(
        F.count_if(F.col("settlement_id").isNull()).alias("unmatched_bank_records"),
        F.count(F.lit(1)).alias("total_bank_records")).withColumns({
            "unmatched_payments": waiting.agg(F.count(F.lit(1))).scalar(),
            "total_payments": payments.agg(F.count(F.lit(1))).scalar()})


def dossier_rows(parts: dict[str, tuple[DataFrame, str]], key: str) -> DataFrame:
    """Everything known about each record as rows of (key, part, part_id, record).

    ``parts`` maps a part name to its frame and id column; every frame holds
    ``key``. Long rows stay flat for a record with any number of children.
    """
    return reduce(DataFrame.unionByName, [
        df.select(key, F.lit(name).alias("part"), F.col(part_id).alias("part_id"),
                  F.to_json(F.struct(*df.columns)).alias("record"))
        for name, (df, part_id) in parts.items()])


def nested_dossiers(rows: DataFrame, key: str, page_size: int = 1000) -> DataFrame:
    """One row per record and page of parts, all parts of the record over its pages.

    A page is an array of at most ``page_size`` parts in (part, part_id) order, so a
    record with any number of children is complete without one unbounded array.
    """
    order = Window.partitionBy(key).orderBy("part", "part_id")
    placed = rows.withColumn("page", F.floor((F.row_number().over(order) - 1) / page_size))
    pages = placed.groupBy(key, "page").agg(F.sort_array(F.collect_list(
        F.struct("part", "part_id", "record"))).alias("parts"))
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("part_count"))
    return pages.join(counts, key)


def payment_dossier(t: dict[str, DataFrame]) -> DataFrame:
    orders = t["payments"].select("payment_id", "order_id").join(t["orders"], "order_id")
    links = t["settlement_payments"].join(
        t["settlements"].select("settlement_id", "net_amount", "utr", "settlement_date",
                                "gross_amount"), "settlement_id")
    return dossier_rows({
        "payment": (t["payments"], "payment_id"), "order": (orders, "order_id"),
        "fee": (t["fees"], "fee_id"), "refund": (t["refunds"], "refund_id"),
        "settlement_link": (links, "settlement_id"),
    }, "payment_id")


def settlement_dossier(t: dict[str, DataFrame]) -> DataFrame:
    paid = t["settlement_payments"].join(t["payments"], "payment_id")
    return dossier_rows({
        "settlement": (t["settlements"], "settlement_id"),
        "adjustment": (t["adjustments"], "adjustment_id"),
        "payment": (paid, "payment_id"),
    }, "settlement_id")
