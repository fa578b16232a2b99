"""Entities derived from other entities: fees, invoices, tax rows, settlements, ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import vocab
from ledgerloom.functions.amounts import MONEY, gateway_fee, settlement_net
from ledgerloom.functions.base import lookup
from ledgerloom.functions.identifiers import padded
from ledgerloom.operators.ordering import position, running_sum

def zero() -> Column:
    return F.lit("0.00").cast(MONEY)


def id_number(value: Column | str) -> Column:
    text = F.col(value) if isinstance(value, str) else value
    return F.regexp_extract(text, r"(\d+)$", 1).cast("bigint")


def same_number(prefix: str, value: str) -> Column:
    """Id of another family carrying the same number as ``value``."""
    return padded(prefix, id_number(value))


def derive_fees(payments: DataFrame) -> DataFrame:
    """One fee row per payment; payments not captured get a zero row."""
    charged = F.col("status") == "CAPTURED"
    fee = gateway_fee(F.col("amount"), F.col("payment_method"))
    return payments.select(
        same_number("FEE", "payment_id").alias("fee_id"),
        "payment_id", "merchant_id",
        F.lit("PLATFORM_FEE").alias("fee_type"),
        *[F.when(charged, fee[c]).otherwise(zero()).alias(c)
          for c in ("fee_amount", "tax_amount", "total_fee")],
        F.lit(vocab.DEFAULT_CURRENCY).alias("currency"),
        "payment_method",
    )


def derive_invoices(orders: DataFrame, merchants: DataFrame) -> DataFrame:
    """One invoice per completed order, due in thirty days."""
    number = F.concat_ws("/", F.lit("INV"), F.date_format("order_date", "yyyy"),
                         F.substring("merchant_id", -3, 3),
                         F.regexp_extract("order_id", r"(\d+)$", 1))
    carried = ["subtotal", "discount", "taxable_amount", "cgst", "sgst", "igst", "total_tax",
               "total_amount"]
    return (
        orders.filter(F.col("status") == "COMPLETED")
        .join(merchants.select("merchant_id", F.col("gstin").alias("seller_gstin")),
              "merchant_id")
        .select(
            same_number("INV", "order_id").alias("invoice_id"),
            "order_id", "merchant_id", "customer_id",
            number.alias("invoice_number"),
            F.col("order_date").alias("invoice_date"),
            F.date_add(F.to_date("order_date"), 30).alias("due_date"),
            *carried, "currency", "seller_gstin", "seller_state", "buyer_state",
            F.lit("ISSUED").alias("status"),
        )
    )


def derive_gst(invoices: DataFrame) -> DataFrame:
    """One tax row per invoice; supply type follows the two states."""
    local = F.col("seller_state") == F.col("buyer_state")
    return invoices.select(
        same_number("GST", "invoice_id").alias("gst_record_id"),
        "invoice_id", "invoice_number", "merchant_id", "seller_gstin",
        F.lit(None).cast("string").alias("buyer_gstin"),
        F.when(local, "INTRA_STATE").otherwise("INTER_STATE").alias("supply_type"),
        "taxable_amount", "cgst", "sgst", "igst", "total_tax", "total_amount",
        F.date_format("invoice_date", "MM-yyyy").alias("filing_period"),
        F.lit("GSTR-1").alias("return_type"),
        F.lit("FILED").alias("status"),
    )


def assign_batches(payments: DataFrame, size: int = 10) -> DataFrame:
    """Captured payments numbered into consecutive batches per merchant in date order.

    Batches of all merchants are counted through, merchant after merchant, so a
    settlement has a number of its own however many a merchant has.
    """
    captured = payments.filter(F.col("status") == "CAPTURED").select(
        "payment_id", "merchant_id", "payment_date", "amount")
    placed = position(captured, ["merchant_id"], [F.col("payment_date"), F.col("payment_id")])
    batch = F.floor((F.col("position") - 1) / size).cast("bigint")
    held = captured.groupBy("merchant_id").agg(
        F.ceil(F.count(F.lit(1)) / size).cast("bigint").alias("_held"))
    through = running_sum(held, [], [id_number("merchant_id"), F.col("merchant_id")],
                          F.col("_held"), "_through")
    return (
        placed.withColumn("batch", batch).drop("position")
        .join(through, "merchant_id")
        .withColumn("settlement_id", padded("STL", F.col("_through") - F.col("_held")
                                            + F.col("batch") + 1))
        .select("payment_id", "merchant_id", "payment_date", "amount", "batch", "settlement_id")
    )


def derive_links(batches: DataFrame) -> DataFrame:
    return batches.select("settlement_id", "payment_id",
                          F.col("amount").alias("allocated_amount"))


def derive_settlements(batches: DataFrame, fees: DataFrame, refunds: DataFrame,
                       delay_days: int = 2) -> DataFrame:
    """One settlement per batch. Children are summed per payment before any join."""
    per_fee = fees.groupBy("payment_id").agg(
        F.max_by(F.struct("fee_amount", "tax_amount"), "fee_id").alias("fee"))
    per_refund = refunds.groupBy("payment_id").agg(F.sum("refund_amount").alias("refunded"))
    rows = (
        batches.join(per_fee, "payment_id", "left").join(per_refund, "payment_id", "left")
        .groupBy("merchant_id", "batch", "settlement_id")
        .agg(
            F.max("payment_date").alias("last_payment"),
            F.sum("amount").cast(MONEY).alias("gross_amount"),
            F.coalesce(F.sum("fee.fee_amount"), zero()).cast(MONEY).alias("total_fees"),
            F.coalesce(F.sum("fee.tax_amount"), zero()).cast(MONEY).alias("total_fee_tax"),
            F.coalesce(F.sum("refunded"), zero()).cast(MONEY).alias("total_refunds"),
            F.count(F.lit(1)).cast("int").alias("payment_count"),
        )
    )
    number = id_number("settlement_id")
    reference = F.concat(
        F.lit("UTIB"),
        F.lpad((number * 7919 % 10000000000000).cast("string"), 13, "0"),
    )
    return rows.select(
        "settlement_id", "merchant_id",
        (F.col("last_payment") + F.make_dt_interval(F.lit(delay_days))).alias("settlement_date"),
        "gross_amount", "total_fees", "total_fee_tax", "total_refunds",
        zero().alias("total_adjustments"),
        settlement_net(F.col("gross_amount"), F.col("total_fees"), F.col("total_fee_tax"),
                       F.col("total_refunds"), zero()).alias("net_amount"),
        F.lit(vocab.DEFAULT_CURRENCY).alias("currency"),
        reference.alias("utr"),
        F.lit("SETTLED").alias("status"),
        "payment_count",
    )


# kind digit inside an entry number, so entries of different events never collide
_KINDS = {"ORDER": 1, "PAYMENT": 2, "FEE": 3, "REFUND": 4, "SETTLEMENT": 5, "ADJUSTMENT": 6}


def _line(account: Column | str, label: str, debit: Column, credit: Column, kind: str,
          optional: bool = False) -> Column:
    """One side of a posting; an optional line is only kept when its amount is positive."""
    name = F.lit(account) if isinstance(account, str) else account
    kept = (debit + credit > 0) if optional else F.lit(True)
    return F.struct(name.alias("account"), F.lit(label).alias("label"),
                    debit.cast(MONEY).alias("debit"), credit.cast(MONEY).alias("credit"),
                    F.lit(kind).alias("entry_type"), kept.alias("kept"))


def _post(events: DataFrame, kind: str, reference: str, on: Column, *lines: Column) -> DataFrame:
    """Explode the posting lines of each event into ledger entries."""
    number = id_number("reference_id") * 100 + _KINDS[kind] * 10 + F.col("line") + 1
    return (
        events.select("merchant_id", on.alias("entry_date"), F.col(reference).alias("reference_id"),
                      F.posexplode(F.array(*lines)).alias("line", "posting"))
        .filter("posting.kept")
        .select(
            padded("LED", number).alias("entry_id"),
            "merchant_id", "entry_date",
            "posting.account", "posting.label", "posting.debit", "posting.credit",
            F.lit(kind).alias("reference_type"), "reference_id", "posting.entry_type",
        )
    )


def derive_books(orders: DataFrame, payments: DataFrame, fees: DataFrame, refunds: DataFrame,
                 settlements: DataFrame, adjustments: DataFrame | None = None,
                 undated: str = "2026-08-15") -> DataFrame:
    """Double-entry postings of every financial event."""
    total, taxable = F.col("total_amount"), F.col("taxable_amount")
    sales = _post(
        orders.filter(F.col("status") == "COMPLETED"), "ORDER", "order_id",
        F.to_date("order_date"),
        _line("ACCOUNTS_RECEIVABLE", "Sale - ", total, zero(), "SALE"),
        _line("REVENUE", "Revenue - ", zero(), taxable, "SALE"),
        *[_line(f"{part.upper()}_PAYABLE", f"{part.upper()} on ", zero(), F.col(part), "TAX", True)
          for part in ("cgst", "sgst", "igst")],
    )
    amount = F.col("amount")
    receipts = _post(
        payments.filter(F.col("status") == "CAPTURED"), "PAYMENT", "payment_id",
        F.to_date("payment_date"),
        _line("GATEWAY_RECEIVABLE", "Payment received - ", amount, zero(), "PAYMENT"),
        _line("ACCOUNTS_RECEIVABLE", "AR cleared - ", zero(), amount, "PAYMENT"),
    )
    dated_fees = fees.filter(F.col("fee_amount") > 0).join(
        payments.select("payment_id", "payment_date"), "payment_id", "left")
    charge, tax = F.col("fee_amount"), F.col("tax_amount")
    charges = _post(
        dated_fees, "FEE", "fee_id",
        F.coalesce(F.to_date("payment_date"), F.lit(undated).cast("date")),
        _line("PROCESSING_FEE", "Gateway fee - ", charge, zero(), "FEE"),
        _line("FEE_GST_INPUT", "Fee GST input - ", tax, zero(), "FEE", True),
        _line("GATEWAY_RECEIVABLE", "Fee deducted - ", zero(), charge + tax, "FEE"),
    )
    back = F.col("refund_amount")
    returns = _post(
        refunds, "REFUND", "refund_id", F.to_date("refund_date"),
        _line("REFUND_EXPENSE", "Refund - ", back, zero(), "REFUND"),
        _line("GATEWAY_RECEIVABLE", "Refund via gateway - ", zero(), back, "REFUND"),
    )
    net = F.col("net_amount")
    payouts = _post(
        settlements, "SETTLEMENT", "settlement_id", F.to_date("settlement_date"),
        _line("BANK_ACCOUNT", "Settlement received - ", net, zero(), "SETTLEMENT"),
        _line("GATEWAY_RECEIVABLE", "Gateway settled - ", zero(), net, "SETTLEMENT"),
    )
    parts = [sales, receipts, charges, returns, payouts]
    if adjustments is not None:
        size, up = F.abs(F.col("amount")), F.col("amount") >= 0
        parts.append(_post(
            adjustments, "ADJUSTMENT", "adjustment_id", F.to_date("adjustment_date"),
            _line(F.when(up, "GATEWAY_RECEIVABLE").otherwise("ADJUSTMENT_EXPENSE"),
                  "Adjustment - ", size, zero(), "ADJUSTMENT"),
            _line(F.when(up, "ADJUSTMENT_INCOME").otherwise("GATEWAY_RECEIVABLE"),
                  "Adjustment - ", zero(), size, "ADJUSTMENT"),
        ))
    code = {k: v[0] for k, v in vocab.ACCOUNTS.items()}
    title = {k: v[1] for k, v in vocab.ACCOUNTS.items()}
    return reduce(DataFrame.unionByName, parts).select(
        "entry_id", "merchant_id", "entry_date",
        lookup(code, F.col("account")).alias("account_code"),
        lookup(title, F.col("account")).alias("account_name"),
        "debit", "credit", "reference_type", "reference_id",
        F.concat("label", "reference_id").alias("description"),
        "entry_type",
    )


def truth_edges(tables: dict[str, DataFrame]) -> DataFrame:
    """Expected links between records, one row per edge."""
    # (child table, child type, child id, parent type, parent id, relationship)
    kinds = [
        ("invoices", "invoice", "invoice_id", "order", "order_id", "DERIVED_FROM"),
        ("payments", "payment", "payment_id", "order", "order_id", "PAYS_FOR"),
        ("fees", "fee", "fee_id", "payment", "payment_id", "CHARGED_ON"),
        ("refunds", "refund", "refund_id", "payment", "payment_id", "REFUNDS"),
        ("settlement_payments", "settlement", "settlement_id", "payment", "payment_id",
         "SETTLES"),
        ("bank_records", "bank_record", "bank_record_id", "settlement", "settlement_id",
         "CORRESPONDS_TO"),
        ("gst_records", "gst_record", "gst_record_id", "invoice", "invoice_id", "TAX_FOR"),
        ("books", "book_entry", "entry_id", None, "reference_id", "RECORDS"),
        ("adjustments", "adjustment", "adjustment_id", "settlement", "settlement_id",
         "ADJUSTS"),
    ]
    edges = []
    for table, kind, source, parent, target, relation in kinds:
        if table not in tables:
            continue
        frame = tables[table]
        if table == "bank_records":
            frame = frame.filter(F.col(target).isNotNull())
        edges.append(frame.select(
            F.lit(kind).alias("source_type"), F.col(source).alias("source_id"),
            (F.lower("reference_type") if parent is None else F.lit(parent)).alias("target_type"),
            F.col(target).alias("target_id"), F.lit(relation).alias("relationship"),
            F.lit("MATCH").alias("expected_status"),
        ))
    return reduce(DataFrame.unionByName, edges)


def expected_matches(invoices: DataFrame, payments: DataFrame, bank: DataFrame,
                     gst: DataFrame) -> DataFrame:
    """Expected matches of the four scored pair types."""

    def rows(frame, pair, source_type, source, target_type, target, fields):
        return frame.select(
            F.lit(pair).alias("pair_type"), F.lit(source_type).alias("source_type"),
            F.col(source).alias("source_id"), F.lit(target_type).alias("target_type"),
            F.col(target).alias("target_id"), F.lit("MATCH").alias("expected_result"),
            F.array(*[F.lit(f) for f in fields]).alias("match_fields"),
        )

    return reduce(DataFrame.unionByName, [
        rows(invoices, vocab.ORDER_INVOICE, "order", "order_id", "invoice", "invoice_id",
             ["total_amount", "taxable_amount", "total_tax"]),
        rows(payments.filter(F.col("status") == "CAPTURED"), vocab.ORDER_PAYMENT, "order",
             "order_id", "payment", "payment_id", ["total_amount"]),
        rows(bank.filter(F.col("settlement_id").isNotNull()), vocab.SETTLEMENT_BANK,
             "settlement", "settlement_id", "bank_record", "bank_record_id", ["net_amount"]),
        rows(gst, vocab.INVOICE_GST, "invoice", "invoice_id", "gst_record", "gst_record_id",
             ["taxable_amount", "total_tax", "cgst", "sgst", "igst"]),
    ])


def missing_invoices(orders: DataFrame, invoices: DataFrame) -> DataFrame:
    """Completed orders that no invoice refers to."""
    return (
        orders.filter(F.col("status") == "COMPLETED").select("order_id")
        .join(invoices.select("order_id"), "order_id", "left_anti")
        .select(
            F.lit("order").alias("entity_type"), F.col("order_id").alias("entity_id"),
            F.lit("MISSING_INVOICE").alias("exception_type"),
            F.concat(F.lit("Completed order "), F.col("order_id"), F.lit(" has no invoice"))
            .alias("description"),
        )
    )


def running_balance(bank: DataFrame) -> DataFrame:
    """Balance of each merchant's account after every bank record, in date order."""
    signed = F.when(F.col("transaction_type") == "DEBIT", -F.col("amount")).otherwise(
        F.col("amount"))
    return running_sum(
        bank, ["merchant_id"],
        [F.col("transaction_date").asc_nulls_first(), F.col("bank_record_id")],
        signed, "balance_after",
    )


def label_changes(log: DataFrame) -> DataFrame:
    """Exception labels of a change log; an amount change takes the sub-class of its cause."""
    classes = vocab.CHANGE_CLASSES
    kind, amount = F.col("type"), F.col("type") == "AMOUNT_NOISE"
    cause = F.when(F.col("cause").isin(list(vocab.AMOUNT_CAUSES)), F.col("cause")).otherwise(
        "UNKNOWN")

    def fixed(place: int) -> Column:
        return lookup({k: v[place] for k, v in classes.items()}, kind)

    return log.filter(kind.isin(list(classes))).select(
        F.concat(F.lit("EXC_"), F.substring(F.sha2(F.concat_ws(
            "|", "type", "record_id", "field"), 256), 1, 12)).alias("case_id"),
        F.when(amount, F.concat(F.lit("AMOUNT_DISCREPANCY__"), cause)).otherwise(fixed(0))
        .alias("exception_class"),
        F.when(amount, cause).alias("exception_subclass"),
        F.when(amount, lookup({k: v[0] for k, v in vocab.AMOUNT_CAUSES.items()}, cause))
        .otherwise(fixed(1)).alias("severity"),
        F.when(amount, lookup({k: v[1] for k, v in vocab.AMOUNT_CAUSES.items()}, cause))
        .otherwise(fixed(2)).alias("resolution_hint"),
        fixed(3).alias("requires_manual_review"),
        kind.alias("corruption_type"),
        F.col("record_id").alias("affected_entity_id"),
        F.col("field").alias("affected_field"),
        F.col("original").alias("original_value"),
        F.col("corrupted").alias("corrupted_value"),
    )
