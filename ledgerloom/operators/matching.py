"""Deterministic matching rules as set-wise joins.

Every rule yields decision rows: which records were compared, the outcome, and why.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import vocab
from ledgerloom.functions.amounts import amounts_equal
from ledgerloom.functions.base import lookup
from ledgerloom.functions.dates import day_gap

DECISION = ["pair_type", "status", "rule", "reason", "matched_record_id", "source_record_id",
            "amount_difference", "date_difference", "reason_codes", "explanation_facts",
            "resolved"]


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def facts(**items: Column) -> Column:
    pairs = []
    for name, value in items.items():
        pairs += [F.lit(name), value.cast("string")]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def decision(pair: str, status: Column, rule: Column, reason: Column, matched: Column,
             source: Column, amount: Column, days: Column, codes: Column, known: Column,
             resolved: Column) -> list[Column]:
    values = [F.lit(pair), status, rule, reason, matched, source, amount.cast("double"),
              days.cast("int"), codes, known, resolved]
    return [v.alias(n) for v, n in zip(values, DECISION)]


def _codes(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names])


def linked_decision(pair: str, rule: str, linked: Column, amount_ok: Column, matched: Column,
                    source: Column, amount: Column | None = None, days: Column | None = None,
                    known: Column | None = None, missing: str | None = None) -> list[Column]:
    """Shared shape of all key-linked rules: linked and equal, linked and unequal, not linked."""
    good = linked & amount_ok
    amount = _none("double") if amount is None else amount
    days = _none("int") if days is None else days
    return decision(
        pair,
        F.when(good, vocab.MATCHED).when(linked, vocab.DISCREPANCY).otherwise(vocab.UNMATCHED),
        F.lit(rule),
        F.when(good, "Foreign key and amount rules satisfied.")
        .when(linked, "Records are linked but amounts (or tax) do not match.")
        .otherwise(missing or "Required identifier link is missing."),
        F.when(linked, matched), source,
        F.when(linked, amount.cast("double")), F.when(linked, days.cast("int")),
        F.when(good, _codes("FK_MATCH", "AMOUNT_OK"))
        .when(linked, _codes("FK_MATCH", "AMOUNT_DISCREPANCY"))
        .otherwise(_codes("MISSING_RECORD")),
        known if known is not None else facts(),
        linked,
    )


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def order_payment(payments: DataFrame, orders: DataFrame) -> DataFrame:
    """Each payment against its order."""
    o = _prefixed(orders.select("order_id", "total_amount", "order_date"), "o")
    both = payments.join(o, F.col("order_id") == F.col("o_order_id"), "left")
    linked = F.col("o_order_id").isNotNull()
    return both.select(*linked_decision(
        vocab.ORDER_PAYMENT, "ORDER_ID_AND_AMOUNT", linked,
        amounts_equal("amount", "o_total_amount"), F.col("payment_id"), F.col("payment_id"),
        F.col("amount") - F.col("o_total_amount"),
        day_gap(F.to_date("payment_date"), F.to_date("o_order_date")),
        facts(order_id=F.col("o_order_id"), payment_order_id=F.col("order_id")),
        "Linked order is missing.",
    ))


def payments_of_order(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Each order against all its payments, or one row saying there is none."""
    p = _prefixed(payments.select("payment_id", "order_id", "amount", "payment_date"), "p")
    both = orders.join(p, F.col("order_id") == F.col("p_order_id"), "left")
    linked = F.col("p_payment_id").isNotNull()
    return both.select(*linked_decision(
        vocab.ORDER_PAYMENT, "ORDER_ID_AND_AMOUNT", linked,
        amounts_equal("p_amount", "total_amount"), F.col("p_payment_id"), F.col("order_id"),
        F.col("p_amount") - F.col("total_amount"),
        day_gap(F.to_date("p_payment_date"), F.to_date("order_date")),
        facts(order_id=F.col("order_id"), payment_order_id=F.col("p_order_id")),
        "No payments for this order.",
    ))


def order_invoice(orders: DataFrame, invoices: DataFrame, source: str = "order_id") -> DataFrame:
    """Each invoice with an existing order against that order."""
    o = _prefixed(orders.select("order_id", "total_amount", "order_date"), "o")
    both = invoices.join(o, F.col("order_id") == F.col("o_order_id"), "inner")
    return both.select(*linked_decision(
        vocab.ORDER_INVOICE, "ORDER_ID_AND_AMOUNT", F.lit(True),
        amounts_equal("total_amount", "o_total_amount"), F.col("invoice_id"), F.col(source),
        F.col("total_amount") - F.col("o_total_amount"),
        day_gap(F.to_date("invoice_date"), F.to_date("o_order_date")),
        facts(order_id=F.col("o_order_id"), invoice_order_id=F.col("order_id")),
    ))


def payment_fee(payments: DataFrame, fees: DataFrame) -> DataFrame:
    f = _prefixed(fees.select("fee_id", "payment_id", "fee_amount"), "f")
    both = payments.join(f, F.col("payment_id") == F.col("f_payment_id"), "left")
    return both.select(*linked_decision(
        vocab.PAYMENT_FEE, "PAYMENT_ID_LINK", F.col("f_fee_id").isNotNull(), F.lit(True),
        F.col("f_fee_id"), F.col("payment_id"),
        known=facts(fee_amount=F.col("f_fee_amount").cast("double")),
        missing="No fee rows for this payment.",
    ))


def payment_refund(payments: DataFrame, refunds: DataFrame) -> DataFrame:
    r = _prefixed(refunds.select("refund_id", "payment_id", "refund_amount", "refund_date",
                                 "refund_type"), "r")
    both = payments.join(r, F.col("payment_id") == F.col("r_payment_id"), "inner")
    within = F.col("r_refund_amount") <= F.col("amount") + F.lit("0.01").cast("decimal(3,2)")
    return both.select(*linked_decision(
        vocab.PAYMENT_REFUND, "PAYMENT_ID_REFUND_LEQ_PAYMENT", F.lit(True),
        F.coalesce(within, F.lit(False)), F.col("r_refund_id"), F.col("payment_id"),
        F.col("r_refund_amount") - F.col("amount"),
        day_gap(F.to_date("r_refund_date"), F.to_date("payment_date")),
        facts(refund_type=F.col("r_refund_type")),
    ))


def payment_settlement(payments: DataFrame, links: DataFrame, settlements: DataFrame
                       ) -> DataFrame:
    """Each payment against its settlement links; an unknown allocation passes."""
    known = links.join(settlements.select("settlement_id"), "settlement_id", "left_semi")
    sp = _prefixed(known.select("settlement_id", "payment_id", "allocated_amount"), "l")
    both = payments.join(sp, F.col("payment_id") == F.col("l_payment_id"), "inner")
    same = amounts_equal("l_allocated_amount", "amount") | F.col("l_allocated_amount").isNull()
    return both.select(*linked_decision(
        vocab.PAYMENT_SETTLEMENT, "SETTLEMENT_PAYMENTS_LINK", F.lit(True), same,
        F.col("l_settlement_id"), F.col("payment_id"),
        F.col("l_allocated_amount") - F.col("amount"),
        known=facts(allocated_amount=F.col("l_allocated_amount").cast("double")),
    ))


def invoice_gst(invoices: DataFrame, gst: DataFrame) -> DataFrame:
    g = _prefixed(gst.select("gst_record_id", "invoice_id", "total_tax", "total_amount"), "g")
    both = invoices.join(g, F.col("invoice_id") == F.col("g_invoice_id"), "left")
    same = amounts_equal("g_total_tax", "total_tax") & amounts_equal("g_total_amount",
                                                                    "total_amount")
    return both.select(*linked_decision(
        vocab.INVOICE_GST, "INVOICE_ID_AND_TAX", F.col("g_gst_record_id").isNotNull(), same,
        F.col("g_gst_record_id"), F.col("invoice_id"),
        F.col("g_total_amount") - F.col("total_amount"),
        known=facts(invoice_total_tax=F.col("total_tax").cast("double"),
                    gst_total_tax=F.col("g_total_tax").cast("double")),
        missing="No GST record for this invoice.",
    ))


def settlement_adjustment(settlements: DataFrame, adjustments: DataFrame) -> DataFrame:
    a = _prefixed(adjustments.select("adjustment_id", "settlement_id", "amount",
                                     "adjustment_date", "adjustment_type"), "a")
    both = settlements.join(a, F.col("settlement_id") == F.col("a_settlement_id"), "inner")
    return both.select(*linked_decision(
        vocab.SETTLEMENT_ADJUSTMENT, "SETTLEMENT_ID_LINK", F.lit(True), F.lit(True),
        F.col("a_adjustment_id"), F.col("settlement_id"), F.col("a_amount"),
        day_gap(F.to_date("a_adjustment_date"), F.to_date("settlement_date")),
        facts(adjustment_type=F.col("a_adjustment_type")),
    ))


def totals_by_either_key(entries: DataFrame, key: str, other: str, *aggs: Column) -> DataFrame:
    """Aggregate per id where an entry counts when either of two columns holds the id.

    An OR between two columns would force a nested-loop join; listing each
    entry under both of its keys keeps it an equality, and an entry whose keys
    agree is listed once.
    """
    direct = entries.withColumn("_id", F.col(key))
    second = entries.filter(F.col(other).isNotNull() & ~F.col(other).eqNullSafe(F.col(key)))
    listed = direct.unionByName(second.withColumn("_id", F.col(other)))
    return listed.filter(F.col("_id").isNotNull()).groupBy("_id").agg(*aggs)


def event_books(ids: DataFrame, key: str, books: DataFrame) -> DataFrame:
    """Each record against the ledger entries that refer to it."""
    totals = totals_by_either_key(
        books, "reference_id", "canonical_reference_id",
        F.sum(F.coalesce("debit", F.lit(0))).alias("_debit"),
        F.sum(F.coalesce("credit", F.lit(0))).alias("_credit"),
        F.count(F.lit(1)).alias("_entries"), F.min("entry_id").alias("_entry"))
    both = ids.select(key).join(totals, F.col(key) == F.col("_id"), "left")
    found = F.col("_id").isNotNull()
    gap = F.col("_debit") - F.col("_credit")
    even = F.abs(gap) < F.lit("0.01").cast("decimal(3,2)")
    return both.select(*decision(
        vocab.EVENT_BOOKS,
        F.when(~found, vocab.UNMATCHED).when(even, vocab.MATCHED).otherwise(vocab.DISCREPANCY),
        F.when(found, "REFERENCE_ID_AND_DEBIT_CREDIT").otherwise("NO_LEDGER_ENTRIES"),
        F.when(found, "Ledger entries found; debit/credit compared.")
        .otherwise("No book entries reference this entity."),
        F.col("_entry"), F.col(key), gap, _none("int"),
        F.when(~found, _codes("MISSING_RECORD")).when(even, _codes("LEDGER_BALANCED"))
        .otherwise(_codes("LEDGER_IMBALANCE")),
        F.when(found, facts(debit_sum=F.col("_debit").cast("double"),
                            credit_sum=F.col("_credit").cast("double"),
                            entry_count=F.col("_entries"))).otherwise(facts()),
        found,
    ))


def expected_net() -> Column:
    zero = F.lit(0).cast("decimal(15,2)")
    parts = {c: F.coalesce(c, zero) for c in
             ("gross_amount", "total_fees", "total_fee_tax", "total_refunds",
              "total_adjustments")}
    return (parts["gross_amount"] - parts["total_fees"] - parts["total_fee_tax"]
            - parts["total_refunds"] + parts["total_adjustments"])


def settlement_arithmetic(settlements: DataFrame) -> DataFrame:
    """One row for every settlement whose net amount is not gross less its deductions."""
    expected = expected_net()
    gap = F.col("net_amount") - expected
    wrong = F.col("net_amount").isNull() | (F.abs(gap) >= F.lit("0.05").cast("decimal(3,2)"))
    return settlements.filter(wrong).select(*decision(
        vocab.SETTLEMENT_ARITHMETIC, F.lit(vocab.DISCREPANCY),
        F.lit("NET_EQUALS_GROSS_MINUS_FEES_TAX_REFUNDS_PLUS_ADJ"),
        F.lit("Settlement net amount does not equal the documented identity."),
        _none("string"), F.col("settlement_id"), gap, _none("int"), _codes("AMOUNT_DISCREPANCY"),
        facts(expected_net=expected.cast("double"), actual_net=F.col("net_amount").cast("double")),
        F.lit(True),
    ))


# --- rolling decisions up -------------------------------------------------------


def in_sequence(*stages: DataFrame) -> DataFrame:
    """Decisions of several rules with the order in which they were taken."""
    numbered = [
        s.withColumn("_seq", F.struct(F.lit(i).alias("stage"),
                                      F.coalesce("matched_record_id", F.lit("")).alias("id")))
        for i, s in enumerate(stages)
    ]
    return reduce(DataFrame.unionByName, numbered)


def worst_per_source(decisions: DataFrame) -> DataFrame:
    """Worst decision of each source record, the earliest of equals, with all reason codes.

    Codes are reduced to their first use before they are gathered, so a record
    with very many decisions still gathers no more than the code vocabulary.
    """
    rank = lookup(vocab.STATUS_RANK, F.col("status"))
    # A smaller key is worse; ties go to the earlier decision.
    key = F.struct((-rank).alias("rank"), F.col("_seq"))
    worst = decisions.groupBy("source_record_id").agg(
        F.min_by(F.struct(*DECISION), key).alias("_worst"),
        F.count(F.lit(1)).alias("decision_count"))
    firsts = (
        decisions.select("source_record_id", "_seq",
                         F.posexplode("reason_codes").alias("_pos", "_code"))
        .groupBy("source_record_id", "_code")
        .agg(F.min(F.struct("_seq", "_pos")).alias("_at"))
    )
    codes = firsts.groupBy("source_record_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_at", "_code"))),
                    lambda x: x["_code"]).alias("all_codes"))
    kept = [c for c in DECISION if c != "source_record_id"]
    return worst.join(codes, "source_record_id").select(
        "source_record_id", *[F.col(f"_worst.{c}").alias(c) for c in kept],
        "decision_count", "all_codes")


def status_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("pair_type", "rule", "status").agg(
        F.count(F.lit(1)).alias("decisions"),
        F.sum(F.coalesce(F.col("amount_difference").cast("decimal(18,2)"), F.lit(0)))
        .alias("amount_difference"))


# --- documented extras ------------------------------------------------------------


def settlement_allocation(links: DataFrame, settlements: DataFrame) -> DataFrame:
    """Allocated amounts per settlement against its gross amount."""
    sums = links.groupBy("settlement_id").agg(
        F.sum("allocated_amount").alias("allocated"), F.count(F.lit(1)).alias("payments"))
    both = settlements.select("settlement_id", "gross_amount").join(sums, "settlement_id", "left")
    return both.select(
        "settlement_id", "gross_amount", F.coalesce("allocated", F.lit(0)).alias("allocated"),
        F.coalesce("payments", F.lit(0)).alias("payments"),
        F.when(amounts_equal("allocated", "gross_amount"), vocab.MATCHED)
        .otherwise(vocab.DISCREPANCY).alias("status"))


def settlements_paid_twice(bank: DataFrame) -> DataFrame:
    """Settlements that more than one bank record claims."""
    return bank.filter(F.col("settlement_id").isNotNull()).groupBy("settlement_id").agg(
        F.count(F.lit(1)).alias("bank_records")).filter(F.col("bank_records") > 1)


def attribute_differences(linked: DataFrame, adjustments: DataFrame, payments_fees: DataFrame
                          ) -> DataFrame:
    """Explain each bank amount that differs from its settlement.

    ``linked`` holds bank_record_id, settlement_id and difference. Tried in
    order: an adjustment of that size, a fee of that size, rounding, unknown.
    """
    size = F.abs("difference")
    adj = adjustments.select("settlement_id", F.abs("amount").alias("_size")).distinct() \
        .withColumn("_adj", F.lit(True))
    fee = payments_fees.select("settlement_id", F.col("total_fee").alias("_size")).distinct() \
        .withColumn("_fee", F.lit(True))
    sized = linked.withColumn("_size", size)
    return (
        sized.join(adj, ["settlement_id", "_size"], "left")
        .join(fee, ["settlement_id", "_size"], "left")
        .select(*linked.columns, F.when(F.col("_adj"), "ADJUSTMENT")
                .when(F.col("_fee"), "FEE_ADJUSTMENT")
                .when(F.col("_size") < 1, "ROUNDING").otherwise("UNKNOWN").alias("cause"))
    )


def exact_reference_or_day(left: DataFrame, right: DataFrame) -> DataFrame:
    """First-tier extras between two payment feeds: equal gateway reference, else equal
    amount on the same day; a match counts only when it is unique on the right side.

    Both frames hold record_id, gateway_reference, amount, day. The right side
    is reduced to one row per key first, so repeated keys never multiply.
    """
    by_ref = right.filter(F.col("gateway_reference") != "").groupBy("gateway_reference").agg(
        F.count(F.lit(1)).alias("_ref_n"), F.min("record_id").alias("_ref_id"))
    by_day = right.groupBy("amount", "day").agg(
        F.count(F.lit(1)).alias("_day_n"), F.min("record_id").alias("_day_id"))
    both = left.join(by_ref, "gateway_reference", "left").join(by_day, ["amount", "day"], "left")
    rule = (F.when(F.col("_ref_n") == 1, "EXACT_GATEWAY_REFERENCE")
            .when(F.col("_ref_n") > 1, "AMBIGUOUS_GATEWAY_REFERENCE")
            .when(F.col("_day_n") == 1, "EXACT_AMOUNT_SAME_DAY")
            .when(F.col("_day_n") > 1, "AMBIGUOUS_AMOUNT_SAME_DAY").otherwise("NONE"))
    matched = F.when(F.col("_ref_n") == 1, F.col("_ref_id")).when(
        F.col("_ref_n").isNull() & (F.col("_day_n") == 1), F.col("_day_id"))
    return both.select("record_id", rule.alias("rule"), matched.alias("matched_record_id"))


# Pair type -> (share of amount, absolute amount, most days); null is untested.
TOLERANCES = {
    vocab.ORDER_PAYMENT: (None, "0.00", 0),
    vocab.ORDER_INVOICE: (None, "0.00", 1),
    vocab.SETTLEMENT_BANK: ("0.02", "100.00", 2),
    vocab.INVOICE_GST: (None, "0.00", None),
    "INVOICE_BOOKS": (None, "1.00", 1),
    "SETTLEMENT_BANK_BOOKS": (None, "1.00", 3),
}


def within_tolerance(pairs: DataFrame) -> DataFrame:
    """Judge pairs of (pair_type, left_amount, right_amount, days) by their context."""
    share = lookup({k: v[0] for k, v in TOLERANCES.items() if v[0]}, F.col("pair_type"))
    most = lookup({k: v[1] for k, v in TOLERANCES.items()}, F.col("pair_type"))
    span = lookup({k: v[2] for k, v in TOLERANCES.items() if v[2] is not None},
                  F.col("pair_type"))
    gap = F.abs(F.col("left_amount") - F.col("right_amount"))
    near = gap <= most.cast("decimal(15,2)")
    relative = F.coalesce(gap <= F.abs("right_amount") * share.cast("decimal(5,4)"), F.lit(False))
    return pairs.withColumns({
        "amount_ok": F.coalesce(near | relative, F.lit(False)),
        "days_ok": F.coalesce(F.col("days") <= span, span.isNull(), F.lit(False)),
    })


# Fixed values of the fuzzy tier.
FUZZY = {"id": 0.8, "text": 0.7, "amount": 0.05, "days": 3, "reference": 0.75}


def fuzzy_flags(features: DataFrame, text_similarity: Column, id_similarity: Column) -> DataFrame:
    """Which second-tier thresholds a candidate pair passes, and how many; an unknown value
    passes none."""
    tests = {
        "fuzzy_id": id_similarity > FUZZY["id"],
        "fuzzy_reference": F.col("utr_similarity") > FUZZY["reference"],
        "fuzzy_text": text_similarity > FUZZY["text"],
        "fuzzy_amount": F.col("relative_amount_difference") < FUZZY["amount"],
        "fuzzy_days": F.col("date_difference_days") <= FUZZY["days"],
    }
    flags = {k: F.coalesce(v, F.lit(False)).cast("int") for k, v in tests.items()}
    total = reduce(lambda a, b: a + b, flags.values())
    return features.withColumns({**flags, "fuzzy_passed": total})
