"""Derived entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import derive
from ledgerloom.plans.catalog import query

_MONEY_ORDER = ("subtotal discount taxable_amount cgst sgst igst total_tax total_amount").split()


def _doubles(*names: str) -> str:
    return ", ".join(f"cast({n} as double) as {n}" for n in names)


def _day(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d') as {name}"


def _time(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') as {name}"


@query("order_projection", f"""
select order_id, merchant_id, customer_id, {_time('order_date')}, {_doubles(*_MONEY_ORDER)},
       currency, status, seller_state, buyer_state from t_orders""")
def order_projection(fx):
    return fx.build("orders")


@query("derived_fees", f"""
select fee_id, payment_id, merchant_id, fee_type,
       {_doubles('fee_amount', 'tax_amount', 'total_fee')}, currency, payment_method
from t_fees""")
def derived_fees(fx):
    return fx.build("fees")


@query("derived_invoices", f"""
select invoice_id, order_id, merchant_id, customer_id, invoice_number, {_time('invoice_date')},
       {_day('due_date')}, {_doubles(*_MONEY_ORDER)}, currency, seller_gstin, seller_state,
       buyer_state, status from t_invoices""")
def derived_invoices(fx):
    return fx.build("invoices")


@query("derived_gst", f"""
select gst_record_id, invoice_id, invoice_number, merchant_id, seller_gstin, buyer_gstin,
       supply_type, {_doubles(*_MONEY_ORDER[2:])}, filing_period, return_type, status
from t_gst_records""")
def derived_gst(fx):
    return fx.build("gst_records")


@query("derived_settlements", f"""
select settlement_id, merchant_id, {_time('settlement_date')},
       {_doubles('gross_amount', 'total_fees', 'total_fee_tax', 'total_refunds',
                 'total_adjustments', 'net_amount')}, currency, utr, status, payment_count
from t_settlements""")
def derived_settlements(fx):
    return fx.build("settlements")


@query("derived_settlement_links", f"""
select settlement_id, payment_id, {_doubles('allocated_amount')} from t_settlement_payments""")
def derived_settlement_links(fx):
    return fx.build("settlement_payments")


@query("payment_batch_numbers", """
select payment_id, merchant_id, batch, settlement_id from t_batches""")
def payment_batch_numbers(fx):
    return fx.build("batches").select("payment_id", "merchant_id", "batch", "settlement_id")


@query("derived_ledger", f"""
select entry_id, merchant_id, {_day('entry_date')}, account_code, account_name,
       {_doubles('debit', 'credit')}, reference_type, reference_id, description, entry_type,
       canonical_reference_id from t_books""")
def derived_ledger(fx):
    return fx.build("books")


@query("bank_record_projection", f"""
select bank_record_id, merchant_id, {_day('transaction_date')}, {_day('value_date')},
       {_doubles('amount')}, currency, transaction_type, reference, description, settlement_id,
       category from t_bank_records""")
def bank_record_projection(fx):
    return fx.build("bank_records")


@query("bank_running_balance", """
select bank_record_id, merchant_id, strftime(transaction_date, '%Y-%m-%d') as transaction_date,
       cast(sum(case when transaction_type = 'DEBIT' then -amount else amount end) over (
         partition by merchant_id order by transaction_date nulls first, bank_record_id
         rows between unbounded preceding and current row) as double) as balance_after
from t_bank_records""")
def bank_running_balance(fx):
    return derive.running_balance(fx.bank_records).select(
        "bank_record_id", "merchant_id", "transaction_date", "balance_after")


_EDGES = [
    ("t_invoices", "invoice", "invoice_id", "'order'", "order_id", "DERIVED_FROM"),
    ("t_payments", "payment", "payment_id", "'order'", "order_id", "PAYS_FOR"),
    ("t_fees", "fee", "fee_id", "'payment'", "payment_id", "CHARGED_ON"),
    ("t_refunds", "refund", "refund_id", "'payment'", "payment_id", "REFUNDS"),
    ("t_settlement_payments", "settlement", "settlement_id", "'payment'", "payment_id", "SETTLES"),
    ("(select * from t_bank_records where settlement_id is not null)", "bank_record",
     "bank_record_id", "'settlement'", "settlement_id", "CORRESPONDS_TO"),
    ("t_gst_records", "gst_record", "gst_record_id", "'invoice'", "invoice_id", "TAX_FOR"),
    ("t_books", "book_entry", "entry_id", "lower(reference_type)", "reference_id", "RECORDS"),
    ("t_adjustments", "adjustment", "adjustment_id", "'settlement'", "settlement_id", "ADJUSTS"),
]
EDGES_SQL = "\nunion all\n".join(
    f"select '{kind}' as source_type, {source} as source_id, {parent} as target_type, "
    f"{target} as target_id, '{relation}' as relationship, 'MATCH' as expected_status from {frm}"
    for frm, kind, source, parent, target, relation in _EDGES)


@query("truth_edges", EDGES_SQL)
def truth_edges(fx):
    return derive.truth_edges(fx.all())


@query("expected_matches", """
select 'ORDER_INVOICE' as pair_type, 'order' as source_type, order_id as source_id,
       'invoice' as target_type, invoice_id as target_id, 'MATCH' as expected_result,
       'total_amount,taxable_amount,total_tax' as match_fields from t_invoices
union all select 'ORDER_PAYMENT', 'order', order_id, 'payment', payment_id, 'MATCH',
       'total_amount' from t_payments where status = 'CAPTURED'
union all select 'SETTLEMENT_BANK', 'settlement', settlement_id, 'bank_record', bank_record_id,
       'MATCH', 'net_amount' from t_bank_records where settlement_id is not null
union all select 'INVOICE_GST', 'invoice', invoice_id, 'gst_record', gst_record_id, 'MATCH',
       'taxable_amount,total_tax,cgst,sgst,igst' from t_gst_records""")
def expected_matches(fx):
    out = derive.expected_matches(fx.invoices, fx.payments, fx.bank_records, fx.gst_records)
    return out.withColumn("match_fields", F.array_join("match_fields", ","))


@query("completed_orders_without_invoice", """
select 'order' as entity_type, order_id as entity_id, 'MISSING_INVOICE' as exception_type,
       'Completed order ' || order_id || ' has no invoice' as description
from t_orders where status = 'COMPLETED'
  and order_id not in (select order_id from t_invoices)""")
def completed_orders_without_invoice(fx):
    return derive.missing_invoices(fx.orders, fx.invoices)
