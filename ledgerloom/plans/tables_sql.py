"""The business tables of :mod:`ledgerloom.plans.fixtures` as ANSI SQL, for cross-checking.

Written independently of the DataFrame code; each entry may use the ones before it.
"""

from __future__ import annotations

import re


def pid(prefix: str, number: str) -> str:
    return (f"'{prefix}_' || lpad(cast({number} as varchar), "
            f"cast(greatest(6, length(cast({number} as varchar))) as integer), '0')")


def num(column: str) -> str:
    return f"cast(regexp_extract({column}, '([0-9]+)$', 1) as bigint)"


M = "decimal(15,2)"

TABLES: dict[str, str] = {}

TABLES["t_merchants"] = f"""
select {pid('MER', '(s_suppkey + 1)')} as merchant_id, s_name as merchant_name,
       '27AABC' || lpad(cast(s_suppkey as varchar), 7, '0') || 'Z1' as gstin,
       'ST' || cast(s_nationkey % 3 as varchar) as state, 'INR' as currency, 'ACTIVE' as status
from supplier"""

TABLES["t_customers"] = f"""
select {pid('CUS', '(c_custkey + 1)')} as customer_id,
       {pid('MER', '(c_custkey % (select count(*) from supplier) + 1)')} as merchant_id,
       c_name as name, 'c' || cast(c_custkey as varchar) || '@example.com' as email,
       'ST' || cast(c_nationkey % 3 as varchar) as state
from customer"""

TABLES["t_orders"] = f"""
select order_id, merchant_id, customer_id, order_date, taxable_amount as subtotal,
       cast(0 as {M}) as discount, taxable_amount,
       case when seller_state = buyer_state then half else cast(0 as {M}) end as cgst,
       case when seller_state = buyer_state then cast(total_tax - half as {M})
            else cast(0 as {M}) end as sgst,
       case when seller_state = buyer_state then cast(0 as {M}) else total_tax end as igst,
       total_tax, total_amount, 'INR' as currency, status, seller_state, buyer_state
from (
  select *, cast((cents - cents % 2) / cast(200 as double) as {M}) as half
  from (
    select *, cast(round(cast(total_tax as double) * 100) as bigint) as cents
    from (
      select *, cast(total_amount - taxable_amount as {M}) as total_tax
      from (
        select {pid('ORD', '(o_orderkey + 1)')} as order_id, c.merchant_id, c.customer_id,
               o_orderdate as order_date, cast(o_totalprice as {M}) as total_amount,
               cast(round(cast(cast(o_totalprice as {M}) as double) / 1.18::double, 2) as {M})
                 as taxable_amount,
               case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'PENDING'
                    else 'CANCELLED' end as status,
               m.state as seller_state, c.state as buyer_state
        from orders
        join t_customers c on c.customer_id = {pid('CUS', '(o_custkey + 1)')}
        join t_merchants m on m.merchant_id = c.merchant_id))))"""

TABLES["t_payments"] = f"""
select {pid('PAY', 'n')} as payment_id,
       case when n % 101 = 0 then {pid('ORD', '(n + 900000000)')} else order_id end as order_id,
       merchant_id, customer_id,
       case when n % 97 = 0 then cast(total_amount + 1.50 as {M}) else total_amount end as amount,
       currency,
       case n % 4 when 0 then 'UPI' when 1 then 'CARD' when 2 then 'NETBANKING'
            else 'WALLET' end as payment_method,
       case when n % 11 = 0 then 'FAILED' when n % 13 = 0 then 'PENDING' else 'CAPTURED' end
         as status,
       'gateway' as gateway,
       'pay_' || cast(case when n % 61 = 0 then n - 1 else n end as varchar) as gateway_reference,
       order_date + to_days(cast(n % 3 as integer)) + to_seconds(n % 86400) as payment_date
from (select *, {num('order_id')} as n from t_orders) where n % 53 <> 0"""

TABLES["t_fees"] = f"""
select {pid('FEE', 'n')} as fee_id, payment_id, merchant_id, 'PLATFORM_FEE' as fee_type,
       fee_amount, cast(round(fee_amount * 0.18, 2) as {M}) as tax_amount,
       cast(fee_amount + round(fee_amount * 0.18, 2) as {M}) as total_fee,
       'INR' as currency, payment_method
from (
  select *, cast(case when status <> 'CAPTURED' then 0
      when payment_method = 'UPI' then 0
      when payment_method = 'CARD' then least(greatest(round(amount * 0.0180, 2), 2), 5000)
      when payment_method = 'NETBANKING' then least(greatest(round(amount * 0.0150, 2), 5), 3000)
      else least(greatest(round(amount * 0.0200, 2), 1), 2000) end as {M}) as fee_amount
  from (select *, {num('payment_id')} as n from t_payments)) where n % 71 <> 0"""

TABLES["t_refunds"] = f"""
select {pid('REF', 'n')} as refund_id, payment_id, order_id, merchant_id,
       cast(case when n % 3 = 0 then amount else round(amount * 0.5, 2) end
            + case when n % 5 = 0 then 10 else 0 end as {M}) as refund_amount,
       case when n % 3 = 0 then 'FULL' else 'PARTIAL' end as refund_type,
       'PROCESSED' as status, payment_date + to_days(4) as refund_date, currency
from (select *, {num('payment_id')} as n from t_payments)
where status = 'CAPTURED' and n % 17 = 0"""

TABLES["t_batches"] = f"""
select payment_id, merchant_id, payment_date, amount, batch,
       {pid('STL', 'dense_rank() over (order by mer, merchant_id, batch)')} as settlement_id
from (
  select payment_id, merchant_id, payment_date, amount, {num('merchant_id')} as mer,
         cast(floor((row_number() over (partition by merchant_id
                     order by payment_date, payment_id) - 1) / 10) as bigint) as batch
  from t_payments where status = 'CAPTURED')"""

TABLES["t_settlements"] = f"""
select settlement_id, merchant_id, settlement_date, gross_amount, total_fees, total_fee_tax,
       total_refunds, cast(0 as {M}) as total_adjustments,
       cast(gross_amount - total_fees - total_fee_tax - total_refunds
            + case when n % 37 = 0 then 1 else 0 end as {M}) as net_amount,
       'INR' as currency,
       'UTIB' || lpad(cast(n * 7919 % 10000000000000 as varchar), 13, '0') as utr,
       'SETTLED' as status, payment_count
from (
  select settlement_id, b.merchant_id, {num('settlement_id')} as n,
         max(payment_date) + to_days(2) as settlement_date,
         cast(sum(amount) as {M}) as gross_amount,
         cast(coalesce(sum(f.fee_amount), 0) as {M}) as total_fees,
         cast(coalesce(sum(f.tax_amount), 0) as {M}) as total_fee_tax,
         cast(coalesce(sum(r.refunded), 0) as {M}) as total_refunds,
         cast(count(*) as integer) as payment_count
  from t_batches b
  left join t_fees f on f.payment_id = b.payment_id
  left join (select payment_id, sum(refund_amount) as refunded from t_refunds group by 1) r
    on r.payment_id = b.payment_id
  group by 1, 2)"""

TABLES["t_settlement_payments"] = f"""
select settlement_id, payment_id,
       case when n % 83 = 0 then null when n % 89 = 0 then cast(amount - 0.75 as {M})
            else amount end as allocated_amount
from (select *, {num('payment_id')} as n from t_batches)"""

TABLES["t_bank_records"] = f"""
select {pid('BNK', 'n')} as bank_record_id, merchant_id,
       case when n % 29 = 2 then null when n % 31 = 3 then d + 40
            else d + cast(n % 3 as integer) end as transaction_date,
       case when n % 29 = 2 then null when n % 31 = 3 then d + 40
            else d + cast(n % 3 as integer) end as value_date,
       case when n % 19 = 4 then cast(net_amount + 25 as {M}) else net_amount end as amount,
       currency, 'CREDIT' as transaction_type,
       case when n % 13 = 5 then null
            when n % 7 = 0 then lower(substr(utr, 1, 4)) || '-' || substr(utr, 5)
            when n % 11 = 3 then substr(utr, 1, length(utr) - 2) || 'X' || right(utr, 1)
            else utr end as reference,
       'NEFT SETTLEMENT ' || settlement_id as description,
       case when n % 23 <> 1 then settlement_id end as settlement_id, 'SETTLEMENT' as category
from (select *, {num('settlement_id')} as n, cast(settlement_date as date) as d
      from t_settlements) where n % 17 <> 0
union all
select {pid('BNK', '(n + 500000000000)')}, merchant_id, d + 1, d + 1,
       cast(round(net_amount * 0.25, 2) as {M}), currency,
       case when n % 2 = 0 then 'DEBIT' else 'CREDIT' end, 'REF' || cast(n as varchar),
       'BANK CHARGES', null, case when n % 3 = 0 then null else 'CHARGES' end
from (select *, {num('settlement_id')} as n, cast(settlement_date as date) as d
      from t_settlements) where n % 5 = 0"""

TABLES["t_adjustments"] = f"""
select {pid('ADJ', 'n')} as adjustment_id,
       case when n % 48 = 0 then {pid('STL', '(n + 900000000000)')} else settlement_id end
         as settlement_id,
       merchant_id,
       case when n % 24 = 0 then 'CHARGEBACK' when n % 36 = 0 then 'ROUNDING'
            else 'MANUAL_ADJUSTMENT' end as adjustment_type,
       cast(case when n % 24 = 0 then -40 else 1 end as {M}) as amount,
       case when n % 24 = 0 then 'DEBIT' else 'CREDIT' end as direction,
       settlement_date + to_days(1) as adjustment_date, currency, 'APPLIED' as status
from (select *, {num('settlement_id')} as n from t_settlements) where n % 12 = 0"""

TABLES["t_invoices"] = f"""
select {pid('INV', 'n')} as invoice_id, order_id, o.merchant_id, customer_id,
       'INV/' || cast(year(order_date) as varchar) || '/' || right(o.merchant_id, 3) || '/'
         || regexp_extract(order_id, '([0-9]+)$', 1) as invoice_number,
       order_date as invoice_date, cast(order_date as date) + 30 as due_date,
       subtotal, discount, taxable_amount, cgst, sgst, igst, total_tax,
       case when n % 47 = 0 then cast(total_amount + 0.50 as {M}) else total_amount end
         as total_amount,
       o.currency, m.gstin as seller_gstin, seller_state, buyer_state, 'ISSUED' as status
from (select *, {num('order_id')} as n from t_orders) o
join t_merchants m on m.merchant_id = o.merchant_id
where o.status = 'COMPLETED' and n % 43 <> 0"""

TABLES["t_gst_records"] = f"""
select {pid('GST', 'n')} as gst_record_id, invoice_id, invoice_number, merchant_id, seller_gstin,
       cast(null as varchar) as buyer_gstin,
       case when seller_state = buyer_state then 'INTRA_STATE' else 'INTER_STATE' end
         as supply_type,
       taxable_amount, cgst, sgst, igst,
       case when n % 31 = 0 then cast(total_tax + 0.10 as {M}) else total_tax end as total_tax,
       total_amount, strftime(invoice_date, '%m-%Y') as filing_period,
       'GSTR-1' as return_type, 'FILED' as status
from (select *, {num('invoice_id')} as n from t_invoices) where n % 59 <> 0"""


def _posting(kind: int, line: int, frm: str, ref: str, on: str, code: str, name: str,
             debit: str, credit: str, ref_type: str, label: str, entry: str,
             where: str = "true") -> str:
    number = f"({num(ref)} * 100 + {kind * 10 + line})"
    return f"""select {pid('LED', number)} as entry_id, merchant_id, {on} as entry_date,
       {code} as account_code, {name} as account_name, cast({debit} as {M}) as debit,
       cast({credit} as {M}) as credit, '{ref_type}' as reference_type, {ref} as ref,
       '{label}' || {ref} as description, '{entry}' as entry_type, {line} as line
from {frm} where {where}"""


_SALE = ("t_orders", "order_id", "cast(order_date as date)")
_PAY = ("t_payments", "payment_id", "cast(payment_date as date)")
_FEE = ("(select f.*, p.payment_date from t_fees f left join t_payments p using (payment_id))",
        "fee_id", "coalesce(cast(payment_date as date), date '2026-08-15')")
_REF = ("t_refunds", "refund_id", "cast(refund_date as date)")
_STL = ("t_settlements", "settlement_id", "cast(settlement_date as date)")
_ADJ = ("t_adjustments", "adjustment_id", "cast(adjustment_date as date)")
_DONE, _CAP, _PAID = "status = 'COMPLETED'", "status = 'CAPTURED'", "fee_amount > 0"

POSTINGS = [
    _posting(1, 1, *_SALE, "'1200'", "'Accounts Receivable'", "total_amount", "0", "ORDER",
             "Sale - ", "SALE", _DONE),
    _posting(1, 2, *_SALE, "'4000'", "'Revenue'", "0", "taxable_amount", "ORDER",
             "Revenue - ", "SALE", _DONE),
    _posting(1, 3, *_SALE, "'2101'", "'CGST Payable'", "0", "cgst", "ORDER",
             "CGST on ", "TAX", _DONE + " and cgst > 0"),
    _posting(1, 4, *_SALE, "'2102'", "'SGST Payable'", "0", "sgst", "ORDER",
             "SGST on ", "TAX", _DONE + " and sgst > 0"),
    _posting(1, 5, *_SALE, "'2103'", "'IGST Payable'", "0", "igst", "ORDER",
             "IGST on ", "TAX", _DONE + " and igst > 0"),
    _posting(2, 1, *_PAY, "'1210'", "'Gateway Receivable'", "amount", "0", "PAYMENT",
             "Payment received - ", "PAYMENT", _CAP),
    _posting(2, 2, *_PAY, "'1200'", "'Accounts Receivable'", "0", "amount", "PAYMENT",
             "AR cleared - ", "PAYMENT", _CAP),
    _posting(3, 1, *_FEE, "'5100'", "'Payment Processing Fee'", "fee_amount", "0", "FEE",
             "Gateway fee - ", "FEE", _PAID),
    _posting(3, 2, *_FEE, "'1300'", "'GST Input Credit (Fees)'", "tax_amount", "0", "FEE",
             "Fee GST input - ", "FEE", _PAID + " and tax_amount > 0"),
    _posting(3, 3, *_FEE, "'1210'", "'Gateway Receivable'", "0", "fee_amount + tax_amount", "FEE",
             "Fee deducted - ", "FEE", _PAID),
    _posting(4, 1, *_REF, "'5200'", "'Refund Expense'", "refund_amount", "0", "REFUND",
             "Refund - ", "REFUND"),
    _posting(4, 2, *_REF, "'1210'", "'Gateway Receivable'", "0", "refund_amount", "REFUND",
             "Refund via gateway - ", "REFUND"),
    _posting(5, 1, *_STL, "'1100'", "'Bank Account'", "net_amount", "0", "SETTLEMENT",
             "Settlement received - ", "SETTLEMENT"),
    _posting(5, 2, *_STL, "'1210'", "'Gateway Receivable'", "0", "net_amount", "SETTLEMENT",
             "Gateway settled - ", "SETTLEMENT"),
    _posting(6, 1, *_ADJ, "case when amount >= 0 then '1210' else '5300' end",
             "case when amount >= 0 then 'Gateway Receivable' else 'Adjustment Expense' end",
             "abs(amount)", "0", "ADJUSTMENT", "Adjustment - ", "ADJUSTMENT"),
    _posting(6, 2, *_ADJ, "case when amount >= 0 then '4100' else '1210' end",
             "case when amount >= 0 then 'Adjustment Income' else 'Gateway Receivable' end",
             "0", "abs(amount)", "ADJUSTMENT", "Adjustment - ", "ADJUSTMENT"),
]

TABLES["t_postings"] = "\nunion all\n".join(POSTINGS)

TABLES["t_books"] = f"""
select entry_id, merchant_id, entry_date, account_code, account_name, debit, credit,
       reference_type, case when n % 19 = 0 then replace(ref, '_', '-') else ref end
         as reference_id, description, entry_type, ref as canonical_reference_id
from (select *, {num('ref')} as n from t_postings)
where not (n % 41 = 0 and line = 2)"""


def _turn(step: int, *choices: str) -> str:
    arms = " ".join(f"when {i} then {c}" for i, c in enumerate(choices))
    return f"case n % {step} {arms} end"


TABLES["t_raw_bank"] = f"""
select n + 1 as row_number,
  {_turn(8, "'BNK_' || g", "'BNK-' || g", "'bnk/' || g", "'BANK' || g", "'b_' || g",
         "'BNK_' || g", "' BNK' || g || ' '", "'bank-' || g")} as bank_record_id,
  case when n % 67 = 0 then 'XX-' || g when n % 71 = 0 then null
       else {pid('MER', '(user_id % 50 + 1)')} end as merchant_id,
  {_turn(9, "a", "'₹' || a", "'Rs. ' || a", "'INR ' || a", "'$' || a", "'usd ' || a",
         "'-' || a", "case when n % 4 = 0 then a || 'O' else a end",
         "case when n % 5 = 0 then 'n/a' else '1,' || a end")} as amount,
  {_turn(8, "i", "strftime(ts, '%d/%m/%Y')", "strftime(ts, '%d-%m-%Y')",
         "i || 'T' || c || '+05:30'", "i || ' ' || c", "i || 'T' || c",
         "case when n % 3 = 0 then 'not a date' else i end",
         "i || 'T' || c || '+00:00'")} as transaction_date,
  {_turn(7, "'INR'", "'inr'", "'Rs.'", "'usd'", "'₹'", "''", "'doge'")} as currency,
  {_turn(5, "'credit'", "'CREDIT'", "'debit'", "'Credit'", "'refund'")} as transaction_type,
  case when n % 6 = 0 then null else 'utib ' || cast(n % 4000 as varchar) end as reference,
  {_turn(4, "'NEFT-CR ' || event_type", "'upi/' || event_type || '/x'",
         "'  Card, ' || event_type || '; fee '", "event_type")} as description,
  'feed_' || cast(n % 4 as varchar) || '.jsonl' as file
from (select event_id as n, ts, user_id, event_type,
             lpad(cast(event_id as varchar),
               cast(greatest(6, length(cast(event_id as varchar))) as integer), '0') as g,
             cast(cast(value as {M}) as varchar) as a, strftime(ts, '%Y-%m-%d') as i,
             strftime(ts, '%H:%M:%S') as c
      from events)"""


def with_tables(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with every table it uses, directly or through another table."""
    known = {**TABLES, **(extra or {})}
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(known[name])

    visit(sql)
    if not needed:
        return sql
    parts = [f"{name} as ({body})" for name, body in known.items() if name in needed]
    own = re.match(r"\s*with\s", sql)
    return "with " + ",\n".join(parts) + (",\n" + sql[own.end():] if own else "\n" + sql)
