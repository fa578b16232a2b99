"""Dashboard figures, listings and dossiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import reports
from ledgerloom.plans.catalog import query
from ledgerloom.sources import tables


@query("reconciliation_totals", """
select count(*) as total, count(settlement_id) as reconciled,
       count(*) - count(settlement_id) as unreconciled,
       cast(coalesce(sum(amount) filter (settlement_id is null and transaction_type = 'CREDIT'),
            0) as double) as total_discrepancy_amount,
       round(count(settlement_id) * 100.0::double / count(*), 2) as rate
from t_bank_records""")
def reconciliation_totals(fx):
    return reports.reconciliation_totals(fx.bank_records)


@query("bank_category_breakdown", """
select coalesce(category, 'UNKNOWN') as category, count(*) as row_count,
       count(*) / cast((select count(*) from t_bank_records) as double) as share
from t_bank_records group by 1""")
def bank_category_breakdown(fx):
    return reports.breakdown(fx.bank_records, "category")


@query("payment_status_breakdown", """
select status, count(*) as row_count,
       count(*) / cast((select count(*) from t_payments) as double) as share
from t_payments group by 1""")
def payment_status_breakdown(fx):
    return reports.breakdown(fx.payments, "status")


@query("settlement_totals", """
select count(*) as settlements, cast(sum(gross_amount) as double) as gross_amount,
       cast(sum(net_amount) as double) as net_amount, cast(sum(total_fees) as double) as total_fees
from t_settlements""")
def settlement_totals(fx):
    return reports.settlement_totals(fx.settlements)


@query("recent_bank_records", """
select bank_record_id, merchant_id, strftime(transaction_date, '%Y-%m-%d') as transaction_date,
       cast(amount as double) as amount, transaction_type, category,
       cast(settlement_id is not null as bigint) as reconciled
from t_bank_records order by transaction_date is null desc, t_bank_records.transaction_date desc,
  bank_record_id desc limit 10""")
def recent_bank_records(fx):
    return reports.recent_records(fx.bank_records)


@query("unmatched_bank_records", """
select bank_record_id, merchant_id, cast(amount as double) as amount from t_bank_records
where settlement_id is null""")
def unmatched_bank_records(fx):
    return reports.unmatched_bank(fx.bank_records).select("bank_record_id", "merchant_id",
                                                          "amount")


@query("unmatched_payments", """
select payment_id, status from t_payments
where payment_id not in (select payment_id from t_settlement_payments)""")
def unmatched_payments(fx):
    return reports.unmatched_payments(fx.payments, fx.settlement_payments).select(
        "payment_id", "status")


@query("unmatched_listing", """
select source_type, id, strftime(d, '%Y-%m-%d %H:%M:%S') as date from (
  select 'bank_record' as source_type, bank_record_id as id,
         cast(transaction_date as timestamp) as d
  from t_bank_records where settlement_id is null
  union all select 'payment', payment_id, payment_date from t_payments
  where payment_id not in (select payment_id from t_settlement_payments))
order by d is null desc, d desc, id limit 10""")
def unmatched_listing(fx):
    return reports.unmatched_listing(fx.bank_records, fx.payments, fx.settlement_payments)


@query("open_item_summary", """
select (select count(*) from t_bank_records where settlement_id is null)
         as unmatched_bank_records,
       (select count(*) from t_bank_records) as total_bank_records,
       (select count(*) from t_payments) as total_payments,
       (select count(*) from t_payments where payment_id not in
          (select payment_id from t_settlement_payments)) as unmatched_payments""")
def open_item_summary(fx):
    return reports.open_item_summary(fx.bank_records, fx.payments, fx.settlement_payments)


@query("dashboard_table_counts", "\nunion all\n".join(
    f"select '{t}' as table_name, count(*) as row_count from t_{t}"
    for t in ("bank_records", "payments", "settlements", "orders", "invoices", "refunds")))
def dashboard_table_counts(fx):
    names = ["bank_records", "payments", "settlements", "orders", "invoices", "refunds"]
    return tables.row_counts({n: getattr(fx, n) for n in names})


PAYMENT_PARTS = """
select payment_id, 'payment' as part, payment_id as part_id from t_payments
union all select p.payment_id, 'order', o.order_id from t_payments p
  join t_orders o on o.order_id = p.order_id
union all select payment_id, 'fee', fee_id from t_fees
union all select payment_id, 'refund', refund_id from t_refunds
union all select payment_id, 'settlement_link', settlement_id from t_settlement_payments"""


@query("payment_dossiers", PAYMENT_PARTS)
def payment_dossiers(fx):
    return reports.payment_dossier(fx.all()).drop("record")


@query("payment_dossiers_nested", f"""
select payment_id, page, min(part_count) as part_count,
       string_agg(part || ':' || part_id, ',' order by part, part_id) as parts
from (select *, count(*) over (partition by payment_id) as part_count,
             (row_number() over (partition by payment_id order by part, part_id) - 1) // 2 as page
      from ({PAYMENT_PARTS})) group by 1, 2""")
def payment_dossiers_nested(fx):
    """Pages of two parts, so that most payments have several."""
    nested = reports.nested_dossiers(reports.payment_dossier(fx.all()), "payment_id", page_size=2)
    named = F.transform("parts", lambda p: F.concat(p["part"], F.lit(":"), p["part_id"]))
    return nested.select("payment_id", "page", "part_count",
                         F.array_join(named, ",").alias("parts"))


@query("settlement_dossiers", """
select settlement_id, 'settlement' as part, settlement_id as part_id from t_settlements
union all select settlement_id, 'adjustment', adjustment_id from t_adjustments
union all select l.settlement_id, 'payment', p.payment_id from t_settlement_payments l
  join t_payments p on p.payment_id = l.payment_id""")
def settlement_dossiers(fx):
    return reports.settlement_dossier(fx.all()).drop("record")
