"""Integrity audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import vocab
from ledgerloom.operators import audit, derive
from ledgerloom.operators.derive import id_number
from ledgerloom.plans.catalog import query
from ledgerloom.plans.queries_derive import EDGES_SQL
from ledgerloom.plans.tables_sql import num
from ledgerloom.sources import tables

KEYS = vocab.PRIMARY_KEYS

UNIQUE_SQL = "\nunion all\n".join(
    f"select '{t}' as table_name, '{c}' as column_name, count(*) as duplicates from (select {c} "
    f"from t_{t} where {c} is not null group by 1 having count(*) > 1)"
    for t, c in [*audit.UNIQUE, ("payments", "gateway_reference")])
ORPHAN_SQL = "\nunion all\n".join(
    f"select '{c}' as child_table, '{k}' as column_name, '{p}' as parent_table, "
    f"count(*) as orphans, coalesce((select string_agg(x, ',' order by x) from (select distinct "
    f"c.{k} as x from t_{c} c where c.{k} is not null and c.{k} not in (select {KEYS[p]} from "
    f"t_{p}) order by 1 limit 10)), '') as sample_ids from t_{c} c left join t_{p} p "
    f"on p.{KEYS[p]} = c.{k} where c.{k} is not null and p.{KEYS[p]} is null"
    for c, k, p in vocab.FOREIGN_KEYS)
NULL_SQL = "\nunion all\n".join(
    f"select '{t}' as table_name, '{c}' as column_name, count(*) filter ({c} is null) as nulls "
    f"from t_{t}" for t, cols in audit.REQUIRED.items() for c in cols)
IDENTITY = ("gross_amount - total_fees - total_fee_tax - total_refunds + total_adjustments")
GAPS_SQL = f"""
select 'invoice' as identity, count(*) as failures,
       cast(coalesce(sum(gap), 0) as double) as total_difference,
       cast(coalesce(max(gap), 0) as double) as largest
from (select abs(taxable_amount + cgst + sgst + igst - total_amount) as gap from t_invoices)
where gap > 0.005
union all
select 'settlement', count(*), cast(coalesce(sum(gap), 0) as double),
       cast(coalesce(max(gap), 0) as double)
from (select abs({IDENTITY} - net_amount) as gap from t_settlements) where gap > 0.01"""


@query("audit_expected_tables", "\nunion all\n".join(
    f"select '{t}' as table_name, {int(t != 'books')} as present" for t in sorted(audit.REQUIRED)))
def audit_expected_tables(fx):
    present = [t for t in fx.all() if t != "books"]
    return audit.expected_tables(fx.spark, present)


# The entity tables of the reference feed, each with one key column.
ENTITIES = ["merchants", "customers", "orders", "invoices", "gst_records", "payments", "fees",
            "refunds", "settlements", "bank_records", "books", "adjustments"]
_DEAD = {"orders": "CANCELLED", "payments": "FAILED"}
DRIFT_SQL = "\nunion all\n".join(
    f"select '{t}' as table_name, count(*) as raw_count, count(*) filter ({ok}) as "
    f"normalized_count, count(*) filter ({ok} and {live}) as loaded_count, "
    f"count(*) filter ({ok} and not {live}) as lost from t_{t}"
    for t in ENTITIES
    for ok in [" and ".join(f"{c} is not null" for c in audit.REQUIRED[t])]
    for live in [f"(status <> '{_DEAD[t]}')" if t in _DEAD else "true"])


def _drift(fx):
    """Rows as they come, those with every required field, and of these the live ones."""
    whole = {t: getattr(fx, t) for t in ENTITIES}
    filled = {t: df.dropna(subset=audit.REQUIRED[t]) for t, df in whole.items()}
    live = {t: df.filter(F.col("status") != _DEAD[t]) if t in _DEAD else df
            for t, df in filled.items()}
    return audit.row_count_drift(*map(tables.row_counts, (whole, filled, live)))


@query("audit_row_counts", DRIFT_SQL)
def audit_row_counts(fx):
    return _drift(fx)


@query("audit_unique_keys", UNIQUE_SQL)
def audit_unique_keys(fx):
    return audit.unique_violations(fx.all(), [*audit.UNIQUE, ("payments", "gateway_reference")])


@query("audit_orphans", ORPHAN_SQL)
def audit_orphans(fx):
    return audit.orphan_counts(fx.all())


@query("audit_required_columns", NULL_SQL)
def audit_required_columns(fx):
    return audit.null_counts(fx.all())


@query("audit_arithmetic", GAPS_SQL)
def audit_arithmetic(fx):
    return audit.arithmetic_gaps(fx.invoices, fx.settlements)


@query("audit_ledger_totals", """
select cast(sum(debit) as double) as debit, cast(sum(credit) as double) as credit,
       cast(abs(sum(debit) - sum(credit)) as double) as difference,
       count(*) filter (debit > 0 and credit > 0) as two_sided from t_books""")
def audit_ledger_totals(fx):
    return audit.ledger_totals(fx.books)


def _unbalanced(key: str) -> str:
    return f"""
select {key}, cast(sum(debit) as double) as debit, cast(sum(credit) as double) as credit,
       cast(abs(sum(debit) - sum(credit)) as double) as difference
from t_books group by 1 having abs(sum(debit) - sum(credit)) > 0.01"""


@query("audit_unbalanced_references", _unbalanced("reference_id"))
def audit_unbalanced_references(fx):
    return audit.unbalanced(fx.books, "reference_id")


@query("audit_unbalanced_merchants", _unbalanced("merchant_id"))
def audit_unbalanced_merchants(fx):
    return audit.unbalanced(fx.books, "merchant_id")


_RELATIONS = [("merchants-customers", "t_merchants", "t_customers", "merchant_id"),
              ("orders-invoices", "t_orders", "t_invoices", "order_id"),
              ("orders-payments", "t_orders", "t_payments", "order_id"),
              ("invoices-gst", "t_invoices", "t_gst_records", "invoice_id")]


@query("audit_cardinalities", "\nunion all\n".join(
    f"select '{r}' as relation, avg(n) as average, min(n) as least, max(n) as most, "
    f"count(*) filter (n > 1) as with_several, (select count(*) from {p} where {k} not in "
    f"(select {k} from {c})) as without_children from (select {k}, count(*) as n from {c} "
    f"group by 1)" for r, p, c, k in _RELATIONS))
def audit_cardinalities(fx):
    return audit.cardinalities(fx.all())


@query("audit_links", """
select 'orphan_settlement' as problem, count(*) filter (settlement_id not in
         (select settlement_id from t_settlements)) as failures from t_settlement_payments
union all select 'orphan_payment', count(*) filter (payment_id not in
         (select payment_id from t_payments)) from t_settlement_payments
union all select 'duplicate_pair', count(*) from (select 1 from t_settlement_payments
         group by settlement_id, payment_id having count(*) > 1)
union all select 'bad_allocation', count(*) filter (allocated_amount is null
         or allocated_amount < 0) from t_settlement_payments""")
def audit_links(fx):
    return audit.link_problems(fx.settlement_payments, fx.settlements, fx.payments)


@query("audit_largest_bank_gaps", """
select bank_record_id, cast(amount as double) as amount, cast(net_amount as double) as net_amount,
       cast(abs(amount - net_amount) as double) as difference
from t_bank_records b join t_settlements s on s.settlement_id = b.settlement_id
order by 4 desc, 1 limit 20""")
def audit_largest_bank_gaps(fx):
    return audit.largest_bank_gaps(fx.bank_records, fx.settlements)


@query("audit_tax_gaps", """
select count(*) as rows_off, count(*) filter (abs(i.taxable_amount - g.taxable_amount) > 0.01)
         as taxable_amount_off,
       count(*) filter (abs(i.cgst - g.cgst) > 0.01) as cgst_off,
       count(*) filter (abs(i.sgst - g.sgst) > 0.01) as sgst_off,
       count(*) filter (abs(i.igst - g.igst) > 0.01) as igst_off,
       count(*) filter (abs(i.total_tax - g.total_tax) > 0.01) as total_tax_off
from t_invoices i join t_gst_records g on g.invoice_id = i.invoice_id
where abs(i.taxable_amount - g.taxable_amount) > 0.01 or abs(i.cgst - g.cgst) > 0.01
   or abs(i.sgst - g.sgst) > 0.01 or abs(i.total_tax - g.total_tax) > 0.01""")
def audit_tax_gaps(fx):
    return audit.tax_gaps(fx.invoices, fx.gst_records)


@query("audit_payment_orders", """
select count(*) filter (p.merchant_id <> o.merchant_id) as merchant_id_mismatch,
       count(*) filter (p.customer_id <> o.customer_id) as customer_id_mismatch,
       count(*) filter (p.currency <> o.currency) as currency_mismatch,
       count(*) filter (o.order_id is null) as orphan_payments
from t_payments p left join t_orders o on o.order_id = p.order_id""")
def audit_payment_orders(fx):
    return audit.payment_order_mismatches(fx.payments, fx.orders)


@query("audit_over_refunds", """
select (select count(*) from t_refunds r join t_payments p using (payment_id)
        where r.refund_amount > p.amount) as single,
       (select count(*) from (select payment_id, sum(refund_amount) as s from t_refunds group by 1)
        join t_payments using (payment_id) where s > amount) as cumulative""")
def audit_over_refunds(fx):
    return audit.over_refunds(fx.refunds, fx.payments)


def _with_lineage(df, key: str):
    n = id_number(key)
    return df.withColumns({
        "lineage_source": F.when(n % 7 != 0, F.lit("FEED")),
        "lineage_source_record_id": F.when(n % 40 == 0, F.lit("SAME")).otherwise(F.col(key)),
        "lineage_ingested_at": F.when(n % 3 != 0, F.lit("2026-01-01")),
        "lineage_normalizer_ver": F.when(n % 20 != 0, F.lit("1.0")),
    })


def _lineage_sql(table: str, key: str) -> str:
    return (f"select '{table}' as table_name, case when n % 7 <> 0 then 'FEED' end as source, "
            f"case when n % 40 = 0 then 'SAME' else id end as record, "
            f"case when n % 3 <> 0 then 1 end as ingested, case when n % 20 <> 0 then 1 end as ver "
            f"from (select {key} as id, {num(key)} as n from t_{table})")


_LINEAGE = "\nunion all\n".join(_lineage_sql(t, KEYS[t]) for t in ENTITIES)


def _lineage_tables(fx):
    return {t: _with_lineage(getattr(fx, t), KEYS[t]) for t in ENTITIES}


SOURCE_DUPLICATES_SQL = f"""
select table_name, count(*) filter (n > 1) as duplicates from (
  select table_name, source, record, count(*) as n from ({_LINEAGE})
  where source is not null and record is not null group by 1, 2, 3) group by 1"""
COVERAGE_SQL = f"""
select table_name, round(100.0::double * count(source) / count(*), 2) as source_percent,
       round(100.0::double * count(record) / count(*), 2) as record_percent,
       round(100.0::double * count(ingested) / count(*), 2) as ingested_percent,
       round(100.0::double * count(ver) / count(*), 2) as version_percent,
       case when round(100.0::double * count(source) / count(*), 2) < 90 then 'WARN' else 'PASS' end
         as status
from ({_LINEAGE}) group by 1"""


@query("audit_source_duplicates", SOURCE_DUPLICATES_SQL)
def audit_source_duplicates(fx):
    return audit.source_duplicates(_lineage_tables(fx))


@query("audit_lineage_coverage", COVERAGE_SQL)
def audit_lineage_coverage(fx):
    return audit.lineage_coverage(_lineage_tables(fx))


def _seen(fx):
    return tables.seen_map(fx.raw("events").select(
        F.lit("FEED").alias("source"), F.col("event_id").cast("string").alias("source_record_id"),
        F.col("event_type").alias("entity_type")))


@query("audit_source_map", """
select event_type as entity_type, count(*) as row_count from events group by 1""")
def audit_source_map(fx):
    return audit.by_group(_seen(fx), "entity_type")


@query("audit_quarantine_groups")
def audit_quarantine_groups(fx):
    from ledgerloom.plans.queries_ingest import _batch

    return audit.by_group(_batch(fx).quarantine, "error_type", "source", "failed_field")


_TRUTH = {"order": "orders", "payment": "payments", "settlement": "settlements",
          "invoice": "invoices"}


@query("audit_truth_gaps", "\nunion all\n".join(
    f"select '{k}' as record_type, count(distinct target_id) as missing from ({EDGES_SQL}) "
    f"where target_type = '{k}' and target_id not in (select {KEYS[t]} from t_{t})"
    for k, t in _TRUTH.items()))
def audit_truth_gaps(fx):
    return audit.truth_gaps(derive.truth_edges(fx.all()), fx.all(), _TRUTH)


@query("audit_schema_findings", """
select 'bank_records' as table_name, 'expected_status' as column_name,
       'TRUTH_COLUMN' as finding where (select count(*) from t_bank_records) >= 0
union all select 'bank_records', 'amount', 'FLOAT_MONEY'""")
def audit_schema_findings(fx):
    leaky = fx.bank_records.withColumns({"expected_status": F.lit("MATCH"),
                                         "amount": F.col("amount").cast("double")})
    return audit.schema_findings(fx.spark, {**fx.all(), "bank_records": leaky})


@query("audit_natural_keys", "\nunion all\n".join(
    f"select '{t}' as table_name, '{c}' as column_name, count(*) as row_count, count({c}) as "
    f"filled, round(100.0::double * count({c}) / count(*), 2) as percent from t_{t}"
    for t, c in audit.NATURAL_KEYS))
def audit_natural_keys(fx):
    return audit.key_fill(fx.all())


@query("audit_invariants", f"""
select 'order_total' as invariant, count(*) filter (total_amount <> taxable_amount + total_tax)
         as failures from t_orders
union all select 'invoice_order', count(*) from t_invoices i join t_orders o using (order_id)
  where i.total_amount <> o.total_amount
union all select 'payment_order', count(*) from t_payments p join t_orders o using (order_id)
  where p.status = 'CAPTURED' and p.amount <> o.total_amount
union all select 'fee_tax', count(*) filter (tax_amount <> round(fee_amount * 0.18, 2)) from t_fees
union all select 'settlement_net', count(*) filter (net_amount <> {IDENTITY}) from t_settlements
union all select 'bank_settlement', count(*) from t_bank_records b
  join t_settlements s using (settlement_id) where b.amount <> s.net_amount
union all select 'gst_parts', count(*) filter (total_tax <> cgst + sgst + igst) from t_gst_records
union all select 'merchant_ledger', count(*) from (select merchant_id from t_books group by 1
  having abs(sum(debit) - sum(credit)) >= 0.01)""")
def audit_invariants(fx):
    return audit.invariants(fx.all())


REPORT_SQL = f"""
with f as (
  select 3 as num, 'PK/Unique Integrity' as name, 'FAIL' as bad, 'CRITICAL' as grave,
         sum(duplicates) as n from ({UNIQUE_SQL.rsplit('union all', 1)[0]})
  union all select 4, 'FK/Orphan Checks', 'FAIL',
         case when sum(orphans) filter (column_name in ('merchant_id', 'order_id', 'payment_id',
           'invoice_id')) > 0 then 'CRITICAL' else 'HIGH' end, sum(orphans) from ({ORPHAN_SQL})
  union all select 5, 'NULL/Required Field Checks', 'FAIL', 'HIGH', sum(nulls) from ({NULL_SQL})
  union all select 6, 'Invoice Arithmetic', 'FAIL', 'HIGH', failures from ({GAPS_SQL})
         where identity = 'invoice'
  union all select 6, 'Settlement Arithmetic', 'FAIL', 'MEDIUM', failures from ({GAPS_SQL})
         where identity = 'settlement'
  union all select 7, 'Ledger Balance (Overall)', 'FAIL', 'HIGH',
         cast(abs(sum(debit) - sum(credit)) >= 1 as bigint) from t_books
  union all select 7, 'Ledger Double-Sided Entries', 'FAIL', 'HIGH',
         count(*) filter (debit > 0 and credit > 0) from t_books
  union all select 7, 'Ledger Balance per Reference', 'WARN', 'MEDIUM', count(*)
         from ({_unbalanced('canonical_reference_id')})
  union all select 8, 'Cardinality Checks', 'WARN', 'MEDIUM',
         (select cast(count(*) > 0 as bigint) from t_merchants where merchant_id not in
           (select merchant_id from t_customers))
         + (select cast(count(*) > 0 as bigint) from (select 1 from t_invoices group by order_id
           having count(*) > 1))
         + (select cast(count(*) > 5 as bigint) from (select 1 from t_payments group by order_id
           having count(*) > 1))
         + (select cast(count(*) > 0 as bigint) from (select 1 from t_gst_records
           group by invoice_id having count(*) > 1))
  union all select 9, 'Settlement-Payment Consistency', 'FAIL', 'HIGH',
         (select count(*) from t_settlement_payments where settlement_id not in
           (select settlement_id from t_settlements))
         + (select count(*) from t_settlement_payments where payment_id not in
           (select payment_id from t_payments))
         + (select count(*) from (select payment_id from t_settlement_payments group by 1
           having count(distinct settlement_id) > 1))
  union all select 10, 'Bank↔Settlement Consistency', 'WARN', 'MEDIUM', count(*)
         from t_bank_records b join t_settlements s on s.settlement_id = b.settlement_id
         where abs(amount - net_amount) > 1
  union all select 11, 'Invoice↔GST Consistency', 'WARN', 'MEDIUM', count(*)
         from t_invoices i join t_gst_records g on g.invoice_id = i.invoice_id
         where abs(i.total_tax - g.total_tax) > 0.01
  union all select 12, 'Payment↔Order Consistency', 'WARN', 'MEDIUM', count(*)
         from t_payments where order_id not in (select order_id from t_orders)
  union all select 13, 'Refund Consistency', 'WARN', 'MEDIUM',
         (select count(*) from t_refunds r join t_payments p using (payment_id)
           where r.refund_amount > p.amount)
         + (select count(*) from (select payment_id, sum(refund_amount) as s from t_refunds
           group by 1) join t_payments using (payment_id) where s > amount)
  union all select 2, 'Row Counts', 'WARN', 'MEDIUM', count(*) filter (lost > 0)
         from ({DRIFT_SQL})
  union all select 14, 'Duplicate Detection', 'INFO', 'LOW', sum(duplicates)
         from ({SOURCE_DUPLICATES_SQL})
  union all select 15, 'Lineage Check', 'WARN', 'MEDIUM', count(*) filter (status = 'WARN')
         from ({COVERAGE_SQL})
  union all select 16, 'Normalization Source Map', 'WARN', 'LOW', 0 from events having count(*) > 0
  union all select 17, 'Quarantine Check', 'WARN', 'LOW', 0 from events having count(*) > 0
  union all select 18, 'GT: event_links→payments', 'WARN', 'MEDIUM', count(distinct target_id)
         from ({EDGES_SQL}) where target_type = 'payment'
         and target_id not in (select payment_id from t_payments)),
r as (select num, name, case when n > 0 then bad else 'PASS' end as status,
             cast(n as bigint) as failure_count,
             case when n > 0 then grave else 'INFO' end as severity from f)
"""


def _whole_report(fx):
    from ledgerloom.plans.queries_ingest import _batch

    # The report reads the quarantine as it was stored.
    quarantine = fx.stored("quarantine", lambda: _batch(fx).quarantine)
    origin = audit.provenance(_drift(fx), _lineage_tables(fx), _seen(fx), quarantine,
                              derive.truth_edges(fx.all()), fx.payments)
    return audit.report(fx.all(), origin)


@query("audit_report", REPORT_SQL + "select * from r")
def audit_report(fx):
    return _whole_report(fx).drop("notes")


@query("audit_verdict", REPORT_SQL + """
select count(*) as checks, count(*) filter (status = 'PASS') as passed,
       count(*) filter (status = 'WARN') as warned, count(*) filter (status = 'FAIL') as failed,
       count(*) filter (status = 'FAIL' and severity in ('CRITICAL', 'HIGH')) as blocking,
       case when count(*) filter (status = 'FAIL' and severity in ('CRITICAL', 'HIGH')) = 0
            then 'READY' else 'NOT READY' end as verdict
from r""")
def audit_verdict(fx):
    return audit.final_verdict(_whole_report(fx))


