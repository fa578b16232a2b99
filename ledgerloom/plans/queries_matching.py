"""Matching rules, candidates and cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import vocab
from ledgerloom.functions.base import squeeze
from ledgerloom.functions.identifiers import match_key, mention
from ledgerloom.functions.similarity import similarity
from ledgerloom.operators import candidates, cases, evaluate, features, matching, rankjoin
from ledgerloom.operators.derive import id_number
from ledgerloom.plans.catalog import query

M, D, U = vocab.MATCHED, vocab.DISCREPANCY, vocab.UNMATCHED
COLUMNS = ["source_record_id", "status", "rule", "matched_record_id", "amount_difference",
           "date_difference", "codes"]


def brief(df):
    return df.withColumn("codes", F.array_join("reason_codes", ",")).select(*COLUMNS)


def linked_sql(source: str, matched: str, linked: str, same: str, rule: str, diff: str,
               days: str) -> str:
    return f"""{source} as source_record_id,
   case when ({linked}) and ({same}) then '{M}' when {linked} then '{D}' else '{U}' end as status,
   '{rule}' as rule, case when {linked} then {matched} end as matched_record_id,
   cast({diff} as double) as amount_difference, cast({days} as bigint) as date_difference,
   case when ({linked}) and ({same}) then 'FK_MATCH,AMOUNT_OK'
        when {linked} then 'FK_MATCH,AMOUNT_DISCREPANCY' else 'MISSING_RECORD' end as codes"""


def _days(a: str, b: str) -> str:
    return f"abs(datediff('day', cast({b} as date), cast({a} as date)))"


ORDER_PAYMENT_SQL = "select " + linked_sql(
    "p.payment_id", "p.payment_id", "o.order_id is not null",
    "abs(p.amount - o.total_amount) < 0.01", "ORDER_ID_AND_AMOUNT",
    "p.amount - o.total_amount", _days("p.payment_date", "o.order_date")) + """
from t_payments p left join t_orders o on o.order_id = p.order_id"""
PAYMENT_FEE_SQL = "select " + linked_sql(
    "p.payment_id", "f.fee_id", "f.fee_id is not null", "true", "PAYMENT_ID_LINK", "null",
    "null") + " from t_payments p left join t_fees f on f.payment_id = p.payment_id"
PAYMENT_REFUND_SQL = "select " + linked_sql(
    "p.payment_id", "r.refund_id", "true", "r.refund_amount <= p.amount + 0.01",
    "PAYMENT_ID_REFUND_LEQ_PAYMENT", "r.refund_amount - p.amount",
    _days("r.refund_date", "p.payment_date")) + """
from t_payments p join t_refunds r on r.payment_id = p.payment_id"""
PAYMENT_SETTLEMENT_SQL = "select " + linked_sql(
    "p.payment_id", "l.settlement_id", "true",
    "l.allocated_amount is null or abs(l.allocated_amount - p.amount) < 0.01",
    "SETTLEMENT_PAYMENTS_LINK", "l.allocated_amount - p.amount", "null") + """
from t_payments p join t_settlement_payments l on l.payment_id = p.payment_id
join t_settlements s on s.settlement_id = l.settlement_id"""
ORDER_INVOICE_SQL = "select " + linked_sql(
    "o.order_id", "i.invoice_id", "true", "abs(i.total_amount - o.total_amount) < 0.01",
    "ORDER_ID_AND_AMOUNT", "i.total_amount - o.total_amount",
    _days("i.invoice_date", "o.order_date")) + """
from t_orders o join t_invoices i on i.order_id = o.order_id"""
INVOICE_GST_SQL = "select " + linked_sql(
    "i.invoice_id", "g.gst_record_id", "g.gst_record_id is not null",
    "abs(g.total_tax - i.total_tax) < 0.01 and abs(g.total_amount - i.total_amount) < 0.01",
    "INVOICE_ID_AND_TAX", "g.total_amount - i.total_amount", "null") + """
from t_invoices i left join t_gst_records g on g.invoice_id = i.invoice_id"""
SETTLEMENT_ADJUSTMENT_SQL = "select " + linked_sql(
    "s.settlement_id", "a.adjustment_id", "true", "true", "SETTLEMENT_ID_LINK", "a.amount",
    _days("a.adjustment_date", "s.settlement_date")) + """
from t_settlements s join t_adjustments a on a.settlement_id = s.settlement_id"""
ARITHMETIC_SQL = f"""
select settlement_id as source_record_id, '{D}' as status,
       'NET_EQUALS_GROSS_MINUS_FEES_TAX_REFUNDS_PLUS_ADJ' as rule,
       cast(null as varchar) as matched_record_id, cast(gap as double) as amount_difference,
       cast(null as bigint) as date_difference, 'AMOUNT_DISCREPANCY' as codes
from (select settlement_id, net_amount - (gross_amount - total_fees - total_fee_tax
        - total_refunds + total_adjustments) as gap from t_settlements)
where abs(gap) >= 0.05"""


def books_sql(table: str, key: str) -> str:
    return f"""
select {key} as source_record_id,
       case when n is null then '{U}' when abs(gap) < 0.01 then '{M}' else '{D}' end as status,
       case when n is null then 'NO_LEDGER_ENTRIES' else 'REFERENCE_ID_AND_DEBIT_CREDIT' end
         as rule,
       entry as matched_record_id, cast(gap as double) as amount_difference,
       cast(null as bigint) as date_difference,
       case when n is null then 'MISSING_RECORD' when abs(gap) < 0.01 then 'LEDGER_BALANCED'
            else 'LEDGER_IMBALANCE' end as codes
from {table} left join (
  select id, sum(debit) - sum(credit) as gap, count(*) as n, min(entry_id) as entry
  from (select reference_id as id, entry_id, debit, credit from t_books
        union select canonical_reference_id, entry_id, debit, credit from t_books)
  group by id) on id = {key}"""


@query("order_payment_status", f"""
select 'ORDER_PAYMENT' as pair_type, rule, status, count(*) as decisions,
       cast(sum(coalesce(cast(amount_difference as decimal(18,2)), 0)) as double)
         as amount_difference
from ({ORDER_PAYMENT_SQL}) group by rule, status""")
def order_payment_status(fx):
    return matching.status_counts(matching.order_payment(fx.payments, fx.orders))


@query("order_payment_match", ORDER_PAYMENT_SQL)
def order_payment_match(fx):
    return brief(matching.order_payment(fx.payments, fx.orders))


@query("order_invoice_match", ORDER_INVOICE_SQL)
def order_invoice_match(fx):
    return brief(matching.order_invoice(fx.orders, fx.invoices))


@query("payment_fee_match", PAYMENT_FEE_SQL)
def payment_fee_match(fx):
    return brief(matching.payment_fee(fx.payments, fx.fees))


@query("payment_refund_match", PAYMENT_REFUND_SQL)
def payment_refund_match(fx):
    return brief(matching.payment_refund(fx.payments, fx.refunds))


@query("payment_settlement_match", PAYMENT_SETTLEMENT_SQL)
def payment_settlement_match(fx):
    return brief(matching.payment_settlement(fx.payments, fx.settlement_payments,
                                             fx.settlements))


@query("invoice_gst_match", INVOICE_GST_SQL)
def invoice_gst_match(fx):
    return brief(matching.invoice_gst(fx.invoices, fx.gst_records))


@query("settlement_adjustment_match", SETTLEMENT_ADJUSTMENT_SQL)
def settlement_adjustment_match(fx):
    return brief(matching.settlement_adjustment(fx.settlements, fx.adjustments))


@query("settlement_arithmetic", ARITHMETIC_SQL)
def settlement_arithmetic(fx):
    return brief(matching.settlement_arithmetic(fx.settlements))


@query("payment_ledger_match", books_sql("t_payments", "payment_id"))
def payment_ledger_match(fx):
    return brief(matching.event_books(fx.payments, "payment_id", fx.books))


def _stages(*parts: str) -> str:
    return "\nunion all\n".join(
        f"select {i} as stage, * from ({p})" for i, p in enumerate(parts))


def rolled_sql(stages: str) -> str:
    return f"""
select source_record_id, status, rule, amount_difference, date_difference, reason_codes
from (
  select *, row_number() over (partition by source_record_id order by
      case status when '{U}' then 3 when '{D}' then 2 else 0 end desc, stage,
      coalesce(matched_record_id, '')) as k
  from ({stages})) d
join (
  select source_record_id as id, string_agg(code, ',' order by first_at) as reason_codes
  from (
    select source_record_id, code, min(stage || '|' || coalesce(matched_record_id, '') || '|' || pos)
             as first_at
    from (select source_record_id, stage, matched_record_id,
                 unnest(string_split(codes, ',')) as code,
                 unnest(range(len(string_split(codes, ',')))) as pos from ({stages}))
    group by 1, 2)
  group by 1) c on c.id = d.source_record_id
where k = 1"""


def case_sql(stages: str, kind: str, matched: str, joins: str) -> str:
    return f"""
select r.source_record_id, '{kind}' as source_type, r.status,
       case r.status when '{U}' then 'unmatched' else 'deterministic' end
         as reconciliation_method,
       {matched} as matched_record_id, r.amount_difference, r.date_difference, r.reason_codes
from ({rolled_sql(stages)}) r {joins}"""


def case_view(df):
    return df.select("source_record_id", "source_type", "status", "reconciliation_method",
                     "matched_record_id", "amount_difference", "date_difference",
                     F.array_join("reason_codes", ",").alias("reason_codes"))


PAYMENT_STAGES = _stages(ORDER_PAYMENT_SQL, PAYMENT_FEE_SQL, PAYMENT_REFUND_SQL,
                         PAYMENT_SETTLEMENT_SQL, books_sql("t_payments", "payment_id"))


@query("payment_cases", f"""
with r as ({rolled_sql(PAYMENT_STAGES)}),
w as (select * from (select *, row_number() over (partition by source_record_id order by
      case status when '{U}' then 3 when '{D}' then 2 else 0 end desc, stage,
      coalesce(matched_record_id, '')) as k from ({PAYMENT_STAGES})) where k = 1)
select r.source_record_id, 'payment' as source_type, r.status,
       case r.status when '{U}' then 'unmatched' else 'deterministic' end
         as reconciliation_method,
       coalesce(w.matched_record_id, o.order_id) as matched_record_id,
       r.amount_difference, r.date_difference, r.reason_codes
from r join w on w.source_record_id = r.source_record_id
join t_payments p on p.payment_id = r.source_record_id
left join t_orders o on o.order_id = p.order_id""")
def payment_cases(fx):
    return case_view(cases.reconcile_payments(fx.all()))


@query("order_cases", case_sql(
    _stages("select " + linked_sql(
        "o.order_id", "p.payment_id", "p.payment_id is not null",
        "abs(p.amount - o.total_amount) < 0.01", "ORDER_ID_AND_AMOUNT",
        "p.amount - o.total_amount", _days("p.payment_date", "o.order_date"))
        + " from t_orders o left join t_payments p on p.order_id = o.order_id",
        ORDER_INVOICE_SQL),
    "order", "coalesce(p.payment_id, i.invoice_id)",
    """left join t_payments p on p.order_id = r.source_record_id
       left join t_invoices i on i.order_id = r.source_record_id"""))
def order_cases(fx):
    return case_view(cases.reconcile_orders(fx.all()))


@query("invoice_cases", case_sql(
    _stages(ORDER_INVOICE_SQL.replace("o.order_id as source_record_id",
                                      "i.invoice_id as source_record_id"), INVOICE_GST_SQL),
    "invoice", "coalesce(g.gst_record_id, i.order_id)",
    """join t_invoices i on i.invoice_id = r.source_record_id
       left join t_gst_records g on g.invoice_id = r.source_record_id"""))
def invoice_cases(fx):
    return case_view(cases.reconcile_invoices(fx.all()))


SETTLEMENT_STAGES = _stages(books_sql("t_settlements", "settlement_id"),
                            SETTLEMENT_ADJUSTMENT_SQL, ARITHMETIC_SQL)


@query("settlement_cases", f"""
select c.source_record_id, c.source_type, c.status, c.reconciliation_method, c.matched_record_id,
       cast(s.net_amount - (s.gross_amount - s.total_fees - s.total_fee_tax - s.total_refunds
            + s.total_adjustments) as double) as amount_difference,
       cast(null as bigint) as date_difference, c.reason_codes
from ({case_sql(SETTLEMENT_STAGES, 'settlement', 'r.source_record_id', '')}) c
join t_settlements s on s.settlement_id = c.source_record_id""")
def settlement_cases(fx):
    return case_view(cases.reconcile_settlements(fx.all()))


# --- bank records -----------------------------------------------------------------

MENU_SQL = {
    "t_near": """
select b.bank_record_id, s.settlement_id
from t_bank_records b join t_settlements s on s.merchant_id = b.merchant_id
 and abs(datediff('day', b.transaction_date, cast(s.settlement_date as date))) <= 25""",
    "t_far": """
select b.bank_record_id, s.settlement_id
from t_bank_records b join t_settlements s on s.merchant_id = b.merchant_id
where b.bank_record_id not in (select bank_record_id from t_near)""",
    "t_menu": """
select bank_record_id, settlement_id from t_near
union all select bank_record_id, settlement_id from t_far""",
    "t_judged_pairs": """
select b.bank_record_id, b.amount, b.transaction_date, s.settlement_id, s.net_amount,
       s.settlement_date, key <> '' and key = utr_key and b.amount = s.net_amount as both_equal,
       key <> '' and key = utr_key and b.amount <> s.net_amount as ref_only
from (select *, coalesce(upper(regexp_replace(reference, '[^A-Za-z0-9]', '', 'g')), '') as key
      from t_bank_records) b
join t_menu m on m.bank_record_id = b.bank_record_id
join (select *, upper(regexp_replace(utr, '[^A-Za-z0-9]', '', 'g')) as utr_key
      from t_settlements) s on s.settlement_id = m.settlement_id""",
    "t_whole_pairs": """
select b.bank_record_id, b.amount, b.transaction_date, s.settlement_id, s.net_amount,
       s.settlement_date, b.amount = s.net_amount as both_equal,
       b.amount <> s.net_amount as ref_only
from (select *, coalesce(upper(regexp_replace(reference, '[^A-Za-z0-9]', '', 'g')), '') as key
      from t_bank_records) b
join (select *, upper(regexp_replace(utr, '[^A-Za-z0-9]', '', 'g')) as utr_key
      from t_settlements) s on s.merchant_id = b.merchant_id and s.utr_key = b.key""",
}


def resolved_sql(pairs: str) -> str:
    return f"""
select source_record_id,
       case when n_both = 1 then '{M}' when n_both = 0 and n_only = 1 then '{D}' else '{U}' end
         as status,
       case when n_both = 1 then 'EXACT_AMOUNT_AND_UTR' when n_both > 1
            then 'AMBIGUOUS_EXACT_MATCHES' when n_only = 1 then 'EXACT_UTR_AMOUNT_MISMATCH'
            when n_only > 1 then 'AMBIGUOUS_UTR'
            else 'NO_DETERMINISTIC_SETTLEMENT_BANK_MATCH' end as rule,
       hit as matched_record_id,
       cast(amount - net as double) as amount_difference,
       abs(datediff('day', transaction_date, cast(settled as date))) as date_difference,
       case when n_both = 1 then 'EXACT_AMOUNT,EXACT_UTR' when n_both > 1
            then 'AMBIGUOUS_DETERMINISTIC' when n_only = 1 then 'EXACT_UTR,AMOUNT_DISCREPANCY'
            when n_only > 1 then 'AMBIGUOUS_UTR' else 'UNRESOLVED' end as codes
from (
  select b.bank_record_id as source_record_id, b.amount, b.transaction_date,
         coalesce(n_both, 0) as n_both, coalesce(n_only, 0) as n_only,
         case when n_both = 1 then both_id when n_both = 0 and n_only = 1 then only_id end as hit
  from t_bank_records b left join (
    select bank_record_id, count(*) filter (both_equal) as n_both,
           count(*) filter (ref_only) as n_only,
           min(settlement_id) filter (both_equal) as both_id,
           min(settlement_id) filter (ref_only) as only_id
    from {pairs} group by 1) j on j.bank_record_id = b.bank_record_id) x
left join (select settlement_id, net_amount as net, settlement_date as settled
           from t_settlements) s on s.settlement_id = x.hit"""


def _pairs(fx):
    return candidates.pair_with_menus(
        fx.bank_records, candidates.candidate_menus(fx.bank_records, fx.settlements))


def _open_bank(fx):
    """Bank records that the rules leave open."""
    decided = candidates.resolve(candidates.reference_pairs(fx.bank_records, fx.settlements))
    open_ids = decided.filter(~F.col("resolved")).select(
        F.col("source_record_id").alias("bank_record_id"))
    return fx.stored("open_bank", lambda: fx.bank_records.join(
        open_ids, "bank_record_id", "left_semi"))


@query("bank_candidate_menu", "select bank_record_id, settlement_id from t_menu", MENU_SQL)
def bank_candidate_menu(fx):
    return _pairs(fx).filter(F.col("settlement_id").isNotNull()).select(
        "bank_record_id", "settlement_id")


@query("candidate_count_summary", f"""
select merchant_id, 'candidates' as value_name, count(n) as row_count,
       {', '.join(f"round(cast({f} as double), 6) as {n}" for n, f in (
           ("mean", "avg(n)"), ("std", "stddev_samp(n)"), ("min", "min(n)"),
           ("q1", "quantile_cont(n, 0.25)"), ("median", "quantile_cont(n, 0.5)"),
           ("q3", "quantile_cont(n, 0.75)"), ("max", "max(n)")))}
from (select b.merchant_id, cast(coalesce(m.n, 0) as double) as n from t_bank_records b
      left join (select bank_record_id, count(*) as n from t_menu group by 1) m
      on m.bank_record_id = b.bank_record_id)
group by merchant_id""", MENU_SQL)
def candidate_count_summary(fx):
    counts = _pairs(fx).filter(F.col("settlement_id").isNotNull()).groupBy("bank_record_id").agg(
        F.count(F.lit(1)).alias("n"))
    listed = fx.bank_records.select("merchant_id", "bank_record_id").join(
        counts, "bank_record_id", "left").select("merchant_id", F.coalesce("n", F.lit(0)).alias("candidates"))
    found = evaluate.described(listed, ["merchant_id"], ["candidates"])
    return found.select("merchant_id", "value_name", "row_count", *[
        F.round(c, 6).alias(c) for c in ("mean", "std", "min", "q1", "median", "q3", "max")])


@query("bank_settlement_rules", resolved_sql("t_judged_pairs"), MENU_SQL)
def bank_settlement_rules(fx):
    return brief(candidates.resolve(candidates.reference_pairs(fx.bank_records, fx.settlements)))


@query("bank_settlement_rules_beyond_window", f"""
with a as ({resolved_sql('t_judged_pairs')}), b as ({resolved_sql('t_whole_pairs')})
select * from a where rule <> 'NO_DETERMINISTIC_SETTLEMENT_BANK_MATCH'
union all
select b.* from b join a on a.source_record_id = b.source_record_id
where a.rule = 'NO_DETERMINISTIC_SETTLEMENT_BANK_MATCH'""", MENU_SQL)
def bank_settlement_rules_beyond_window(fx):
    return brief(candidates.resolve_within_and_beyond(fx.bank_records, fx.settlements))


@query("bank_cases_by_rule", f"""
select source_record_id, 'bank_record' as source_type, status,
       case status when '{U}' then 'unmatched' else 'deterministic' end
         as reconciliation_method,
       matched_record_id, amount_difference, date_difference,
       case when status = '{U}' then 'ML_UNAVAILABLE,' || codes else codes end as reason_codes
from ({resolved_sql('t_judged_pairs')})""", MENU_SQL)
def bank_cases_by_rule(fx):
    return case_view(cases.reconcile_bank(fx.bank_records, fx.settlements, beyond_window=False))


FEATURE_SQL = {
    "t_pairs": """
select b.*, s.settlement_date, s.gross_amount, s.net_amount, s.total_fees, s.total_fee_tax,
       s.total_refunds, s.utr, s.payment_count, s.settlement_id as target_id
from t_bank_records b join t_menu m on m.bank_record_id = b.bank_record_id
join t_settlements s on s.settlement_id = m.settlement_id""",
    "t_pair_features": """
select bank_record_id, target_id, bank_amount - net as amount_difference,
       abs(bank_amount - net) as absolute_amount_difference,
       case when net <> 0 then abs(bank_amount - net) / abs(net) end as relative_amount_difference,
       case when net <> 0 then bank_amount / net end as amount_ratio,
       cast(amount = net_amount as bigint) as exact_amount_match,
       abs(bank_amount - cast(gross_amount as double)) as absolute_amount_difference_vs_gross,
       days as date_difference_days, vdays as value_date_difference_days,
       cast(coalesce(days = 0, false) as bigint) as same_day,
       cast(coalesce(days <= 1, false) as bigint) as within_1_day,
       cast(coalesce(days <= 3, false) as bigint) as within_3_days,
       cast(coalesce(days <= 7, false) as bigint) as within_7_days,
       cast(coalesce(upper(regexp_replace(reference, '[^A-Za-z0-9]', '', 'g'))
            = upper(utr), false) as bigint) as reference_exact_match,
       len(list_intersect(a, b)) / cast(len(list_distinct(a || b)) as double)
         as description_token_overlap,
       cast(transaction_type = 'CREDIT' as bigint) as transaction_type_is_credit,
       category as bank_category, payment_count
from (
  select *, cast(amount as double) as bank_amount, cast(net_amount as double) as net,
         abs(datediff('day', transaction_date, cast(settlement_date as date))) as days,
         abs(datediff('day', value_date, cast(settlement_date as date))) as vdays,
         list_distinct(regexp_extract_all(upper(description), '[A-Za-z0-9]+')) as a,
         list_distinct(regexp_extract_all(upper(target_id || ' settlement ' || utr),
                       '[A-Za-z0-9]+')) as b
  from t_pairs)""",
}
# The similarity of two references, as ``functions.similarity`` defines it: the longest common
# block, the first one in the left and then in the right text, and so on before and after it.
SIMILARITY_SQL = {
    "t_references": """
select distinct coalesce(upper(regexp_replace(reference, '[^A-Za-z0-9]', '', 'g')), '') as ours,
       coalesce(upper(regexp_replace(utr, '[^A-Za-z0-9]', '', 'g')), '') as theirs from t_pairs""",
    "t_similarity": """
with recursive parts as (
  select ours, theirs, ours as a, theirs as b, 0 as size from t_references where ours <> theirs
  union all
  select ours, theirs, unnest([substr(a, 1, i - 1), substr(a, i + k)]) as a,
         unnest([substr(b, 1, j - 1), substr(b, j + k)]) as b, unnest([k, 0]) as size
  from (select *, instr(b, substr(a, i, k)) as j from (
    select *, best.k as k, -best.i as i from (
      select ours, theirs, a, b, list_max(flatten(list_transform(range(1, length(a) + 1),
               lambda p: list_transform(range(1, length(a) - p + 2), lambda n:
                 case when contains(b, substr(a, p, n)) then {'k': n, 'i': -p} end)))) as best
      from parts where a <> '' and b <> '') where best is not null)))
select ours, theirs, 2.0::double * sum(size) / (length(ours) + length(theirs)) as utr_similarity
from parts group by ours, theirs
union all select ours, theirs, 1.0::double from t_references where ours = theirs""",
    "t_alike": """
select distinct p.bank_record_id, p.target_id, s.utr_similarity from t_pairs p join t_similarity s
on s.ours = coalesce(upper(regexp_replace(p.reference, '[^A-Za-z0-9]', '', 'g')), '')
and s.theirs = coalesce(upper(regexp_replace(p.utr, '[^A-Za-z0-9]', '', 'g')), '')""",
}
PAIR_COLUMNS = ["bank_record_id", "target_id", "amount_difference", "absolute_amount_difference",
                "relative_amount_difference", "amount_ratio", "exact_amount_match",
                "absolute_amount_difference_vs_gross", "date_difference_days",
                "value_date_difference_days", "same_day", "within_1_day", "within_3_days",
                "within_7_days", "reference_exact_match", "description_token_overlap",
                "transaction_type_is_credit", "bank_category", "payment_count"]


def _whole_menu_features(fx):
    return features.pair_features(_pairs(fx).filter(F.col("settlement_id").isNotNull()))


@query("pair_base_features", f"select {', '.join(PAIR_COLUMNS)} from t_pair_features",
       {**MENU_SQL, **FEATURE_SQL})
def pair_base_features(fx):
    return _whole_menu_features(fx).select(*PAIR_COLUMNS)


@query("id_in_description_flags", """
select bank_record_id, target_id,
       cast(coalesce(contains(upper(description), upper(target_id)), false) as bigint) as named
from t_pairs""", {**MENU_SQL, **FEATURE_SQL})
def id_in_description_flags(fx):
    pairs = _pairs(fx).filter(F.col("settlement_id").isNotNull())
    return pairs.select("bank_record_id", F.col("settlement_id").alias("target_id"),
                        F.coalesce(features.id_in_description(pairs), F.lit(0)).alias("named"))


@query("candidate_context_features", """
select bank_record_id, target_id, candidate_count, candidate_rank_by_amount,
       candidate_rank_by_date, candidate_rank_by_reference,
       cast(candidate_rank_by_amount = 1 as bigint) as is_best_amount_candidate,
       cast(candidate_rank_by_date = 1 as bigint) as is_best_date_candidate,
       max(absolute_amount_difference) filter (candidate_rank_by_amount = 2) over w
         - max(absolute_amount_difference) filter (candidate_rank_by_amount = 1) over w
         as best_vs_second_best_amount_gap,
       max(date_difference_days) filter (candidate_rank_by_date = 2) over w
         - max(date_difference_days) filter (candidate_rank_by_date = 1) over w
         as best_vs_second_best_date_gap
from (
  select *, count(*) over (partition by bank_record_id) as candidate_count,
         row_number() over (partition by bank_record_id
           order by absolute_amount_difference nulls last, target_id) as candidate_rank_by_amount,
         row_number() over (partition by bank_record_id
           order by date_difference_days nulls last, target_id) as candidate_rank_by_date,
         row_number() over (partition by bank_record_id
           order by utr_similarity desc, target_id) as candidate_rank_by_reference
  from t_pair_features join t_alike using (bank_record_id, target_id))
window w as (partition by bank_record_id)""", {**MENU_SQL, **FEATURE_SQL, **SIMILARITY_SQL})
def candidate_context_features(fx):
    return features.add_context(_whole_menu_features(fx)).select(
        "bank_record_id", "target_id", "candidate_count", "candidate_rank_by_amount",
        "candidate_rank_by_date", "candidate_rank_by_reference", "is_best_amount_candidate",
        "is_best_date_candidate", "best_vs_second_best_amount_gap",
        "best_vs_second_best_date_gap")


@query("ranked_bank_candidates")
def ranked_bank_candidates(fx):
    return features.align(cases.candidate_features(_open_bank(fx), fx.settlements),
                          ["bank_record_id", "target_id"])


# --- documented extras --------------------------------------------------------------


@query("settlement_allocation", f"""
select s.settlement_id, cast(s.gross_amount as double) as gross_amount,
       cast(coalesce(a, 0) as double) as allocated, coalesce(n, 0) as payments,
       case when abs(a - s.gross_amount) < 0.01 then '{M}' else '{D}' end as status
from t_settlements s left join (select settlement_id, sum(allocated_amount) as a, count(*) as n
  from t_settlement_payments group by 1) l on l.settlement_id = s.settlement_id""")
def settlement_allocation(fx):
    return matching.settlement_allocation(fx.settlement_payments, fx.settlements)


@query("settlements_paid_twice", """
select claimed as settlement_id, count(*) as bank_records from (
  select settlement_id as claimed from t_bank_records where settlement_id is not null
  union all select settlement_id from t_bank_records
  where settlement_id is not null
    and cast(regexp_extract(settlement_id, '([0-9]+)$', 1) as bigint) % 6 = 0)
group by 1 having count(*) > 1""")
def settlements_paid_twice(fx):
    again = fx.bank_records.filter(id_number("settlement_id") % 6 == 0)
    return matching.settlements_paid_twice(fx.bank_records.unionByName(again))


@query("difference_causes", """
select bank_record_id, settlement_id, cast(difference as double) as difference,
       case when difference = 25 then 'UNKNOWN'
            when exists (select 1 from t_adjustments a where a.settlement_id = d.settlement_id
                         and abs(a.amount) = abs(difference)) then 'ADJUSTMENT'
            when exists (select 1 from t_settlement_payments l join t_fees f
                         on f.payment_id = l.payment_id where l.settlement_id = d.settlement_id
                         and f.total_fee = abs(difference)) then 'FEE_ADJUSTMENT'
            when abs(difference) < 1 then 'ROUNDING' else 'UNKNOWN' end as cause
from (select b.bank_record_id, b.settlement_id,
             b.amount - s.net_amount - case when n % 3 = 0 then 24.5 when n % 3 = 1 then 24
               else 0 end as difference
      from (select *, cast(regexp_extract(bank_record_id, '([0-9]+)$', 1) as bigint) as n
            from t_bank_records) b join t_settlements s on s.settlement_id = b.settlement_id
      where b.amount <> s.net_amount) d""")
def difference_causes(fx):
    n = id_number("bank_record_id")
    less = F.when(n % 3 == 0, F.lit("24.50")).when(n % 3 == 1, F.lit("24.00")).otherwise("0")
    linked = fx.bank_records.join(fx.settlements.select("settlement_id", "net_amount"),
                                  "settlement_id").filter(F.col("amount") != F.col("net_amount"))
    gap = (F.col("amount") - F.col("net_amount") - less.cast("decimal(15,2)")).cast(
        "decimal(15,2)")
    fees = fx.settlement_payments.join(fx.fees.select("payment_id", "total_fee"), "payment_id")
    return matching.attribute_differences(
        linked.select("bank_record_id", "settlement_id", gap.alias("difference")),
        fx.adjustments, fees)


@query("gateway_reference_or_day_match", """
with r as (select payment_id, gateway_reference, amount, cast(payment_date as date) as day
           from t_payments),
l as (select payment_id as record_id, case when n % 4 = 0 then 'none_' || n
        else gateway_reference end as gateway_reference, amount, cast(payment_date as date) as day
      from (select *, cast(regexp_extract(payment_id, '([0-9]+)$', 1) as bigint) as n
            from t_payments))
select record_id,
  case when rn = 1 then 'EXACT_GATEWAY_REFERENCE' when rn > 1 then 'AMBIGUOUS_GATEWAY_REFERENCE'
       when dn = 1 then 'EXACT_AMOUNT_SAME_DAY' when dn > 1 then 'AMBIGUOUS_AMOUNT_SAME_DAY'
       else 'NONE' end as rule,
  case when rn = 1 then rid when rn is null and dn = 1 then did end as matched_record_id
from l left join (select gateway_reference as g, count(*) as rn, min(payment_id) as rid
                  from r group by 1) on g = l.gateway_reference
left join (select amount as a, day as d, count(*) as dn, min(payment_id) as did
           from r group by 1, 2) on a = l.amount and d = l.day""")
def gateway_reference_or_day_match(fx):
    n = id_number("payment_id")
    right = fx.payments.select(F.col("payment_id").alias("record_id"), "gateway_reference",
                               "amount", F.to_date("payment_date").alias("day"))
    left = fx.payments.select(
        F.col("payment_id").alias("record_id"),
        F.when(n % 4 == 0, F.concat(F.lit("none_"), n.cast("string")))
        .otherwise(F.col("gateway_reference")).alias("gateway_reference"),
        "amount", F.to_date("payment_date").alias("day"))
    return matching.exact_reference_or_day(left, right)


@query("context_tolerances", """
select bank_record_id as record_id, pair_type, cast(amount_ok as bigint) as amount_ok,
       cast(days_ok as bigint) as days_ok
from (
  select b.bank_record_id, 'SETTLEMENT_BANK' as pair_type,
         abs(b.amount - s.net_amount) <= 100
           or abs(b.amount - s.net_amount) <= abs(s.net_amount) * 0.02 as amount_ok,
         coalesce(abs(datediff('day', b.transaction_date, cast(s.settlement_date as date))) <= 2,
                  false) as days_ok
  from t_bank_records b join t_settlements s on s.settlement_id = b.settlement_id
  union all
  select p.payment_id, 'ORDER_PAYMENT', p.amount = o.total_amount,
         datediff('day', cast(o.order_date as date), cast(p.payment_date as date)) = 0
  from t_payments p join t_orders o on o.order_id = p.order_id)""")
def context_tolerances(fx):
    bank = fx.bank_records.join(
        fx.settlements.select("settlement_id", "net_amount", "settlement_date"), "settlement_id")
    first = bank.select(
        F.col("bank_record_id").alias("record_id"), F.lit("SETTLEMENT_BANK").alias("pair_type"),
        F.col("amount").alias("left_amount"), F.col("net_amount").alias("right_amount"),
        F.abs(F.datediff("transaction_date", F.to_date("settlement_date"))).alias("days"))
    paid = fx.payments.join(fx.orders.select("order_id", "total_amount", "order_date"),
                            "order_id")
    second = paid.select(
        F.col("payment_id").alias("record_id"), F.lit("ORDER_PAYMENT").alias("pair_type"),
        F.col("amount").alias("left_amount"), F.col("total_amount").alias("right_amount"),
        F.abs(F.datediff(F.to_date("payment_date"), F.to_date("order_date"))).alias("days"))
    return matching.within_tolerance(first.unionByName(second)).select(
        "record_id", "pair_type", "amount_ok", "days_ok")


@query("fuzzy_tier_flags")
def fuzzy_tier_flags(fx):
    ranked = features.pair_features(rankjoin.nearest_candidates(_open_bank(fx), fx.settlements))
    told = F.lower(squeeze(F.col("description")))
    named = match_key(mention("description")["id"])
    expected = F.lower(F.concat_ws(" settlement ", "target_id", "utr"))
    flagged = matching.fuzzy_flags(
        ranked, similarity(told, expected),
        F.when(named != "", similarity(named, match_key("target_id"))))
    return flagged.select("bank_record_id", "target_id", "fuzzy_id", "fuzzy_reference", "fuzzy_text",
                          "fuzzy_amount", "fuzzy_days", "fuzzy_passed")
