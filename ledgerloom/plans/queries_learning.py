"""Changes, training pairs, models and their evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import vocab
from ledgerloom.operators import augment, cases, derive, evaluate, exceptions, learn, pairs
from ledgerloom.plans.catalog import query
from ledgerloom.session import written


def sql_draw(key: str, salt: str) -> str:
    return (f"(cast(('0x' || substr(md5({key} || ':{salt}'), 1, 8)) as bigint) "
            f"/ cast(4294967296 as double))")


def _sql_pick(options: list[str], key: str, salt: str) -> str:
    listed = ", ".join(options)
    return f"([{listed}])[cast(floor({sql_draw(key, salt)} * {len(options)}) as integer) + 1]"


_B = "bank_record_id"
_SHARE = f"({sql_draw(_B, 'share')} * 0.05::double - 0.025::double)"
_GENERIC = _sql_pick([f"'{g}'" for g in vocab.GENERIC_NARRATIONS], _B, "generic")


@query("observed_bank_records", f"""
select bank_record_id,
       cast(case when {sql_draw(_B, 'jitter')} < 0.45 and abs({_SHARE}) >= 0.002
            then cast(cast(amount as double) * (1 + {_SHARE}) as decimal(15,2)) else amount end
            as double) as amount,
       strftime(case when {sql_draw(_B, 'moved')} < 0.35 then transaction_date
            + {_sql_pick(['-3', '-2', '-1', '1', '2', '3'], _B, 'shift')}
            else transaction_date end, '%Y-%m-%d') as transaction_date,
       case when {sql_draw(_B, 'narration')} < 0.70 then {_GENERIC}
            else regexp_replace(description, '(?i)STL_[0-9]+', 'SETTLEMENT', 'g') end
            as description,
       cast({sql_draw(_B, 'reference-noise')} < 0.35 or reference is null as bigint)
            as reference_kept
from t_bank_records""")
def observed_bank_records(fx):
    seen = augment.observe_bank(fx.bank_records.withColumn("_was", F.col("reference")))
    kept = (augment.draw("bank_record_id", "reference-noise") < 0.35) & F.col(
        "reference").eqNullSafe(F.col("_was")) | F.col("_was").isNull()
    return seen.select("bank_record_id", "amount", "transaction_date", "description",
                       kept.alias("reference_kept"))


@query("observed_references")
def observed_references(fx):
    return augment.observe_bank(fx.bank_records).select("bank_record_id", "reference")


@query("removed_and_repeated_records", f"""
select 'MISSING_RECORD' as type, invoice_id as record_id, cast(null as varchar) as corrupted
from t_invoices where {sql_draw('invoice_id', 'missing')} < 0.02
union all
select 'DUPLICATE', payment_id, payment_id || '_DUP' from t_payments
where {sql_draw('payment_id', 'duplicate')} < 0.03""")
def removed_and_repeated_records(fx):
    _, gone = augment.remove_records(fx.invoices, "invoice_id", "invoice", 0.02)
    _, again = augment.add_duplicates(fx.payments, "payment_id", "payment")
    return gone.unionByName(again).select("type", "record_id", "corrupted")


_S = "settlement_id"
_CUM = [(c, round(sum(w for _, w, _ in augment.CAUSES[:i + 1]), 6), m)
        for i, (c, _, m) in enumerate(augment.CAUSES)]


@query("amount_changes", f"""
select record_id, cause, cast(old as double) as original,
       cast(case when down and old >= step then old - step else old + step end as double)
         as corrupted
from (
  select settlement_id as record_id, net_amount as old, cause,
         {sql_draw(_S, 'side')} >= 0.5 as down,
         cast(round(case when cause = 'ROUNDING' then 0.01::double + size * 0.99::double
              else cast(net_amount as double) * (0.001::double + size * (most - 0.001::double)) end,
              2) as decimal(15,2)) as step
  from (select *, {sql_draw(_S, 'size')} as size,
          case {' '.join(f"when {sql_draw(_S, 'cause')} < {e} then '{c}'" for c, e, _ in _CUM)}
            end as cause,
          case {' '.join(f"when {sql_draw(_S, 'cause')} < {e} then {m}::double"
                         for c, e, m in _CUM)} end as most
        from t_settlements) where {sql_draw(_S, 'amount')} < 0.08 and net_amount > 0)""")
def amount_changes(fx):
    _, log = augment.amount_noise(fx.settlements, "settlement_id", "net_amount", "settlement")
    return log.select("record_id", "cause", F.col("original").cast("double").alias("original"),
                      F.col("corrupted").cast("double").alias("corrupted"))


@query("date_and_id_changes", f"""
select 'DATE_NOISE' as type, invoice_id as record_id,
       strftime(invoice_date, '%Y-%m-%d') as original,
       strftime(invoice_date + to_days(cast(floor({sql_draw('invoice_id', 'days')} * 3) + 1
                as integer)), '%Y-%m-%d') as corrupted
from t_invoices where {sql_draw('invoice_id', 'date')} < 0.20
union all
select 'ID_NOISE', order_id, order_id, 'ORD' from t_orders
where {sql_draw('order_id', 'id')} < 0.15""")
def date_and_id_changes(fx):
    _, moved = augment.date_noise(fx.invoices, "invoice_id", ["invoice_date"], "invoice")
    _, spelled = augment.id_noise(fx.orders, "order_id", "order")
    from ledgerloom.functions.identifiers import canonical_id

    # Every spelling must still read as the same order.
    same = canonical_id("corrupted") == F.col("original")
    return moved.select("type", "record_id", F.substring("original", 1, 10).alias("original"),
                        F.substring("corrupted", 1, 10).alias("corrupted")).unionByName(
        spelled.select("type", "record_id", "original",
                       F.when(same, "ORD").otherwise("?").alias("corrupted")))


def _changes(fx) -> tuple[dict, DataFrame]:
    return augment.corrupt(fx.all())


@query("change_log_counts")
def change_log_counts(fx):
    _, log = _changes(fx)
    return log.groupBy("type", "field", "entity_type").agg(F.count(F.lit(1)).alias("changes"))


_KINDS = list(vocab.CHANGE_CLASSES)
_CAUSE_NAMES = [*vocab.AMOUNT_CAUSES, "OTHER"]


def _arms(table: dict, place: int, key: str) -> str:
    return f"case {key} " + " ".join(
        "when '{}' then '{}'".format(k, str(v[place]).replace("'", "''"))
        for k, v in table.items()) + " end"


@query("exception_labels", f"""
select 'EXC_' || substr(sha256(type || '|' || record_id || '|' || field), 1, 12) as case_id,
       case when type = 'AMOUNT_NOISE' then 'AMOUNT_DISCREPANCY__' || sub
            else {_arms(vocab.CHANGE_CLASSES, 0, 'type')} end as exception_class,
       case when type = 'AMOUNT_NOISE' then sub end as exception_subclass,
       case when type = 'AMOUNT_NOISE' then {_arms(vocab.AMOUNT_CAUSES, 0, 'sub')}
            else {_arms(vocab.CHANGE_CLASSES, 1, 'type')} end as severity,
       case when type = 'AMOUNT_NOISE' then {_arms(vocab.AMOUNT_CAUSES, 1, 'sub')}
            else {_arms(vocab.CHANGE_CLASSES, 2, 'type')} end as resolution_hint,
       cast({_arms(vocab.CHANGE_CLASSES, 3, 'type')} = 'True' as bigint)
         as requires_manual_review
from (
  select *, case when cause = 'OTHER' then 'UNKNOWN' else cause end as sub from (
    select ([{', '.join(f"'{k}'" for k in _KINDS)}])[event_id % 7 + 1] as type,
           'R' || event_id as record_id, event_type as field,
           ([{', '.join(f"'{c}'" for c in _CAUSE_NAMES)}])[event_id % 6 + 1] as cause
    from events))""")
def exception_labels(fx):
    n = F.col("event_id")
    log = fx.raw("events").select(
        F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (n % 7 + 1).cast("int")).alias("type"),
        F.concat(F.lit("R"), n.cast("string")).alias("record_id"),
        F.col("event_type").alias("field"),
        F.element_at(F.array(*[F.lit(c) for c in _CAUSE_NAMES]), (n % 6 + 1).cast("int"))
        .alias("cause"), F.lit("a").alias("original"), F.lit("b").alias("corrupted"))
    return derive.label_changes(log).select(
        "case_id", "exception_class", "exception_subclass", "severity", "resolution_hint",
        "requires_manual_review")


@query("exception_class_distribution", f"""
select class as exception_class, count(*) as row_count from (
  select ([{', '.join(f"'{vocab.CHANGE_CLASSES[k][0]}'" for k in _KINDS)}])[event_id % 7 + 1]
           as class from events)
group by 1""")
def exception_class_distribution(fx):
    names = [vocab.CHANGE_CLASSES[k][0] for k in _KINDS]
    label = F.element_at(F.array(*[F.lit(x) for x in names]),
                         (F.col("event_id") % 7 + 1).cast("int"))
    return evaluate.class_distribution(
        fx.raw("events").select(label.alias("exception_class")), "exception_class")


# --- training pairs ---------------------------------------------------------------------


def _training_pairs(fx) -> DataFrame:
    edges = derive.truth_edges({"bank_records": fx.bank_records})
    seen = augment.observe_bank(fx.bank_records)
    return pairs.labelled_pairs(seen, fx.settlements, edges)


def _training_rows(fx) -> DataFrame:
    """Several models and passes read these rows, so they are written once; so are the pairs,
    which the split reads several times."""
    return fx.stored("training_rows", lambda: pairs.grouped_split(
        pairs.training_rows(written(_training_pairs(fx), "training-pairs")), "bank_record_id"))


@query("training_pair_families")
def training_pair_families(fx):
    return _training_pairs(fx).groupBy("label", "negative_type").agg(
        F.count(F.lit(1)).alias("row_count"))


@query("training_pair_integrity", """
select (select count(*) > 0 from t_bank_records)::bigint as has_pairs, 0 as repeated,
       0 as conflicting""")
def training_pair_integrity(fx):
    found = pairs.pair_integrity(_training_pairs(fx))
    return found.select((F.col("pairs") > 0).alias("has_pairs"), "repeated", "conflicting")


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("feature_audit", "\nunion all\n".join(
    f"select '{c}' as feature, round(100.0::double * count(*) filter ({c} is null) / count(*), 2)"
    f" as missing_percent, count(distinct {c}) as nunique, round(coalesce(var_samp({c}), 0), 3)"
    f" as variance, min({c})::double as least, max({c})::double as most,"
    f" (count(distinct {c}) <= 1)::bigint as constant from lineitem" for c in _NUMERIC))
def feature_audit(fx):
    audit = pairs.feature_audit(fx.raw("lineitem"), _NUMERIC)
    return audit.withColumn("variance", F.round("variance", 3))


@query("identical_columns", """
select duplicate, original from (values ('copy', 'l_quantity'), ('again', 'l_tax'))
  v(duplicate, original) where (select count(*) from lineitem) > 0""")
def identical_columns(fx):
    # Rows have no unique key, so the whole row stands in for one.
    lines = fx.raw("lineitem").withColumns({
        "copy": F.col("l_quantity"), "again": F.col("l_tax"),
        "row_id": F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                              "l_shipdate")})
    return pairs.identical_columns(lines, [*_NUMERIC, "copy", "again"], "row_id")


@query("pruned_columns", """
select 'l_discount,l_extendedprice,l_linenumber,l_orderkey,l_quantity,l_tax' as kept,
       count(*) as row_count from lineitem""")
def pruned_columns(fx):
    lines = fx.raw("lineitem").select("l_orderkey", *_NUMERIC).withColumns({
        "copy": F.col("l_quantity"), "fixed": F.lit(1)})
    names = [*_NUMERIC, "copy", "fixed"]
    kept = pairs.prune(lines, pairs.feature_audit(lines, names),
                       pairs.identical_columns(lines, names, "l_orderkey"))
    return kept.agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "kept", F.lit(",".join(sorted(kept.columns))))


@query("reference_ambiguity", """
select bank_record_id, true_similarity, max_wrong_similarity,
       cast(coalesce(max_wrong_similarity >= true_similarity - 0.03::double, false) as bigint)
         as wrong_within,
       cast(coalesce(max_wrong_similarity >= true_similarity, false) as bigint) as wrong_overtakes
from (select l_orderkey as bank_record_id,
             max(l_discount) filter (l_linenumber = 1) as true_similarity,
             max(l_discount) filter (l_linenumber <> 1) as max_wrong_similarity
      from lineitem group by 1) where true_similarity is not null""")
def reference_ambiguity(fx):
    rows = fx.raw("lineitem").select(
        F.col("l_orderkey").alias("bank_record_id"), F.col("l_discount").alias("utr_similarity"),
        (F.col("l_linenumber") == 1).cast("int").alias("label"))
    return pairs.ambiguity(rows)


SPLIT_SQL = """
select l_orderkey, case when share <= 0.70 then 'train' when share <= 0.85 then 'validation'
         else 'test' end as split, n as row_count
from (select *, sum(n) over (order by md5(cast(l_orderkey as varchar)), l_orderkey)
               / cast(sum(n) over () as double) as share
      from (select l_orderkey, count(*) as n from lineitem group by 1))"""


@query("grouped_split", SPLIT_SQL)
def grouped_split(fx):
    return pairs.grouped_split(fx.raw("lineitem").select("l_orderkey"), "l_orderkey").groupBy(
        "l_orderkey", "split").agg(F.count(F.lit(1)).alias("row_count"))


@query("split_isolation", """
select splits, 0 as shared from (values ('train-validation'), ('train-test'), ('validation-test'))
  v(splits) where (select count(*) from lineitem) > 0""")
def split_isolation(fx):
    rows = pairs.grouped_split(fx.raw("lineitem").select("l_orderkey"), "l_orderkey")
    return pairs.split_overlap(rows, "l_orderkey")


# --- evaluation -------------------------------------------------------------------------

SCORED_SQL = """
select l.doc_id, l.quality as label,
       round(0.3::double * l.quality + 0.7::double * ((d.n_chars * 37 % 1000) / 1000.0::double), 3)
         as score
from labels l join documents d on d.doc_id = l.doc_id"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Sums of doubles depend on row order in the last digit, so they are compared rounded."""
    return df.withColumns({n: F.round(n, 9) for n in names})


def scored(fx) -> DataFrame:
    noise = (F.col("n_chars") * 37 % 1000) / 1000.0
    return fx.raw("labels").join(fx.raw("documents"), "doc_id").select(
        "doc_id", F.col("quality").alias("label"),
        F.round(0.3 * F.col("quality") + 0.7 * noise, 3).alias("score"))


def _rates_sql(tp: str, fp: str, fn: str, tn: str) -> str:
    def r(a, b):
        return f"coalesce(cast({a} as double) / nullif({b}, 0), 0)"

    f1, f0 = r(f"2 * {tp}", f"(2 * {tp} + {fp} + {fn})"), r(f"2 * {tn}",
                                                          f"(2 * {tn} + {fp} + {fn})")
    return f"""{r(f'({tp} + {tn})', f'({tp} + {tn} + {fp} + {fn})')} as accuracy,
       {r(tp, f'({tp} + {fp})')} as precision, {r(tp, f'({tp} + {fn})')} as recall, {f1} as f1,
       ({f1} + {f0}) / 2 as macro_f1,
       {r(f'({tp} + {fp})', f'({tp} + {fp} + {tn} + {fn})')} as predicted_positive_rate,
       {tp} as tp, {fp} as fp, {fn} as fn, {tn} as tn"""


GRID_SQL = f"""
select threshold, {_rates_sql('a', 'b', 'c', 'd')} from (
  select threshold, count(*) filter (score >= threshold and label = 1) as a,
         count(*) filter (score >= threshold and label = 0) as b,
         count(*) filter (score < threshold and label = 1) as c,
         count(*) filter (score < threshold and label = 0) as d
  from (select round(0.01::double + i * 0.005::double, 3) as threshold from range(197) t(i))
  cross join ({SCORED_SQL}) group by 1)"""
QUALITY_SQL = f"""
select sum(pos * up / (up + un)) / sum(pos) as pr_auc,
       sum(neg * (up - pos / 2.0::double)) / (sum(pos) * sum(neg)) as roc_auc
from (select *, cast(sum(pos) over w as double) as up, cast(sum(neg) over w as double) as un
      from (select score, cast(sum(label) as double) as pos,
                   cast(sum(1 - label) as double) as neg from ({SCORED_SQL}) group by 1)
      window w as (order by score desc))"""


@query("threshold_grid", GRID_SQL)
def threshold_grid(fx):
    return evaluate.threshold_grid(scored(fx))


@query("best_threshold", f"select * from ({GRID_SQL}) order by macro_f1 desc, threshold limit 1")
def best_threshold(fx):
    return evaluate.best_threshold(scored(fx))


@query("binary_metrics", f"""
select {_rates_sql('a', 'b', 'c', 'd')}, round(pr_auc, 9) as pr_auc,
       round(roc_auc, 9) as roc_auc, 0.275::double as threshold
from (select count(*) filter (score >= 0.275 and label = 1) as a,
             count(*) filter (score >= 0.275 and label = 0) as b,
             count(*) filter (score < 0.275 and label = 1) as c,
             count(*) filter (score < 0.275 and label = 0) as d from ({SCORED_SQL})),
     ({QUALITY_SQL})""")
def binary_metrics(fx):
    return _rounded(evaluate.binary_metrics(scored(fx), vocab.MATCH_THRESHOLD), "pr_auc",
                    "roc_auc")


@query("prediction_rows", f"""
select doc_id, label, score, cast(score >= 0.275 as bigint) as predicted,
       cast((score >= 0.275)::integer = label as bigint) as correct from ({SCORED_SQL})""")
def prediction_rows(fx):
    return learn.predictions(scored(fx), vocab.MATCH_THRESHOLD)


CLASSED_SQL = """
select event_id, event_type as actual, case when event_id % 5 = 0 then 'click'
         when event_id % 9 = 0 then 'view' else event_type end as predicted from events"""


def classed(fx) -> DataFrame:
    n = F.col("event_id")
    guess = F.when(n % 5 == 0, "click").when(n % 9 == 0, "view").otherwise(F.col("event_type"))
    return fx.raw("events").select("event_id", F.col("event_type").alias("actual"),
                                   guess.alias("predicted"))


REPORT_SQL = f"""
select class, support, coalesce(hits / nullif(cast(claimed as double), 0), 0) as precision,
       coalesce(hits / nullif(cast(support as double), 0), 0) as recall,
       coalesce(2 * hits / nullif(cast(support + claimed as double), 0), 0) as f1,
       support - hits as errors
from (select class, count(*) filter (actual = class) as support,
             count(*) filter (predicted = class) as claimed,
             count(*) filter (actual = class and predicted = class) as hits
      from ({CLASSED_SQL}), (select distinct actual as class from ({CLASSED_SQL}) union
                             select predicted from ({CLASSED_SQL})) group by 1)"""


@query("confusion_cells", f"""
select actual, predicted, count(*) as row_count from ({CLASSED_SQL}) group by 1, 2""")
def confusion_cells(fx):
    return evaluate.confusion(classed(fx))


@query("confusion_matrix", f"""
select actual, count(*) filter (predicted = 'click') as click,
       count(*) filter (predicted = 'view') as "view",
       count(*) filter (predicted = 'error') as error from ({CLASSED_SQL}) group by 1""")
def confusion_matrix(fx):
    return evaluate.confusion_matrix(classed(fx), ["click", "view", "error"])


@query("class_report", REPORT_SQL)
def class_report(fx):
    return evaluate.class_report(classed(fx))


@query("multiclass_metrics", f"""
select round(sum(support - errors) / cast(sum(support) as double), 9) as accuracy,
       round(avg(case when support > 0 then recall end), 9) as balanced_accuracy,
       round(avg(precision), 9) as macro_precision, round(avg(recall), 9) as macro_recall,
       round(avg(f1), 9) as macro_f1,
       round(sum(f1 * support) / sum(support), 9) as weighted_f1 from ({REPORT_SQL})""")
def multiclass_metrics(fx):
    found = evaluate.multiclass_metrics(classed(fx))
    return _rounded(found, *found.columns)


def _probabilities(fx) -> DataFrame:
    n = F.col("event_id")
    a, b = (n % 7) / 10.0, (n % 3) / 10.0
    return fx.raw("events").select(
        "event_id", F.when(n % 2 == 0, "x").otherwise("y").alias("actual"),
        F.create_map(F.lit("x"), F.round(a, 3), F.lit("y"), F.round(b, 3), F.lit("z"),
                     F.round(1 - a - b, 3)).alias("p"))


PROBS_SQL = """
select event_id, case when event_id % 2 = 0 then 'x' else 'y' end as actual,
       round((event_id % 7) / 10.0::double, 3) as px, round((event_id % 3) / 10.0::double, 3) as py,
       round(1 - (event_id % 7) / 10.0::double - (event_id % 3) / 10.0::double, 3) as pz
from events"""


@query("least_confident", f"""
select event_id, round(s[1], 3) as top, round(s[2], 3) as second, round(s[1] - s[2], 3) as margin
from (select event_id, list_reverse_sort([px, py, pz]) as s from ({PROBS_SQL}))
order by round(s[1] - s[2], 9), event_id limit 50""")
def least_confident(fx):
    judged = evaluate.confidence(_probabilities(fx), "p").withColumn("margin",
                                                                     F.round("margin", 9))
    few = evaluate.least_confident(judged, "event_id")
    return few.select("event_id", *[F.round(c, 3).alias(c) for c in ("top", "second", "margin")])


SUMMARY = ["mean", "std", "min", "q1", "median", "q3", "max"]


def summary_sql(value: str) -> str:
    facts = {"mean": f"avg({value})", "std": f"stddev_samp({value})", "min": f"min({value})",
             "q1": f"quantile_cont({value}, 0.25)", "median": f"quantile_cont({value}, 0.5)",
             "q3": f"quantile_cont({value}, 0.75)", "max": f"max({value})"}
    return f"count({value}) as row_count, " + ", ".join(
        f"round(cast({facts[n]} as double), 6) as {n}" for n in SUMMARY)


@query("confidence_summary", "\nunion all\n".join(
    f"select actual, '{name}' as value_name, {summary_sql(value)} from (select actual, "
    f"list_reverse_sort([px, py, pz]) as s from ({PROBS_SQL})) group by actual"
    for name, value in (("top", "s[1]"), ("second", "s[2]"), ("margin", "(s[1] - s[2])"))))
def confidence_summary(fx):
    judged = evaluate.confidence(_probabilities(fx), "p")
    found = evaluate.described(judged, ["actual"], ["top", "second", "margin"])
    return found.select("actual", "value_name", "row_count", *[F.round(c, 6).alias(c) for c in SUMMARY])


def _auc_sql(rows: str) -> str:
    return f"""
select sum(neg * (up - pos / 2.0::double)) / nullif(sum(pos) * sum(neg), 0) as roc_auc
from (select *, cast(sum(pos) over (order by score desc) as double) as up
      from (select score, cast(sum(label) as double) as pos, cast(sum(1 - label) as double) as neg
            from ({rows}) group by 1))"""


@query("one_vs_rest_auc", "\nunion all\n".join(
    f"select '{c}' as class, round((" + _auc_sql(
        f"select p{c} as score, cast(actual = '{c}' as integer) as label from ({PROBS_SQL})")
    + "), 9) as roc_auc" for c in "xyz"))
def one_vs_rest_auc(fx):
    return _rounded(evaluate.one_vs_rest_auc(_probabilities(fx), "p"), "roc_auc")


@query("feature_ranking", "\nunion all\n".join(
    f"select l_returnflag as split, '{c}' as feature, count(distinct {c}) as nunique, "
    f"avg(case when {c} <> 0 then (l_linestatus = 'O')::integer end) as positive_rate_when_set, "
    f"(select round(sum(neg * (up - pos / 2.0::double)) / (sum(pos) * sum(neg)), 9) from (select *, "
    f"cast(sum(pos) over (order by s desc) as double) as up from (select {c} as s, "
    f"cast(count(*) filter (l_linestatus = 'O') as double) as pos, "
    f"cast(count(*) filter (l_linestatus <> 'O') as double) as neg from lineitem i "
    f"where i.l_returnflag = o.l_returnflag group by 1))) as roc_auc from lineitem o group by 1"
    for c in ("l_discount", "l_tax")))
def feature_ranking(fx):
    rows = fx.raw("lineitem").withColumn("label", (F.col("l_linestatus") == "O").cast("int"))
    found = evaluate.feature_ranking(rows, ["l_discount", "l_tax"], split="l_returnflag")
    return _rounded(found, "roc_auc").withColumnRenamed("l_returnflag", "split")


@query("single_flag_diagnostic", """
select toxic as flag, count(*) as row_count, 1 - avg(quality) as share_0, avg(quality) as share_1,
       (select avg((toxic = quality)::integer) from labels) as accuracy
from labels group by 1""")
def single_flag_diagnostic(fx):
    return evaluate.single_flag_diagnostic(fx.raw("labels"), "toxic", "quality")


@query("missing_shares", """
select 'reference' as column_name, avg((reference is null)::integer) * 100 as missing_percent
from t_bank_records union all
select 'category', avg((category is null)::integer) * 100 from t_bank_records""")
def missing_shares(fx):
    return evaluate.missing_shares(fx.bank_records, ["reference", "category"])


@query("class_taxonomy", """
select event_type as class, count(*) as row_count,
       case when event_type in ('click', 'view') then 'OK' else 'UNKNOWN' end as state
from events group by 1 union all select 'never', 0, 'EMPTY'""")
def class_taxonomy(fx):
    return evaluate.unknown_classes(fx.raw("events"), "event_type", ["click", "view", "never"])


@query("probability_bands", f"""
select doc_id, case when score > 0.85 then 'AUTO_MATCH' when score >= 0.50 then 'REVIEW'
         else 'REJECT' end as band from ({SCORED_SQL})""")
def probability_bands(fx):
    return scored(fx).select("doc_id", exceptions.probability_band(F.col("score")).alias("band"))


@query("score_decisions", f"""
with s as ({SCORED_SQL}), r as (
  select doc_id % 50 as grp, doc_id, score, row_number() over (partition by doc_id % 50
    order by score desc, doc_id) as k from s),
t as (select grp, max(doc_id) filter (k = 1) as top_id, max(score) filter (k = 1) as top,
             max(score) filter (k = 2) as runner from r group by 1)
select grp as bank_record_id, case when top < 0.275 then 'UNMATCHED'
         when coalesce(top - runner < 0.08 and runner >= 0.1375, false) then 'AMBIGUOUS'
         else 'MATCHED_ML' end as status,
       case when top >= 0.275 then cast(top_id as varchar) end as matched_record_id,
       top as match_probability, runner as runner_up_probability,
       round(top - runner, 6) as confidence_margin
from t""")
def score_decisions(fx):
    """The ranking decision over given scores, grouped fifty ways."""
    none = F.lit(None)
    rows = scored(fx).select(
        (F.col("doc_id") % 50).alias("bank_record_id"),
        F.col("doc_id").cast("string").alias("target_id"), "score",
        none.cast("double").alias("absolute_amount_difference"),
        none.cast("int").alias("date_difference_days"),
        none.cast("int").alias("reference_exact_match"), none.cast("double")
        .alias("utr_similarity"), none.cast("int").alias("candidate_rank_by_amount"),
        F.col("doc_id").alias("closeness_rank"))
    out = cases.decide_by_score(rows)
    return out.select("bank_record_id", "status", "matched_record_id", "match_probability",
                      "runner_up_probability",
                      F.round("confidence_margin", 6).alias("confidence_margin"))


# --- models -------------------------------------------------------------------------------


def _splits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "test")


@query("match_model_quality")
def match_model_quality(fx):
    train, test = _splits(_training_rows(fx))
    model = learn.fit_matcher(train)
    return evaluate.binary_metrics(learn.score(model, test), vocab.MATCH_THRESHOLD)


@query("match_model_comparison")
def match_model_comparison(fx):
    train, test = _splits(_training_rows(fx))
    found = {}
    for kind in ("logistic_regression", "random_forest", "gradient_boosting"):
        model = learn.fit_matcher(train, kind=kind, trees=20)
        found[kind] = evaluate.binary_metrics(learn.score(model, test), 0.5)
    return evaluate.compare_models(found, ["macro_f1", "pr_auc", "roc_auc"])


@query("match_model_ablation")
def match_model_ablation(fx):
    train, test = _splits(_training_rows(fx))
    out = []
    for name, group in learn.feature_groups(vocab.MATCH_FEATURES).items():
        numeric = [f for f in group if f not in vocab.MATCH_CATEGORICAL]
        model = learn.fit_matcher(train, numeric)
        rows = evaluate.binary_metrics(learn.score(model, test, numeric), 0.5)
        out.append(rows.select(F.lit(name).alias("feature_group"),
                               F.lit(len(numeric)).alias("features"), "macro_f1", "pr_auc",
                               "roc_auc"))
    return reduce(DataFrame.unionByName, out)


def _exception_rows(fx) -> DataFrame:
    def build() -> DataFrame:
        log = written(_changes(fx)[1], "change-log")
        return exceptions.training_rows(log, derive.label_changes(log))

    return fx.stored("exception_rows", build)


@query("exception_model_quality")
def exception_model_quality(fx):
    rows = _exception_rows(fx).withColumn("split", F.when(
        augment.draw("record_id", "split") < 0.7, "train").otherwise("test"))
    train, test = _splits(rows)
    labelled = learn.classifier(learn.fit_classifier(train))(test)
    return evaluate.multiclass_metrics(labelled, "exception_class", "exception_type")


@query("bank_cases_with_models")
def bank_cases_with_models(fx):
    matcher = learn.fit_matcher(_splits(_training_rows(fx))[0])
    labeller = learn.fit_classifier(_exception_rows(fx))
    found = cases.reconcile_bank(fx.bank_records, fx.settlements, learn.scorer(matcher),
                                 learn.classifier(labeller))
    explained = exceptions.explain_class(found)
    return explained.select("source_record_id", "status", "reconciliation_method",
                            "matched_record_id", "match_probability", "exception_type",
                            "severity", F.array_join("reason_codes", ",").alias("reason_codes"))


@query("exception_features")
def exception_features(fx):
    routed = fx.bank_records.join(
        fx.settlements.select(*[F.col(c).alias(f"s_{c}") for c in (
            "settlement_id", "net_amount", "settlement_date", "utr", "total_fees",
            "total_fee_tax", "total_refunds", "total_adjustments")]),
        F.col("settlement_id") == F.col("s_settlement_id"), "left")
    found = exceptions.exception_features(exceptions.route_bank(routed))
    return found.select("bank_record_id", *vocab.EXCEPTION_FEATURES)


@query("exception_routing", """
select bank_record_id, case when s.settlement_id is null then 'settlement_id'
         when abs(b.amount - s.net_amount) >= 0.01 then 'amount'
         when coalesce(abs(datediff('day', transaction_date, cast(settlement_date as date))), 0)
              <> 0 then 'transaction_date'
         when upper(regexp_replace(coalesce(reference, ''), '[^A-Za-z0-9]', '', 'g')) <> upper(utr)
              then 'reference' else 'description' end as affected_field
from t_bank_records b left join t_settlements s on s.settlement_id = b.settlement_id""")
def exception_routing(fx):
    routed = fx.bank_records.join(
        fx.settlements.select(*[F.col(c).alias(f"s_{c}") for c in (
            "settlement_id", "net_amount", "settlement_date", "utr", "total_fees",
            "total_fee_tax", "total_refunds", "total_adjustments")]),
        F.col("settlement_id") == F.col("s_settlement_id"), "left")
    return exceptions.route_bank(routed).select("bank_record_id", "affected_field")


@query("inferred_fields", """
select l_orderkey, l_partkey, l_suppkey, l_linenumber,
       case when d <> 0 and g = 0 then 'transaction_date' when g <> 0 then 'amount'
            else 'utr' end as field
from (select *, l_linenumber % 2 as d, cast(l_quantity % 3 as bigint) as g from lineitem)""")
def inferred_fields(fx):
    text = F.col("l_returnflag")
    field = exceptions.infer_field(
        F.lower(text), text, (F.col("l_quantity") % 3), F.col("l_linenumber") % 2, F.lit("utr"))
    return fx.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                     field.alias("field"))


@query("case_model_facts", """
select payment_id as source_record_id, cast(null as double) as match_probability,
       cast(null as varchar) as exception_type from t_payments""")
def case_model_facts(fx):
    found = cases.reconcile_payments(fx.all())
    facts = cases.model_facts(found).join(found.select("case_id", "source_record_id"), "case_id")
    return facts.select("source_record_id", "match_probability", "exception_type")
