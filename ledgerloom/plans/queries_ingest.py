"""Scans, mappings, normalisation, validation, deduplication and loads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import MONEY
from ledgerloom.functions.identifiers import canonical_id, padded
from ledgerloom.operators import canonicalize as canon
from ledgerloom.operators import dedup, normalize, validate
from ledgerloom.operators.derive import id_number
from ledgerloom.plans.catalog import query
from ledgerloom.plans.fixtures import every, money
from ledgerloom.plans.queries_functions import (
    sql_amount, sql_canonical, sql_currency, sql_instant, sql_lookup_key, sql_narration)
from ledgerloom.plans.tables_sql import num, pid
from ledgerloom.session import staging_path
from ledgerloom.sources import files, layouts, tables

# --- scans ------------------------------------------------------------------------


def _event_lines(fx) -> DataFrame:
    n = F.col("event_id")
    record = F.to_json(F.struct(n.cast("string").alias("id"), F.col("event_type").alias("kind"),
                                F.col("value").cast(MONEY).cast("string").alias("amount")))
    line = (F.when(every(n, 13), F.concat(F.lit('{"id": "'), n.cast("string")))
            .when(every(n, 17), F.lit("   ")).when(every(n, 19), F.lit("[1, 2]"))
            .otherwise(F.concat(F.lit("  "), record)))
    return fx.raw("events").select("event_id", line.alias("value"))


@query("json_line_scan", """
select event_id, case when bad is null then cast(event_id as varchar) end as id,
       case when bad is null then event_type end as kind,
       case when bad is null then cast(cast(value as decimal(15,2)) as varchar) end as amount,
       bad as raw_text
from (select *, case when event_id % 13 = 0 then '{"id": "' || event_id
                     when event_id % 19 = 0 then '[1, 2]' end as bad
      from events where event_id % 17 <> 0 or event_id % 13 = 0)""")
def json_line_scan(fx):
    rows = files.parse_json_lines(_event_lines(fx), files.text_schema(["id", "kind", "amount"]))
    return rows.withColumnRenamed(files.CORRUPT, "raw_text")


@query("json_document_scan", """
select event_id, unnest(case event_id % 3 when 0 then [cast(event_id as varchar)]
         when 1 then [cast(event_id as varchar), event_type] else [null] end) as id,
       case when event_id % 3 = 2 then cast(event_id as varchar) end as raw_text
from events""")
def json_document_scan(fx):
    n = F.col("event_id")
    one = F.concat(F.lit('{"id": "'), n.cast("string"), F.lit('"}'))
    doc = (F.when(every(n, 3), one)
           .when(every(n, 3, 1), F.concat(F.lit("["), one, F.lit(', {"id": "'),
                                          F.col("event_type"), F.lit('"}]')))
           .otherwise(n.cast("string")))
    docs = fx.raw("events").select("event_id", doc.alias("value"))
    return files.parse_json_documents(docs, files.text_schema(["id"])).withColumnRenamed(
        files.CORRUPT, "raw_text")


@query("delimited_row_scan", """
select event_id, event_type as kind, cast(cast(value as decimal(15,2)) as varchar) as amount,
       case when event_id % 2 = 0 then 'x;y' else '' end as note
from events where event_id % 11 <> 0""")
def delimited_row_scan(fx):
    n = F.col("event_id")
    line = F.when(every(n, 11), F.lit(" , ,")).otherwise(F.concat(
        F.lit(" "), "event_type", F.lit(" ,"), F.col("value").cast(MONEY).cast("string"),
        F.lit(" , "), F.when(every(n, 2), F.lit("x;y")).otherwise(F.lit(""))))
    rows = files.parse_delimited(fx.raw("events").select("event_id", line.alias("value")),
                                 ["kind", "amount", "note"])
    return rows.withColumn("note", F.coalesce("note", F.lit("")))


@query("file_round_trip", """
select file, row_number, amount, transaction_date, reference, description
from (select *, row_number() over (partition by file order by bank_record_id) as k
      from t_raw_bank)""")
def file_round_trip(fx):
    """The raw feed written as JSON lines to the shared folder and scanned back."""
    path = staging_path(fx.spark, "feed")
    fields = ["row_number", "amount", "transaction_date", "reference", "description", "file"]
    fx.raw_bank.select(*[F.col(c).cast("string").alias(c) for c in fields]).write.json(path)
    rows = files.read_json_lines(fx.spark, path, files.text_schema(fields))
    return rows.select("file", F.col("row_number").cast("bigint").alias("row_number"), "amount",
                       "transaction_date", "reference", "description")


# The text column carries quotes, separators, line breaks and backslashes.
@query("csv_round_trip", r"""
select row_number, bank_record_id, amount, currency, md5(note) as note from (
  select row_number, trim(bank_record_id) as bank_record_id, amount,
         case when currency = '' then null else currency end as currency,
         '"' || replace(text, '. ', '", \ ') || '\' || chr(10) || '"x"' as note
  from t_raw_bank join documents on doc_id = row_number)""")
def csv_round_trip(fx):
    """The raw feed, with a document's text to each row, written as CSV and scanned back."""
    path = staging_path(fx.spark, "csv")
    text = F.replace("text", F.lit(". "), F.lit('", \\ '))
    notes = fx.raw("documents").select(
        F.col("doc_id").alias("row_number"),
        F.concat(F.lit('"'), text, F.lit('\\\n"x"')).alias("note"))
    fx.raw_bank.join(notes, "row_number").select(
        "row_number", "bank_record_id", "amount", "currency", "note").write.option(
        "header", True).option("emptyValue", "").option("escape", '"').csv(path)
    rows = files.read_csv(fx.spark, path, encoding="UTF-8", required=["bank_record_id", "amount"])
    return rows.withColumn("row_number", F.col("row_number").cast("bigint")).withColumn(
        "note", F.md5("note"))


@query("csv_delimiter_detected", """
select row_number, bank_record_id, amount, currency from (
  select row_number, trim(bank_record_id) as bank_record_id, amount,
         case when currency = '' then null else currency end as currency from t_raw_bank)""")
def csv_delimiter_detected(fx):
    """The raw feed written with semicolons and scanned with the delimiter its head shows."""
    path = staging_path(fx.spark, "csv")
    fx.raw_bank.select("row_number", "bank_record_id", "amount", "currency").write.option(
        "header", True).option("sep", ";").option("emptyValue", "").csv(path)
    rows = files.read_csv(fx.spark, path, sep=files.detect_delimiter(fx.spark, path),
                          required=["bank_record_id", "amount"])
    return rows.withColumn("row_number", F.col("row_number").cast("bigint"))


@query("rebuilt_tables", """
select 'merchants' as table_name, count(*) as row_count from t_merchants
union all select 'orders', count(*) from t_orders
union all select 'payments', count(*) from t_payments""")
def rebuilt_tables(fx):
    """Tables replaced twice in the shared folder, then counted."""
    path = staging_path(fx.spark, "rebuilt")
    held = {"merchants": fx.merchants, "orders": fx.orders, "payments": fx.payments}
    for _ in range(2):
        tables.rebuild(held, path)
    return tables.row_counts({name: fx.spark.read.parquet(f"{path}/{name}") for name in held})


@query("exported_splits", """
select split, count(*) as features, count(*) as traced, round(sum(cast(amount as double)), 2) as total
from (select amount, case status when 'CAPTURED' then 'train' else 'test' end as split
      from t_payments) group by 1""")
def exported_splits(fx):
    """Payments split by status, exported as CSV and read again."""
    path = staging_path(fx.spark, "splits")
    split = F.when(F.col("status") == "CAPTURED", "train").otherwise("test")
    rows = fx.payments.select(split.alias("split"), "payment_id", "amount")
    tables.export_splits(rows, ["amount"], ["payment_id"], path)
    read = fx.spark.read.option("header", True)
    out = read.csv(f"{path}/splits").groupBy("split").agg(
        F.count("amount").alias("features"), F.round(F.sum(F.col("amount").cast("double")), 2)
        .alias("total"))
    traced = read.csv(f"{path}/trace").groupBy("split").agg(F.count("payment_id").alias("traced"))
    return out.join(traced, "split")


@query("listed_files", """
select 'csv' as kind, cast(count(*) > 0 as bigint) as any_file, 0 as problems from documents
union all select 'txt', cast(count(*) > 0 as bigint), 0 from documents""")
def listed_files(fx):
    """Files written from documents, listed with what is wrong with them."""
    out = []
    for kind in ("csv", "txt"):
        path = staging_path(fx.spark, f"list-{kind}")
        ids = fx.raw("documents").select(F.col("doc_id").cast("string").alias("value"))
        (ids.write.csv if kind == "csv" else ids.write.text)(path)
        found = files.list_files(fx.spark, path, [f".{kind}"])
        out.append(found.agg(
            F.lit(kind).alias("kind"), (F.count(F.lit(1)) > 0).alias("any_file"),
            F.count("problem").alias("problems")))
    return out[0].unionByName(out[1])


@query("document_admission", """
select doc_id, name from (
  select doc_id, text, case doc_id % 6 when 0 then 'guide.md' when 1 then 'notes.txt'
      when 2 then 'keys.secret.md' when 3 then 'page.html' when 4 then '.env.txt'
      else 'readme.rst' end as name from documents)
where name in ('guide.md', 'notes.txt', 'readme.rst') and trim(text) <> ''""")
def document_admission(fx):
    n = F.col("doc_id")
    names = ["guide.md", "notes.txt", "keys.secret.md", "page.html", ".env.txt", "readme.rst"]
    name = F.element_at(F.array(*[F.lit(x) for x in names]), (n % 6 + 1).cast("int"))
    docs = fx.raw("documents").select("doc_id", "text", name.alias("name"))
    return docs.filter(files.allowed_document(F.col("name"), F.col("text"))).select(
        "doc_id", "name")


@query("webhook_envelopes", """
select event_id, case when event_id % 7 in (5, 6) then null else
         case event_id % 7 when 0 then 'payment.captured' when 1 then 'refund.created'
              when 2 then 'settlement.processed' when 3 then 'payment.failed'
              else 'order.paid' end end as event,
       case event_id % 7 when 0 then 'payment' when 1 then 'refund' when 2 then 'settlement'
            when 3 then 'payment' end as entity_type,
       case when event_id % 7 < 4 then cast(event_id as varchar) end as entity_id,
       case event_id % 7 when 5 then 'missing required fields: event,entity'
            when 6 then 'not valid JSON' end as problem
from events""")
def webhook_envelopes(fx):
    n, s = F.col("event_id"), F.col("event_id").cast("string")

    def body(event: str, part: str):
        return F.concat(F.lit(f'{{"event": "{event}", "entity": "event", "payload": '
                              f'{{"{part}": {{"entity": {{"id": "'), s, F.lit('"}}}}'))

    text = (F.when(every(n, 7, 0), body("payment.captured", "payment"))
            .when(every(n, 7, 1), body("refund.created", "refund"))
            .when(every(n, 7, 2), body("settlement.processed", "settlement"))
            .when(every(n, 7, 3), body("payment.failed", "payment"))
            .when(every(n, 7, 4), body("order.paid", "order"))
            .when(every(n, 7, 5), F.lit('{"payload": {}}')).otherwise(F.lit("not json")))
    out = files.parse_webhooks(fx.raw("events").select("event_id", text.alias("value")))
    return out.select("event_id", "event", "entity_type",
                      F.get_json_object("entity", "$.id").alias("entity_id"), "problem")


@query("api_responses", """
select event_id, case when event_id % 4 in (0, 1) then event_type end as kind,
       case event_id % 4 when 2 then 'API returned error: ' || event_type
            when 3 then 'API returned error: Unknown error' end as problem
from events""")
def api_responses(fx):
    n = F.col("event_id")
    kind = F.col("event_type")
    text = (F.when(n % 4 < 2, F.concat(F.lit('{"kind": "'), kind, F.lit('"}')))
            .when(every(n, 4, 2), F.concat(F.lit('{"error": {"description": "'), kind,
                                           F.lit('"}}')))
            .otherwise(F.lit('{"error": {"code": 1}}')))
    out = files.parse_api_responses(fx.raw("events").select("event_id", text.alias("value")))
    return out.select("event_id", F.get_json_object("body", "$.kind").alias("kind"), "problem")


# --- layouts ----------------------------------------------------------------------


@query("layout_detection", """
select event_id,
       case event_id % 6 when 0 then 'SYNTHETIC_PAYMENT' when 1 then 'SYNTHETIC_ORDER'
            when 2 then 'RAZORPAY_PAYMENT' when 3 then 'BANK_STATEMENT_CSV'
            when 4 then 'GST_PORTAL' else 'UNKNOWN' end as by_fields,
       case event_id % 6 when 0 then 'SYNTHETIC_PAYMENT' when 1 then 'SYNTHETIC_ORDER'
            when 2 then 'SYNTHETIC_BANK' when 3 then 'SYNTHETIC_FEE'
            when 4 then 'SYNTHETIC_GST' end as by_name
from events""")
def layout_detection(fx):
    n = F.col("event_id")
    keys = [
        ["payment_id", "order_id", "gateway", "merchant_id", "total_amount"],
        ["order_id", "merchant_id", "total_amount", "status"],
        ["id", "entity", "amount", "currency", "method", "fees", "tax"],
        ["date", "narration", "debit", "credit", "balance"],
        ["gstin", "return_period", "taxable_value"],
        ["something", "else"],
    ]
    names = ["settlement_payments.jsonl", "Order-list.csv", "bank-records.jsonl", "FEES.csv",
             "gst_records.jsonl", "readme.txt"]
    place = (n % 6 + 1).cast("int")
    held = F.element_at(F.array(*[F.array(*[F.lit(k) for k in ks]) for ks in keys]), place)
    name = F.element_at(F.array(*[F.lit(x) for x in names]), place)
    return fx.raw("events").select("event_id", layouts.layout_of_keys(held).alias("by_fields"),
                                   layouts.layout_of_name(name).alias("by_name"))


@query("bank_statement_mapping", """
select transaction_date, description, reference, balance_after,
       case when event_id % 9 = 0 then null when event_id % 2 = 0 then credit else debit end
         as amount,
       case when event_id % 9 = 0 then null when event_id % 2 = 0 then 'CREDIT' else 'DEBIT' end
         as transaction_type,
       'BANK_STATEMENT_HDFC' as _source, reference as _source_record_id
from (select event_id, strftime(ts, '%d/%m/%Y') as transaction_date, event_type as description,
             'R' || event_id as reference, '1,000.00' as balance_after,
             cast(cast(1000 + abs(value) as decimal(15,2)) as varchar) as credit,
             cast(cast(abs(value) as decimal(15,2)) as varchar) as debit
      from events)""")
def bank_statement_mapping(fx):
    n = F.col("event_id")
    plain = F.abs("value").cast(MONEY).cast("string")
    thousand = F.concat(F.lit("1,"), F.lpad(
        F.abs("value").cast("decimal(9,2)").cast("string"), 6, "0"))
    large = (F.abs("value") + 1000).cast(MONEY).cast("string")
    credit = F.when(every(n, 2), F.when(F.abs("value") < 999, thousand).otherwise(large))
    statement = fx.raw("events").select(
        F.date_format("ts", "dd/MM/yyyy").alias("Date"), F.col("event_type").alias("Narration"),
        F.concat(F.lit("R"), n.cast("string")).alias("Chq./Ref.No."),
        F.when(every(n, 9), F.lit("?")).when(~every(n, 2), plain).otherwise("")
        .alias("Withdrawal Amt."),
        credit.alias("Deposit Amt."), F.lit("1,000.00").alias("Closing Balance"))
    mapped = layouts.map_bank_statement(statement)
    return mapped.select("transaction_date", "description", "reference", "balance_after",
                         "amount", "transaction_type", "_source", "_source_record_id")


@query("alias_mapping", """
select invoice_id, invoice_number, cast(total_amount as varchar) as total_amount,
       cast(total_tax as varchar) as total_tax, seller_gstin, 'SYNTHETIC_INVOICE' as _source,
       invoice_id as _source_record_id
from t_invoices""")
def alias_mapping(fx):
    """Accounting-export names, where the last accepted name present wins."""
    export = fx.invoices.select(
        "invoice_id", F.lit("old").alias("Invoice_No"), F.col("invoice_number").alias("BILL_NO"),
        F.lit("0").alias("total"), F.col("total_amount").cast("string").alias(" Net_Amount "),
        F.col("total_tax").cast("string").alias("tax_amount"),
        F.col("seller_gstin").alias("gst_no"))
    return layouts.map_invoices(export)


@query("tax_and_ledger_mapping", """
select g.gst_record_id, g.buyer_gstin, cast(g.taxable_amount as varchar) as taxable_amount,
       cast(g.igst as varchar) as igst, g.filing_period, 'GST_EXPORT' as _source, 'tax' as kind
from t_gst_records g
union all
select entry_id, account_name, cast(debit as varchar), cast(credit as varchar), entry_type,
       'SYNTHETIC_BOOK', 'ledger' from t_books""")
def tax_and_ledger_mapping(fx):
    portal = fx.gst_records.select(
        "gst_record_id", F.col("buyer_gstin").alias("gstin_of_recipient"),
        F.col("taxable_amount").cast("string").alias("Taxable_Value"),
        F.col("igst").cast("string").alias("integrated_tax"),
        F.col("filing_period").alias("return_period"), F.lit("GST_EXPORT").alias("_source"))
    tax = layouts.map_gst(portal).drop("_source_record_id").withColumn("kind", F.lit("tax"))
    export = fx.books.select(
        "entry_id", F.col("account_name").alias("Ledger_Name"),
        F.col("debit").cast("string").alias("dr_amount"),
        F.col("credit").cast("string").alias("cr_amount"),
        F.col("entry_type").alias("voucher_type"))
    ledger = layouts.map_books(export).select(
        F.col("entry_id").alias("gst_record_id"), F.col("account_name").alias("buyer_gstin"),
        F.col("debit").alias("taxable_amount"), F.col("credit").alias("igst"),
        F.col("entry_type").alias("filing_period"), "_source", F.lit("ledger").alias("kind"))
    return tax.select(*ledger.columns).unionByName(ledger)


@query("gateway_payment_mapping", """
select 'pay_' || event_id as payment_id,
       cast(cast(user_id * 7 as decimal(20,2)) / 100 as decimal(20,2))::varchar as amount_paise,
       strftime(make_timestamp(cast(1700000000000000 + event_id * 1000000 as bigint)),
                '%Y-%m-%dT%H:%M:%S+00:00') as created_at_unix,
       event_type as card_network, 'RAZORPAY_PAYMENT' as _source,
       'pay_' || event_id as _source_record_id
from events""")
def gateway_payment_mapping(fx):
    n = F.col("event_id")
    nested = fx.raw("events").select(
        F.concat(F.lit("pay_"), n.cast("string")).alias("id"),
        (F.col("user_id") * 7).alias("amount"), (n + 1700000000).alias("created_at"),
        F.struct(F.col("event_type").alias("network")).alias("card"))
    return layouts.map_gateway_payments(nested)


@query("gateway_settlement_mapping", """
select event_id, net, fees, speed from (
  select 'setl_' || event_id as event_id,
         cast(cast(user_id * 11 as decimal(20,2)) / 100 as decimal(20,2))::varchar as net,
         cast(cast(user_id as decimal(20,2)) / 100 as decimal(20,2))::varchar as fees,
         event_type as speed from events)""")
def gateway_settlement_mapping(fx):
    n = F.col("event_id").cast("string")
    settle = layouts.map_gateway_settlements(fx.raw("events").select(
        F.concat(F.lit("setl_"), n).alias("id"), (F.col("user_id") * 11).alias("amount"),
        F.col("user_id").alias("fees")))
    refund = layouts.map_gateway_refunds(fx.raw("events").select(
        F.concat(F.lit("setl_"), n).alias("id"), F.col("event_type").alias("speed_processed")))
    return settle.join(refund, settle["settlement_id"] == refund["refund_id"]).select(
        F.col("settlement_id").alias("event_id"), F.col("net_amount_paise").alias("net"),
        F.col("total_fees_paise").alias("fees"), "speed")


_UPLOAD = f"""
select {sql_canonical('bank_record_id')} as bank_record_id,
       {sql_canonical('merchant_id')} as merchant_id,
       cast({sql_amount('amount')} as double) as amount,
       case when upper(transaction_type) in ('CREDIT', 'DEBIT') then upper(transaction_type)
            else 'CREDIT' end as transaction_type,
       reference, case when currency = '' then 'INR' else upper(currency)[1:3] end as currency
from t_raw_bank"""


@query("upload_mapping", _UPLOAD)
def upload_mapping(fx):
    feed = fx.raw_bank.select(
        F.col("bank_record_id").alias("Bank Record ID"), F.col("merchant_id").alias("Merchant-Id"),
        "amount", F.col("transaction_type").alias("Type"),
        F.col("transaction_date").alias("Date"), F.col("reference").alias("Reference / UTR"),
        "currency")
    kind = layouts.upload_kind(None, feed.columns)
    return layouts.map_upload(feed, kind, "feed.csv").select(
        "bank_record_id", "merchant_id", "amount", "transaction_type", "reference", "currency")


@query("upload_rejections", f"""
select problem, count(*) as row_count from (
  select unnest([x for x in [
     case when ({sql_canonical('bank_record_id')}) is null
          then 'MISSING_REQUIRED: bank_record_id' end,
     case when ({sql_canonical('merchant_id')}) is null
          then 'MISSING_REQUIRED: merchant_id' end,
     case when lower(trim(amount)) = 'n/a' then 'MISSING_REQUIRED: amount'
          when ({sql_amount('amount')}) is null then 'AMOUNT_PARSE_ERROR: amount' end] if x is not null]) as problem from t_raw_bank)
group by problem""")
def upload_rejections(fx):
    mapped = layouts.map_upload(fx.raw_bank, "bank_record", "feed.csv")
    problem = F.regexp_replace("problem", r"^(AMOUNT_PARSE_ERROR: amount).*", "$1")
    return (mapped.select(F.explode("_errors").alias("problem")).withColumn("problem", problem)
            .groupBy("problem").agg(F.count(F.lit(1)).alias("row_count")))


@query("merchant_stub_rows", f"""
select distinct m as merchant_id, 'Merchant ' || m as merchant_name, 'GENERAL' as industry,
       '27AABC' || right(replace(m, '_', ''), 7) || 'Z1' as gstin, 'INR' as currency,
       'ACTIVE' as status
from (select {sql_canonical('merchant_id')} as m from t_raw_bank)
where m is not null and m not in (select merchant_id from t_merchants
  where cast(regexp_extract(merchant_id, '([0-9]+)$', 1) as bigint) % 3 <> 0)""")
def merchant_stub_rows(fx):
    feed = fx.raw_bank.select(canonical_id("merchant_id").alias("merchant_id"))
    known = fx.merchants.filter(~every(id_number("merchant_id"), 3))
    return layouts.merchant_stubs(feed, known)


# --- normalisation of a batch -------------------------------------------------------


def _feed(fx) -> DataFrame:
    """Raw feed with repeated ids, repeated bodies and unreadable lines."""
    n = F.col("row_number")
    feed = fx.raw_bank.withColumn("_corrupt", F.lit(None).cast("string"))
    again = feed.filter(every(n, 10)).withColumn("row_number", n + 20000000)
    copied = feed.filter(every(n, 15)).withColumn("bank_record_id", F.concat(
        F.lit("BNK_9"), n.cast("string"))).withColumn("row_number", n + 40000000)
    torn = feed.filter(every(n, 50)).withColumn("row_number", n + 60000000).withColumn(
        "_corrupt", F.concat(F.lit("{"), n.cast("string")))
    return feed.unionByName(again).unionByName(copied).unionByName(torn)


def _batch(fx) -> normalize.Batch:
    return normalize.run_batch(_feed(fx), "bank", "SYNTHETIC_BANK", file="file",
                               row="row_number", corrupt="_corrupt",
                               ingested_at=F.lit("2026-01-01").cast("timestamp"))


FEED_SQL = {
    "t_feed": """
select *, false as torn from t_raw_bank
union all select * replace (row_number + 20000000 as row_number), false from t_raw_bank
  where row_number % 10 = 0
union all select * replace (row_number + 40000000 as row_number,
    'BNK_9' || row_number as bank_record_id), false from t_raw_bank where row_number % 15 = 0
union all select * replace (row_number + 60000000 as row_number), true from t_raw_bank
  where row_number % 50 = 0""",
    "t_marked": """
select *, case when torn then null when key_rank > 1 then 'KEY'
     when row_number() over (partition by key_rank > 1 or torn, body order by file, row_number) > 1
       then 'CONTENT' end as duplicate
from (
  select *, md5(coalesce(lower(trim(amount)), '') || '|' || coalesce(lower(trim(transaction_date)),
         '') || '|' || coalesce(lower(trim(reference)), '') || '|' ||
         coalesce(lower(trim(description)), '')) as body,
       case when torn then 1 else row_number() over (partition by torn, coalesce(bank_record_id,
         'ROW_' || row_number) order by file, row_number) end as key_rank
  from t_feed)""",
    "t_normal": f"""
select *, cast({sql_amount('amount')} as double) as money,
       cast(({sql_instant('transaction_date')}) + to_minutes(330) as date) as day,
       {sql_currency('currency')} as code, upper(transaction_type) as direction,
       {sql_lookup_key('reference')} as ref_key,
       {sql_narration('description')} as narration
from t_marked""",
    "t_judged": f"""
select *, [x for x in [
    case when money is null and lower(trim(amount)) <> 'n/a'
         then 'AMOUNT_PARSE_ERROR: amount: ' || trim(amount) end,
    case when day is null then 'DATE_PARSE_ERROR: transaction_date: ' || transaction_date end,
    case when currency = 'doge' then 'CURRENCY_ERROR: Unrecognized currency ''doge''' end,
    case when merchant_id is null then 'MISSING_REQUIRED: merchant_id' end,
    case when money is null then 'MISSING_REQUIRED: amount' end,
    case when merchant_id is null then 'MISSING_REQUIRED: merchant_id' end,
    case when money is null then 'MISSING_REQUIRED: amount' end,
    case when day is null then 'MISSING_REQUIRED: transaction_date' end,
    case when money < 0 then 'NEGATIVE_AMOUNT: amount=' || cast(cast(money as decimal(15,2))
         as varchar) end,
    case when direction not in ('CREDIT', 'DEBIT')
         then 'INVALID_ENUM: transaction_type=' || direction end] if x is not null] as errors
from t_normal""",
    "t_outcome": """
select *, case when torn then 'parse_error' when duplicate is not null then 'duplicate'
     when len([x for x in errors if regexp_matches(x,
          'MISSING_REQUIRED|ARITHMETIC_FAIL|AMOUNT_PARSE_ERROR')]) > 0 then 'invalid'
     else 'normalized' end as outcome
from t_judged""",
}


@query("feed_duplicates", """
select file, row_number, coalesce(bank_record_id, '') as bank_record_id, duplicate
from t_marked where duplicate is not null""", FEED_SQL)
def feed_duplicates(fx):
    rows = _batch(fx).rows.filter(F.col("_duplicate").isNotNull())
    return rows.select("file", "row_number", F.coalesce("bank_record_id", F.lit("")).alias(
        "bank_record_id"), F.col("_duplicate").alias("duplicate"))


@query("feed_normalized", """
select row_number, bank_record_id, merchant_id, money as amount,
       strftime(day, '%Y-%m-%d') as transaction_date, code as currency,
       direction as transaction_type,
       case when reference is null then null else ref_key end as canonical_reference,
       narration as description_normalized, array_to_string(errors, '; ') as errors,
       'SYNTHETIC_BANK' as lineage_source, bank_record_id as lineage_source_record_id,
       file as lineage_source_file_id, row_number as lineage_source_row,
       'v1.0.0' as lineage_normalizer_ver
from t_outcome where outcome = 'normalized'""", FEED_SQL)
def feed_normalized(fx):
    clean = normalize.flatten_lineage(_batch(fx).clean)
    return clean.select(
        "row_number", "bank_record_id", "merchant_id", "amount", "transaction_date", "currency",
        "transaction_type", "canonical_reference", "description_normalized",
        F.array_join("_errors", "; ").alias("errors"), "lineage_source",
        "lineage_source_record_id", "lineage_source_file_id", "lineage_source_row",
        "lineage_normalizer_ver")


@query("feed_quarantine", """
select 'SYNTHETIC_BANK' as source, case when torn then 'ROW_' || row_number else
         coalesce(bank_record_id, 'ROW_' || row_number) end as source_record_id,
       file as source_file_id, row_number as source_row_number, 'bank' as entity_type,
       case when torn then 'PARSE_ERROR' else 'VALIDATION_ERROR' end as error_type,
       case when torn then 'line is not a valid record' else array_to_string([x for x in errors if regexp_matches(x, 'MISSING_REQUIRED|ARITHMETIC_FAIL|AMOUNT_PARSE_ERROR')], '; ') end
         as error_message,
       case when torn then null else trim(split_part([x for x in errors if regexp_matches(x,
         'MISSING_REQUIRED|ARITHMETIC_FAIL|AMOUNT_PARSE_ERROR')][1], ':', 2)) end as failed_field
from t_outcome where outcome in ('invalid', 'parse_error')""", FEED_SQL)
def feed_quarantine(fx):
    return _batch(fx).quarantine.drop("raw_record")


@query("feed_counters", """
select count(*) as total, count(*) filter (outcome = 'normalized') as normalized,
       count(*) filter (outcome in ('invalid', 'parse_error')) as quarantined,
       count(*) filter (outcome = 'duplicate') as duplicates,
       count(*) filter (outcome = 'invalid') as validation_errors
from t_outcome""", FEED_SQL)
def feed_counters(fx):
    return _batch(fx).counters


# --- validation -----------------------------------------------------------------------


def _listed(df: DataFrame, entity: str, key: str, rule=validate.validation_errors) -> DataFrame:
    found = df.select(F.col(key).alias("record_id"),
                      F.array_join(rule(df, entity), "; ").alias("errors"))
    return found.filter(F.col("errors") != "")


@query("order_validation", """
select * from (
select order_id as record_id, array_to_string([x for x in [
   case when customer_id is null then 'MISSING_REQUIRED: customer_id' end,
   case when total < 0 then 'NEGATIVE_AMOUNT: total_amount=' || cast(total as varchar) end,
   case when total <> 0 and taxable_amount <> 0 and tax <> 0
         and abs(total - taxable_amount - tax) > 0.02 then 'ARITHMETIC_FAIL: total_amount' end,
   case when tax <> 0 and abs(tax - cgst - sgst - igst) > 0.02
        then 'ARITHMETIC_FAIL: total_tax' end] if x is not null], '; ') as errors
from (select order_id, case when n % 29 <> 0 then customer_id end as customer_id, taxable_amount,
        cgst, sgst, igst, cast(case when n % 19 = 0 then total_tax + 0.50 else total_tax end
          as decimal(15,2)) as tax,
        cast(case when n % 23 = 0 then -1 else total_amount end as decimal(15,2)) as total
      from (select *, cast(regexp_extract(order_id, '([0-9]+)$', 1) as bigint) as n
            from t_orders))) where errors <> ''""")
def order_validation(fx):
    n = id_number("order_id")
    faulty = fx.orders.withColumns({
        "customer_id": F.when(~every(n, 29), F.col("customer_id")),
        "total_tax": F.when(every(n, 19), money(F.col("total_tax") + money("0.50")))
        .otherwise(F.col("total_tax")),
        "total_amount": F.when(every(n, 23), money("-1")).otherwise(F.col("total_amount")),
    })
    return _listed(faulty, "order", "order_id")


@query("record_validation", """
select entity, record_id, errors from (
select 'invoice' as entity, invoice_id as record_id,
       case when total_amount <> 0 and taxable_amount <> 0 and total_tax <> 0
            and abs(total_amount - taxable_amount - total_tax) > 0.02
            then 'ARITHMETIC_FAIL: total_amount' else '' end as errors from t_invoices
union all
select 'settlement', settlement_id, case when abs(net_amount - (gross_amount - total_fees
       - total_fee_tax - total_refunds + total_adjustments)) > 0.02
       then 'ARITHMETIC_FAIL: net_amount' else '' end from t_settlements
union all
select 'fee', fee_id, case when abs(tax_amount + case when n % 25 = 0 then 1 else 0 end
       - round(fee_amount * 0.18, 2)) > 0.02 then 'ARITHMETIC_FAIL: tax_amount' else '' end
from (select *, cast(regexp_extract(fee_id, '([0-9]+)$', 1) as bigint) as n from t_fees)
union all
select 'payment', payment_id, case when n % 37 = 0 then 'INVALID_STATUS: LOST' else '' end
from (select *, cast(regexp_extract(payment_id, '([0-9]+)$', 1) as bigint) as n from t_payments)
union all
select 'book', entry_id, case when n % 50 = 11 and debit > 0
     then 'INVALID_ENTRY: both sides are positive' else '' end
from (select *, cast(regexp_extract(entry_id, '([0-9]+)$', 1) as bigint) as n from t_books)
union all
select 'bank', bank_record_id, case when transaction_date is null
     then 'MISSING_REQUIRED: transaction_date' else '' end from t_bank_records
) where errors <> ''""")
def record_validation(fx):
    def tagged(entity, df, key):
        return _listed(df, entity, key).withColumn("entity", F.lit(entity))

    fee_n, pay_n, led_n = (id_number(c) for c in ("fee_id", "payment_id", "entry_id"))
    parts = [
        tagged("invoice", fx.invoices, "invoice_id"),
        tagged("settlement", fx.settlements, "settlement_id"),
        tagged("fee", fx.fees.withColumn("tax_amount", F.when(
            every(fee_n, 25), money(F.col("tax_amount") + money("1")))
            .otherwise(F.col("tax_amount"))), "fee_id"),
        tagged("payment", fx.payments.withColumn("status", F.when(
            every(pay_n, 37), "LOST").otherwise(F.col("status"))), "payment_id"),
        tagged("book", fx.books.withColumn("credit", F.when(
            every(led_n, 50, 11), F.col("debit")).otherwise(F.col("credit"))), "entry_id"),
        tagged("bank", fx.bank_records, "bank_record_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("entity", "record_id", "errors")


@query("table_constraints", """
select entity, record_id, errors from (
select 'order' as entity, order_id as record_id,
       case when n % 19 = 0 then 'CHECK_FAIL: total=taxable+tax; CHECK_FAIL: tax=cgst+sgst+igst'
            else '' end as errors
from (select *, cast(regexp_extract(order_id, '([0-9]+)$', 1) as bigint) as n from t_orders)
union all
select 'adjustment', adjustment_id, case when n % 36 = 0 then 'CHECK_FAIL: direction' else '' end
from (select *, cast(regexp_extract(adjustment_id, '([0-9]+)$', 1) as bigint) as n
      from t_adjustments)
union all
select 'refund', refund_id, case when n % 5 = 0 then 'CHECK_FAIL: refund_amount>=0' else '' end
from (select *, cast(regexp_extract(refund_id, '([0-9]+)$', 1) as bigint) as n from t_refunds)
) where errors <> ''""")
def table_constraints(fx):
    n = id_number("order_id")
    orders = fx.orders.withColumn("total_tax", F.when(
        every(n, 19), money(F.col("total_tax") + money("0.01"))).otherwise(F.col("total_tax")))
    a, r = id_number("adjustment_id"), id_number("refund_id")
    adjustments = fx.adjustments.withColumn("direction", F.when(every(a, 36), "UP").otherwise(
        F.col("direction")))
    refunds = fx.refunds.withColumn("refund_amount", F.when(
        every(r, 5), money("-1")).otherwise(F.col("refund_amount")))
    parts = [(orders, "order", "order_id"), (adjustments, "adjustment", "adjustment_id"),
             (refunds, "refund", "refund_id")]
    out = None
    for df, entity, key in parts:
        one = _listed(df, entity, key, validate.strict_errors).withColumn(
            "entity", F.lit(entity))
        out = one if out is None else out.unionByName(one)
    return out.select("entity", "record_id", "errors")


# --- canonicalisation with parents ------------------------------------------------------


def _order_sources(fx) -> canon.Split:
    """Clean and noisy order feeds with overlapping keys."""
    n = id_number("order_id")
    fields = ["order_id", "merchant_id", "customer_id", "row", "note"]
    clean = fx.orders.filter(~every(n, 6)).select(
        "order_id", "merchant_id", "customer_id", n.alias("row"), F.lit("a").alias("note"))
    clean = clean.unionByName(clean.filter(every(n, 10)).withColumn("row", n + 50000000)
                              .withColumn("note", F.lit("b")))
    noisy_id = (F.when(every(n, 4), F.regexp_replace("order_id", "_", "-"))
                .when(every(n, 4, 1), F.lower("order_id"))
                .when(every(n, 4, 2), F.concat(F.col("order_id"), F.lit("_DUP")))
                .otherwise(F.col("order_id")))
    noisy = fx.orders.filter(every(n, 3)).select(
        F.when(~every(n, 33), noisy_id).alias("order_id"),
        F.when(every(n, 21), "???").otherwise(F.regexp_replace("merchant_id", "_", "/"))
        .alias("merchant_id"), "customer_id", n.alias("row"), F.lit("n").alias("note"))
    made = [canon.canonicalize(df.select(*fields), "order", "order_id",
                               ["merchant_id", "customer_id"], source, "row", "orders.jsonl")
            for df, source in ((clean, "SYNTHETIC"), (noisy, "NOISY"))]
    return canon.merge_sources(made[0], made[1], "order_id")


_NOISY = f"""
select n as row, 'n' as note, customer_id,
       case when n % 33 = 0 then null when n % 4 = 0 then replace(order_id, '_', '-')
            when n % 4 = 1 then lower(order_id) when n % 4 = 2 then order_id || '_DUP'
            else order_id end as order_id,
       case when n % 21 = 0 then '???' else replace(merchant_id, '_', '/') end as merchant_id,
       order_id as true_id, merchant_id as true_merchant
from (select *, {num('order_id')} as n from t_orders) where n % 3 = 0"""


@query("canonical_orders", f"""
select order_id, merchant_id, customer_id, row, note from (
  select *, row_number() over (partition by order_id order by rank, turn) as k from (
    select order_id, merchant_id, customer_id, n as row, 'a' as note, 0 as rank, -n as turn
    from (select *, {num('order_id')} as n from t_orders) where n % 6 <> 0
    union all
    select order_id, merchant_id, customer_id, n + 50000000, 'b', 0, -(n + 50000000)
    from (select *, {num('order_id')} as n from t_orders) where n % 6 <> 0 and n % 10 = 0
    union all
    select true_id, true_merchant, customer_id, row, note, 1, row from ({_NOISY})
    where order_id is not null and row % 4 <> 2 and row % 21 <> 0))
where k = 1""")
def canonical_orders(fx):
    return _order_sources(fx).good.select("order_id", "merchant_id", "customer_id", "row", "note")


@query("canonical_order_rejects", f"""
select 'order' as entity_type, 'NOISY' as source, row as source_row_number,
       case when order_id is null then 'Missing PK field ''order_id'''
            when row % 4 = 2 then 'Cannot canonicalize PK: ' || order_id
            else 'Cannot canonicalize FK ''merchant_id'': ???' end as error_message,
       case when order_id is null or row % 4 = 2 then 'order_id' else 'merchant_id' end
         as failed_field,
       'FK_ORPHAN_OR_UNRESOLVABLE_ID' as error_type
from ({_NOISY}) where order_id is null or row % 4 = 2 or row % 21 = 0""")
def canonical_order_rejects(fx):
    stored = tables.quarantine_load(_order_sources(fx).quarantine)
    return stored.select("entity_type", "source", "source_row_number", "error_message",
                         "failed_field", "error_type")


@query("hard_parent_checks", """
select 'payment' as entity, payment_id as record_id, case when o.order_id is null
     then 'Orphan order_id: ' || p.order_id end as problem
from t_payments p left join t_orders o on o.order_id = p.order_id
union all
select 'refund', refund_id, case when o.order_id is null then 'Orphan order_id: ' || r.order_id
     end
from t_refunds r left join t_orders o on o.order_id = r.order_id
union all
select 'adjustment', adjustment_id, case when s.settlement_id is null
     then 'Orphan settlement_id: ' || a.settlement_id end
from t_adjustments a left join t_settlements s on s.settlement_id = a.settlement_id""")
def hard_parent_checks(fx):
    def check(df, entity, key, parents):
        staged = df.withColumns({"_raw": F.col(key), "_source": F.lit("S"),
                                 "_row": id_number(key)})
        none = staged.limit(0).select(
            F.lit("").alias("entity_type"), F.col("_source").alias("source"),
            F.col("_row").alias("source_row_number"), F.lit("").alias("error_message"),
            F.lit("").alias("failed_field"), F.lit("").alias("error_type"),
            F.col("_raw").alias("raw_record"))
        split = canon.require_parents(canon.Split(staged, none), entity, parents)
        good = split.good.select(F.lit(entity).alias("entity"), F.col(key).alias("record_id"),
                                 F.lit(None).cast("string").alias("problem"))
        bad = split.quarantine.select(F.lit(entity).alias("entity"),
                                      F.col("raw_record").alias("record_id"),
                                      F.col("error_message").alias("problem"))
        return good.unionByName(bad)

    return (
        check(fx.payments, "payment", "payment_id",
              [("order_id", fx.orders, "order_id", False)])
        .unionByName(check(fx.refunds, "refund", "refund_id", [
            ("payment_id", fx.payments, "payment_id", False),
            ("order_id", fx.orders, "order_id", False)]))
        .unionByName(check(fx.adjustments, "adjustment", "adjustment_id", [
            ("settlement_id", fx.settlements, "settlement_id", True)]))
    )


@query("soft_parent_notes", f"""
select bank_record_id, case when n % 10 = 3 and settlement_id is not null
     then 'Unresolved settlement_id: X_' || settlement_id end as note
from (select *, {num('bank_record_id')} as n from t_bank_records)""")
def soft_parent_notes(fx):
    n = id_number("bank_record_id")
    loose = fx.bank_records.withColumn("settlement_id", F.when(
        every(n, 10, 3), F.concat(F.lit("X_"), "settlement_id")).otherwise(
        F.col("settlement_id")))
    noted = canon.note_soft_parent(loose, "settlement_id",
                                   fx.settlements.select("settlement_id"), "settlement_id")
    return noted.select("bank_record_id", F.col("_note").alias("note"))


def _links(fx) -> canon.Split:
    n = id_number("payment_id")
    base = fx.settlement_payments.withColumn("row", n)
    again = base.filter(every(n, 7)).withColumn("row", n + 10000000)
    holes = base.filter(every(n, 9)).withColumns(
        {"row": n + 20000000, "settlement_id": F.lit(None).cast("string")})
    wrong = base.filter(every(n, 14)).withColumns(
        {"row": n + 30000000, "payment_id": F.lit("nonsense")})
    lost = base.filter(every(n, 15)).withColumns(
        {"row": n + 40000000, "payment_id": padded("PAY", n + 700000000)})
    every_row = base
    for part in (again, holes, wrong, lost):
        every_row = every_row.unionByName(part)
    return canon.check_links(every_row, fx.settlements, fx.payments, "SYNTHETIC", "row")


@query("link_checks", f"""
select 'kept' as outcome, {num('payment_id')} as row, payment_id as detail
from t_settlement_payments
union all select 'settlement_id', n + 20000000, 'Missing settlement_id or payment_id'
from (select {num('payment_id')} as n from t_settlement_payments) where n % 9 = 0
union all select 'payment_id', n + 30000000, 'Cannot canonicalize FK ''payment_id'': nonsense'
from (select {num('payment_id')} as n from t_settlement_payments) where n % 14 = 0
union all select 'payment_id', n + 40000000, 'Orphan payment_id: ' || {pid('PAY', '(n + 700000000)')}
from (select {num('payment_id')} as n from t_settlement_payments) where n % 15 = 0""")
def link_checks(fx):
    split = _links(fx)
    return split.good.select(F.lit("kept").alias("outcome"), "row",
                             F.col("payment_id").alias("detail")).unionByName(
        split.quarantine.select(F.col("failed_field").alias("outcome"),
                                F.col("source_row_number").alias("row"),
                                F.col("error_message").alias("detail")))


@query("folded_quarantine", f"""
select entity_type, count(*) as row_count, count(reviewer) as reviewed from (
  select 'order' as entity_type, cast(null as varchar) as reviewer from ({_NOISY})
  where order_id is null or row % 4 = 2 or row % 21 = 0
  union all select 'event', event_type from events where event_id % 100 = 0)
group by 1""")
def folded_quarantine(fx):
    earlier = fx.raw("events").filter(every("event_id", 100)).select(
        F.lit("event").alias("entity_type"), F.col("event_type").alias("reviewer"))
    both = canon.fold_quarantine(_order_sources(fx).quarantine, earlier)
    return both.groupBy("entity_type").agg(F.count(F.lit(1)).alias("row_count"),
                                           F.count("reviewer").alias("reviewed"))


@query("record_canonical_form", f"""
select row_number, coalesce({sql_canonical('bank_record_id')}, bank_record_id) as bank_record_id,
       coalesce({sql_canonical('merchant_id')}, merchant_id) as merchant_id,
       bank_record_id as source_record_id,
       case when merchant_id is not null and ({sql_canonical('merchant_id')}) is null
            then 'merchant_id: Cannot canonicalize ID ''' || merchant_id || '''' else '' end
         as errors
from t_raw_bank""")
def record_canonical_form(fx):
    out = canon.canonicalize_record(fx.raw_bank, "bank_record_id", ["merchant_id"])
    return out.select("row_number", "bank_record_id", "merchant_id",
                      F.col("_source_record_id").alias("source_record_id"),
                      F.array_join("_errors", "; ").alias("errors"))


@query("near_duplicate_payments", f"""
select payment_id || '_DUP' as payment_id, payment_id as duplicate_of
from t_payments where {num('payment_id')} % 30 = 0""")
def near_duplicate_payments(fx):
    n = id_number("payment_id")
    base = fx.payments.select(
        "payment_id", "merchant_id", "amount", F.to_date("payment_date").alias("day"),
        F.col("gateway_reference").alias("text"))
    extra = base.filter(every(n, 30)).withColumns({
        "payment_id": F.concat("payment_id", F.lit("_DUP")), "day": F.date_add("day", 1)})
    flagged = dedup.flag_near_duplicates(base.unionByName(extra), "payment_id", "amount", "day",
                                         "text")
    return flagged.select("payment_id", "duplicate_of")


# --- loads ------------------------------------------------------------------------------


def _stored_and_incoming(fx):
    n = id_number("payment_id")
    cols = ["payment_id", "merchant_id", "amount", "status"]
    stored = fx.payments.filter(~every(n, 5)).select(*cols)
    first = fx.payments.filter(every(n, 3)).select(
        "payment_id", F.lit("MER_NEW").alias("merchant_id"),
        money(F.col("amount") + money("1")).alias("amount"), F.lit("FIRST").alias("status"),
        n.alias("row"))
    second = first.filter(every(n, 2)).withColumns({
        "merchant_id": F.lit("MER_LATE"), "status": F.lit("SECOND"), "row": n + 90000000})
    return stored, first.unionByName(second)


@query("insert_ignore_rows", f"""
select payment_id, 'MER_NEW' as merchant_id, cast(amount + 1 as double) as amount,
       'FIRST' as status
from (select *, {num('payment_id')} as n from t_payments) where n % 3 = 0 and n % 5 = 0""")
def insert_ignore_rows(fx):
    stored, incoming = _stored_and_incoming(fx)
    return tables.insert_ignore(incoming, stored, ["payment_id"], F.col("row")).drop("row")


@query("upserted_payments", f"""
select payment_id, case when n % 5 = 0 then 'MER_NEW' else merchant_id end as merchant_id,
       cast(case when n % 3 = 0 then amount + 1 else amount end as double) as amount,
       case when n % 6 = 0 then 'SECOND' when n % 3 = 0 then 'FIRST' else status end as status
from (select *, {num('payment_id')} as n from t_payments) where n % 5 <> 0 or n % 3 = 0""")
def upserted_payments(fx):
    stored, incoming = _stored_and_incoming(fx)
    return tables.upsert(incoming, stored, "payment_id", tables.UPSERT_COLUMNS["payments"], "row")


@query("loaded_row_counts", "\nunion all\n".join(
    f"select '{t}' as table_name, count(*) as row_count from t_{t}" for t in tables.LOAD_ORDER))
def loaded_row_counts(fx):
    return tables.row_counts(fx.all())


@query("unseen_records", """
select 'FEED' as source, cast(event_id as varchar) as source_record_id, event_type as entity_type
from events where event_id % 4 <> 0""")
def unseen_records(fx):
    batch = fx.raw("events").select(
        F.lit("FEED").alias("source"), F.col("event_id").cast("string").alias("source_record_id"),
        F.col("event_type").alias("entity_type"))
    seen = tables.seen_map(batch.filter(F.col("source_record_id").cast("bigint") % 4 == 0))
    return tables.unseen(batch, seen)


@query("customer_lookup", """
select c.customer_id, o.order_id, cast(o.total_amount as double) as total_amount
from t_customers c join t_orders o on o.customer_id = c.customer_id
where c.customer_id = 'CUS_000007'""")
def customer_lookup(fx):
    one = tables.by_key(fx.customers, "customer_id", "CUS_000007")
    return tables.children(one, fx.orders, "customer_id").select(
        "customer_id", "order_id", "total_amount")


@query("merchant_bank_page", """
select merchant_id, bank_record_id, strftime(transaction_date, '%Y-%m-%d') as transaction_date
from (select *, row_number() over (partition by merchant_id
        order by transaction_date desc nulls last, bank_record_id) as k from t_bank_records)
where k <= 3""")
def merchant_bank_page(fx):
    page = tables.children(fx.merchants, fx.bank_records, "merchant_id", [
        F.col("transaction_date").desc_nulls_last(), F.col("bank_record_id")], limit=3)
    return page.select("merchant_id", "bank_record_id", "transaction_date")
