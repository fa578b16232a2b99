"""Column functions over the raw bank feed and the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import vocab
from ledgerloom.functions import amounts, dates, enums, identifiers, similarity, text
from ledgerloom.functions.amounts import MONEY
from ledgerloom.plans.catalog import query


def _case(table: dict, key: str) -> str:
    arms = " ".join("when '{}' then '{}'".format(str(k).replace("'", "''"), v)
                    for k, v in table.items())
    return f"case {key} {arms} end"


FAMILY = {n: p for p, names in vocab.ID_FAMILIES.items() for n in names}
ALIAS = {n: p for p, names in vocab.LOOKUP_ALIASES.items() for n in names}
_NAMES = "|".join(sorted(FAMILY, key=len, reverse=True))
ID_RULE = f"^({_NAMES})[-_/]?([0-9]+)$"


def sql_canonical(column: str) -> str:
    t = f"upper(trim({column}))"
    family = _case(FAMILY, f"regexp_extract({t}, '{ID_RULE}', 1)")
    digits = f"regexp_replace(regexp_extract({t}, '{ID_RULE}', 2), '^0+([0-9])', '\\1')"
    width = f"cast(greatest(6, length({digits})) as integer)"
    return f"(({family}) || '_' || lpad({digits}, {width}, '0'))"


def sql_lookup_key(column: str) -> str:
    t = f"regexp_replace(upper(trim({column})), '[-/_\\s]', '', 'g')"
    shape = "^([A-Z]+)([0-9]+)(.*)$"
    head = f"regexp_extract({t}, '{shape}', 1)"
    return (f"coalesce(case when regexp_matches({t}, '{shape}') then coalesce({_case(ALIAS, head)},"
            f" {head}) || regexp_extract({t}, '{shape}', 2) || regexp_extract({t}, '{shape}', 3)"
            f" else {t} end, '')")


def sql_amount_bare(column: str) -> str:
    t = f"trim({column})"
    for mark in ["₹", "(?i)Rs\\.?\\s*", "(?i)INR\\s*", "[$€£¥]", "(?i)USD\\s*", "(?i)EUR\\s*",
                 ","]:
        t = f"regexp_replace({t}, '{mark}', '', 'g')"
    return f"trim({t})"


def sql_amount(column: str) -> str:
    bare = sql_amount_bare(column)
    return (f"case when {column} is not null and lower(trim({column})) not in "
            f"('', 'null', 'none', 'n/a', '-') and regexp_matches({bare}, "
            f"'^-?[0-9]+(\\.[0-9]+)?$') then try_cast({bare} as decimal(15,2)) end")


def sql_instant(column: str) -> str:
    """Timestamp in UTC of a written value; unzoned text is five and a half hours ahead."""
    formats = ("['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d', '%d/%m/%Y %H:%M:%S', "
               "'%d/%m/%Y', '%d-%m-%Y', '%m/%d/%Y', '%d %b %Y', '%b %d %Y', '%d %B %Y', "
               "'%B %d %Y', '%d %b %Y %H:%M:%S']")
    zone = f"regexp_extract({column}, '([+-][0-9]{{2}}:?[0-9]{{2}})$', 1)"
    zoned = f"regexp_matches({column}, 'T.*[+-][0-9]{{2}}:?[0-9]{{2}}$')"
    body = f"regexp_replace({column}, '[+-][0-9]{{2}}:?[0-9]{{2}}$', '')"
    minutes = (f"(case when {zone}[1] = '-' then -1 else 1 end * (cast({zone}[2:3] as integer) * 60"
               f" + cast(right({zone}, 2) as integer)))")
    return (f"case when {zoned} then try_strptime({body}, '%Y-%m-%dT%H:%M:%S') "
            f"- to_minutes({minutes}) else try_strptime({column}, {formats}) "
            f"- to_minutes(330) end")


def sql_clean(column: str) -> str:
    t = f"lower(nfc_normalize({column}))"
    t = f"regexp_replace({t}, '[-/\\\\|_]', ' ', 'g')"
    t = f"regexp_replace({t}, '[₹$€£¥,;:\"''`]', '', 'g')"
    return f"coalesce(trim(regexp_replace({t}, '\\s+', ' ', 'g')), '')"


def sql_narration(column: str) -> str:
    t = sql_clean(column)
    for word in ("neft", "rtgs", "imps", "upi", "cr", "dr", "trf"):
        t = f"regexp_replace({t}, '^{word}\\s+', '')"
    return f"trim({t})"


def sql_currency(column: str) -> str:
    key = f"lower(trim({column}))"
    codes = ", ".join(f"'{c}'" for c in vocab.CURRENCY_CODES)
    return (f"coalesce({_case(vocab.CURRENCY_ALIASES, key)}, "
            f"case when upper({key}) in ({codes}) then upper({key}) end, 'INR')")


def sql_words(column: str) -> str:
    return f"regexp_replace(lower(trim({column})), '[- ]', '_', 'g')"


def sql_status(column: str, entity: str) -> str:
    return (f"case when {column} <> '' then coalesce("
            f"{_case(vocab.STATUS_WORDS[entity], sql_words(column))}, upper({column})) end")


def sql_enum(column: str, kind: str) -> str:
    key = sql_words(column)
    table = vocab.ENUM_WORDS[kind]
    return (f"case when {column} <> '' then coalesce({_case(table, key)}, "
            f"{_case(table, f'replace({key}, chr(95), chr(32))')}, upper({column})) end").replace(
        "chr(32)", "''").replace("chr(95)", "'_'")


@query("identifier_forms", f"""
select row_number, {sql_canonical('bank_record_id')} as canonical,
       {sql_canonical('merchant_id')} as merchant,
       {sql_lookup_key('bank_record_id')} as lookup_key,
       coalesce(upper(regexp_replace(reference, '\\s+', '', 'g')), '') as utr,
       coalesce(trim(reference), '') as gateway_reference,
       coalesce(upper(regexp_replace(reference, '\\s+', '', 'g')), '') as bank_reference,
       'FEED::' || {sql_lookup_key('bank_record_id')} as dedup_key,
       coalesce(upper(regexp_replace(bank_record_id, '[^A-Za-z0-9]', '', 'g')), '') as match_key,
       upper(regexp_replace(trim('inv / ' || description), '\\s*/\\s*', '/', 'g'))
         as invoice_number
from t_raw_bank""")
def identifier_forms(fx):
    return fx.raw_bank.select(
        "row_number", identifiers.canonical_id("bank_record_id").alias("canonical"),
        identifiers.canonical_id("merchant_id").alias("merchant"),
        identifiers.lookup_key("bank_record_id").alias("lookup_key"),
        identifiers.utr("reference").alias("utr"),
        identifiers.gateway_reference("reference").alias("gateway_reference"),
        identifiers.bank_reference("reference").alias("bank_reference"),
        identifiers.dedup_key(F.lit("feed"), "bank_record_id").alias("dedup_key"),
        identifiers.match_key("bank_record_id").alias("match_key"),
        identifiers.invoice_number(F.concat(F.lit("inv / "), "description"))
        .alias("invoice_number"),
    )


@query("entity_codes", """
select event_id, case event_type when 'purchase' then 'PUR' else upper(event_type[1:3]) end
         as event_code,
       case event_id % 8 when 0 then 'ORD' when 1 then 'INV' when 2 then 'BNK' when 3 then 'LED'
            when 4 then 'GST' when 5 then 'ADJ' when 6 then 'UNK' else 'LOA' end as entity_code
from events""")
def entity_codes(fx):
    n = F.col("event_id")
    names = ["order", " Invoices ", "BANK", "books", "gst", "adjustments", "", "loan"]
    name = F.element_at(F.array(*[F.lit(x) for x in names]), (n % 8 + 1).cast("int"))
    return fx.raw("events").select(
        "event_id", identifiers.entity_code("event_type").alias("event_code"),
        identifiers.entity_code(name).alias("entity_code"))


@query("amount_parsing", f"""
select row_number, cast({sql_amount('amount')} as double) as amount,
       case when amount is not null and lower(trim(amount)) not in ('', 'null', 'none', 'n/a', '-')
                 and ({sql_amount('amount')}) is null
            then 'AMOUNT_PARSE_ERROR: amount: ' || trim(amount) end as error,
       cast({sql_amount('amount')} as varchar) as amount_text
from t_raw_bank""")
def amount_parsing(fx):
    return fx.raw_bank.select(
        "row_number", amounts.parse_amount("amount").alias("amount"),
        amounts.amount_error("amount", "amount").alias("error"),
        amounts.amount_text(amounts.parse_amount("amount")).alias("amount_text"))


@query("amount_comparison", """
select l_orderkey, l_linenumber, count(*) as lines,
       sum(cast(abs(cast(l_extendedprice as decimal(15,2)) - cast(l_quantity * 1000 as decimal(15,2)))
           < 0.01 as bigint)) as exact,
       sum(cast(abs(cast(l_discount as decimal(15,2)) - cast(l_tax as decimal(15,2))) < 0.01
           as bigint)) as same_rate,
       sum(cast(case when greatest(abs(l_extendedprice), abs(l_quantity * 1500)) = 0 then true else
           round(abs(l_extendedprice - l_quantity * 1500)
                 / greatest(abs(l_extendedprice), abs(l_quantity * 1500)), 12) <= 0.02
           or round(abs(l_extendedprice - l_quantity * 1500), 6) <= 1 end as bigint)) as close
from lineitem group by 1, 2""")
def amount_comparison(fx):
    price = F.col("l_extendedprice").cast(MONEY)
    exact = amounts.amounts_equal(price, (F.col("l_quantity") * 1000).cast(MONEY))
    same = amounts.amounts_equal(F.col("l_discount").cast(MONEY), F.col("l_tax").cast(MONEY))
    close = amounts.amounts_close("l_extendedprice", F.col("l_quantity") * 1500)
    return fx.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(exact).alias("exact"),
        F.count_if(same).alias("same_rate"), F.count_if(close).alias("close"))


@query("number_parsing", """
select event_id, k, case when k % 5 = 0 then null when k % 5 = 4 then k / 1000.0::double
       else cast(k as double) end as parsed
from (select event_id, cast(json_extract(props, '$.k') as bigint) as k from events)""")
def number_parsing(fx):
    k = F.get_json_object("props", "$.k")
    n = k.cast("bigint")
    spelled = (F.when(n % 5 == 0, F.concat(k, F.lit("d"))).when(n % 5 == 1, F.concat(k, F.lit("_0"))
               ).when(n % 5 == 2, F.concat(F.lit(" +"), k)).when(n % 5 == 3, F.concat(k, F.lit(".")))
               .otherwise(F.concat(k, F.lit("e-3"))))
    # k_0 reads as ten times k, so scale it back for a plain comparison
    value = amounts.to_number(spelled)
    return fx.raw("events").select(
        "event_id", n.alias("k"), F.when(n % 5 == 1, value / 10).otherwise(value).alias("parsed"))


@query("date_parsing", f"""
select row_number, strftime({sql_instant('transaction_date')}, '%Y-%m-%dT%H:%M:%S+00:00')
         as instant,
       case when ({sql_instant('transaction_date')}) is null
            then 'DATE_PARSE_ERROR: transaction_date: ' || transaction_date end as error,
       strftime({sql_instant('transaction_date')}, '%Y-%m-%d') as utc_day,
       strftime(try_strptime(regexp_extract(transaction_date, '^(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1),
                '%Y-%m-%d'), '%Y-%m-%d') as written_day,
       case when regexp_matches(transaction_date, '\\d{{4}}-\\d{{2}}-\\d{{2}}')
              then regexp_extract(transaction_date, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1)
            when regexp_matches(transaction_date, '^\\d{{2}}[-/]\\d{{2}}[-/]\\d{{4}}$')
              then transaction_date[7:10] || '-' || transaction_date[4:5] || '-'
                   || transaction_date[1:2]
            else transaction_date[1:10] end as upload_day
from t_raw_bank""")
def date_parsing(fx):
    instant = dates.parse_instant("transaction_date")
    return fx.raw_bank.select(
        "row_number", dates.iso_text(instant).alias("instant"),
        dates.instant_error("transaction_date", "transaction_date").alias("error"),
        dates.date_text(instant).alias("utc_day"),
        dates.date_text(dates.written_date("transaction_date")).alias("written_day"),
        dates.upload_date("transaction_date").alias("upload_day"))


@query("day_gaps", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(datediff('day', o_orderdate, l_shipdate)) as days,
       cast(abs(floor((epoch(l_shipdate) - epoch(o_orderdate) - 43200) / 86400)) as bigint)
         as floored
from lineitem join orders on o_orderkey = l_orderkey""")
def day_gaps(fx):
    joined = fx.raw("lineitem").join(fx.raw("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    noon = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(12))
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        dates.day_gap(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("days"),
        dates.floor_day_gap(F.col("l_shipdate").cast("timestamp"), noon).alias("floored"))


_STATUS_PICK = "case event_id % 6 when 0 then 'Paid' when 1 then 'in-progress' when 2 then " \
               "'On Hold' when 3 then 'processing' when 4 then '' else event_type end"


@query("status_words", f"""
select event_id, {', '.join(f"{sql_status('word', e)} as {e}" for e in vocab.STATUS_WORDS)}
from (select event_id, {_STATUS_PICK} as word from events)""")
def status_words(fx):
    n = F.col("event_id")
    word = (F.when(n % 6 == 0, "Paid").when(n % 6 == 1, "in-progress").when(n % 6 == 2, "On Hold")
            .when(n % 6 == 3, "processing").when(n % 6 == 4, "").otherwise(F.col("event_type")))
    return fx.raw("events").select(
        "event_id", *[enums.status(word, e).alias(e) for e in vocab.STATUS_WORDS])


_ENUM_PICK = "case event_id % 7 when 0 then 'credit card' when 1 then 'E-Wallet' when 2 then " \
             "'Net Banking' when 3 then 'write_off' when 4 then 'Intra State' when 5 then " \
             "'charge-back' else event_type end"


@query("enum_words", f"""
select event_id, {', '.join(f"{sql_enum('word', k)} as {k}" for k in vocab.ENUM_WORDS)},
       upper(trim(word)) as account_code,
       upper(regexp_replace(word, '\\s+', '', 'g')) as return_type
from (select event_id, {_ENUM_PICK} as word from events)""")
def enum_words(fx):
    n = F.col("event_id")
    word = (F.when(n % 7 == 0, "credit card").when(n % 7 == 1, "E-Wallet")
            .when(n % 7 == 2, "Net Banking").when(n % 7 == 3, "write_off")
            .when(n % 7 == 4, "Intra State").when(n % 7 == 5, "charge-back")
            .otherwise(F.col("event_type")))
    return fx.raw("events").select(
        "event_id", *[enums.enum(word, k).alias(k) for k in vocab.ENUM_WORDS],
        enums.account_code(word).alias("account_code"),
        enums.return_type(word).alias("return_type"))


@query("currency_codes", f"""
select row_number, {sql_currency('currency')} as currency,
       case when currency = 'doge' then 'CURRENCY_ERROR: Unrecognized currency ''doge''' end
         as error
from t_raw_bank""")
def currency_codes(fx):
    return fx.raw_bank.select(
        "row_number", enums.currency("currency").alias("currency"),
        enums.currency_error("currency").alias("error"))


@query("narration_cleaning", f"""
select row_number, {sql_clean('description')} as cleaned,
       {sql_narration('description')} as narration,
       upper(regexp_replace('27-aabc ' || description, '[\\s\\-]', '', 'g')) as gstin
from t_raw_bank""")
def narration_cleaning(fx):
    return fx.raw_bank.select(
        "row_number", text.clean_text("description").alias("cleaned"),
        text.clean_narration("description").alias("narration"),
        text.clean_gstin(F.concat(F.lit("27-aabc "), "description")).alias("gstin"))


@query("document_text_cleaning", f"""
select doc_id, length(clean) as clean_length, md5(clean) as fingerprint,
       cast(trim(text) = '' as bigint) as is_empty
from (select doc_id, text, {sql_clean('text')} as clean from documents)""")
def document_text_cleaning(fx):
    cleaned = fx.raw("documents").select("doc_id", "text", text.clean_text("text").alias("clean"))
    return cleaned.select(
        "doc_id", F.length("clean").cast("bigint").alias("clean_length"),
        F.md5("clean").alias("fingerprint"), text.is_empty("text").alias("is_empty"))


@query("name_cleaning", f"""
select c_custkey, replace({sql_clean('c_name')}, ' ', ' ') || ' pvt ltd' as name
from customer""")
def name_cleaning(fx):
    spelled = F.concat(F.lit("  "), "c_name", F.lit(" Pvt. Ltd. "))
    return fx.raw("customer").select("c_custkey", text.clean_name(spelled).alias("name"))


@query("token_overlap_scores", """
select item_id, doc_id, len(list_intersect(a, b)) / cast(len(list_distinct(a || b)) as double)
         as overlap
from (
  select item_id, doc_id,
         list_distinct(regexp_extract_all(upper(replace(b.text, 'ß', 'SS')), '[A-Za-z0-9]+')) as a,
         list_distinct(regexp_extract_all(upper(replace(d.text, 'ß', 'SS')), '[A-Za-z0-9]+')) as b
  from benchmark b join documents d on d.doc_id = b.item_id)
where len(a) > 0 and len(b) > 0""")
def token_overlap_scores(fx):
    pairs = fx.raw("benchmark").withColumnRenamed("text", "question").join(
        fx.raw("documents"), F.col("doc_id") == F.col("item_id"))
    left, right = F.col("question"), F.col("text")
    usable = (F.size(text.word_set(left)) > 0) & (F.size(text.word_set(right)) > 0)
    return pairs.filter(usable).select(
        "item_id", "doc_id", text.token_overlap(left, right).alias("overlap"))


@query("reference_similarity")
def reference_similarity(fx):
    pairs = fx.bank_records.filter(F.col("settlement_id").isNotNull()).join(
        fx.settlements.select("settlement_id", "utr"), "settlement_id")
    return pairs.select(
        "bank_record_id", "settlement_id",
        similarity.similarity(identifiers.match_key("reference"), identifiers.match_key("utr"))
        .alias("similarity"))


@query("content_hash_groups", """
select copies, count(*) as bodies from (
  select count(*) as copies from t_raw_bank
  group by coalesce(lower(trim(amount)), ''), coalesce(lower(trim(transaction_date)), ''),
           coalesce(lower(trim(reference)), ''), coalesce(lower(trim(description)), ''))
group by copies""")
def content_hash_groups(fx):
    body = identifiers.content_hash(
        [F.col(c) for c in ("amount", "transaction_date", "reference", "description")])
    return (fx.raw_bank.groupBy(body.alias("body")).agg(F.count(F.lit(1)).alias("copies"))
            .groupBy("copies").agg(F.count(F.lit(1)).alias("bodies")))


@query("order_tax_rule", """
select order_id, cast(discount as double) as discount, cast(taxable as double) as taxable_amount,
       cast(case when same then half else 0 end as double) as cgst,
       cast(case when same then half else 0 end as double) as sgst,
       cast(case when same then 0 else full_tax end as double) as igst,
       cast(case when same then half + half else full_tax end as double) as total_tax,
       cast(taxable + case when same then half + half else full_tax end as double) as total_amount
from (
  select *, cast(round(taxable * 0.09, 2) as decimal(15,2)) as half,
         cast(round(taxable * 0.18, 2) as decimal(15,2)) as full_tax
  from (
    select *, cast(taxable_amount - discount_part as decimal(15,2)) as taxable,
           discount_part as discount
    from (select order_id, taxable_amount, seller_state = buyer_state as same,
                 cast(round(taxable_amount * 0.05, 2) as decimal(15,2)) as discount_part
          from t_orders)))""")
def order_tax_rule(fx):
    parts = amounts.order_tax(F.col("taxable_amount"), F.lit("0.05").cast("decimal(5,4)"),
                              F.col("seller_state"), F.col("buyer_state"))
    return fx.orders.select("order_id", *[c.alias(name) for name, c in parts.items()])


@query("refund_rule", """
select payment_id, cast(case when n % 3 = 0 then round(amount * 0.25, 2) else amount end as double)
         as refund
from (select payment_id, amount, cast(regexp_extract(payment_id, '([0-9]+)$', 1) as bigint) as n
      from t_payments)""")
def refund_rule(fx):
    from ledgerloom.operators.derive import id_number

    n = id_number("payment_id")
    kind = F.when(n % 3 == 0, "PARTIAL").when(n % 3 == 1, "FULL").otherwise("REVERSAL")
    return fx.payments.select(
        "payment_id",
        amounts.refund_amount(F.col("amount"), kind, F.lit("0.25").cast("decimal(5,4)"))
        .alias("refund"))


@query("masked_narrations", """
select bank_record_id, regexp_replace(description, '(?i)STL_[0-9]+', 'SETTLEMENT', 'g')
         as description
from t_bank_records""")
def masked_narrations(fx):
    return fx.bank_records.select(
        "bank_record_id", text.mask_settlement_ids("description").alias("description"))


MENTIONS_SQL = """
select conv_id, turn, text, case conv_id % 6 when 0 then text || ' where is bnk_' || conv_id || '?'
    when 1 then text || ' refund PAY_' || conv_id || ' and BNK_7' when 2 then text || ' Stl_' ||
    conv_id when 3 then text || ' txn' || conv_id when 4 then 'ORD_' || conv_id || ' ' || text
    else text end as question
from conversations"""


def with_mentions(fx):
    n = F.col("conv_id")
    s = n.cast("string")
    question = (
        F.when(n % 6 == 0, F.concat("text", F.lit(" where is bnk_"), s, F.lit("?")))
        .when(n % 6 == 1, F.concat("text", F.lit(" refund PAY_"), s, F.lit(" and BNK_7")))
        .when(n % 6 == 2, F.concat("text", F.lit(" Stl_"), s))
        .when(n % 6 == 3, F.concat("text", F.lit(" txn"), s))
        .when(n % 6 == 4, F.concat(F.lit("ORD_"), s, F.lit(" "), "text"))
        .otherwise(F.col("text")))
    return fx.raw("conversations").select("conv_id", "turn", "text", question.alias("question"))


@query("record_mentions", f"""
select conv_id, turn,
       case when regexp_matches(question, '(?i)BNK_\\w+')
              then regexp_extract(question, '(?i)(BNK_\\w+)', 1)
            when regexp_matches(question, '(?i)PAY_\\w+')
              then regexp_extract(question, '(?i)(PAY_\\w+)', 1)
            when regexp_matches(question, '(?i)STL_\\w+')
              then regexp_extract(question, '(?i)(STL_\\w+)', 1)
            when regexp_matches(question, '(?i)ORD_\\w+')
              then regexp_extract(question, '(?i)(ORD_\\w+)', 1)
            when regexp_matches(question, '(?i)TXN\\w+')
              then regexp_extract(question, '(?i)(TXN\\w+)', 1) end as mentioned_id,
       case when regexp_matches(question, '(?i)BNK_\\w+') then 'bank_record'
            when regexp_matches(question, '(?i)PAY_\\w+') then 'payment'
            when regexp_matches(question, '(?i)STL_\\w+') then 'settlement'
            when regexp_matches(question, '(?i)ORD_\\w+') then 'order'
            when regexp_matches(question, '(?i)TXN\\w+') then 'transaction' end as kind
from ({MENTIONS_SQL})""")
def record_mentions(fx):
    found = with_mentions(fx).withColumn("m", identifiers.mention("question"))
    return found.select("conv_id", "turn", F.col("m.id").alias("mentioned_id"),
                        F.col("m.kind").alias("kind"))
