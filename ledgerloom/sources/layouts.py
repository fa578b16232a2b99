"""Source layouts: recognising them and mapping them to canonical columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import vocab
from ledgerloom.functions import amounts, dates, enums
from ledgerloom.functions.base import blank
from ledgerloom.functions.identifiers import canonical_id
from ledgerloom.functions.text import standard_header

# Fixed values: (layout, fields that identify it), in order of precedence.
FINGERPRINTS = [
    ("SYNTHETIC_PAYMENT", ["payment_id", "order_id", "gateway"]),
    ("SYNTHETIC_ORDER", ["order_id", "merchant_id", "total_amount"]),
    ("SYNTHETIC_INVOICE", ["invoice_id", "order_id", "invoice_number"]),
    ("SYNTHETIC_SETTLEMENT", ["settlement_id", "gross_amount", "net_amount"]),
    ("SYNTHETIC_BANK", ["bank_record_id", "transaction_date", "balance_after"]),
    ("SYNTHETIC_BOOK", ["entry_id", "account_code", "debit", "credit"]),
    ("SYNTHETIC_GST", ["gst_record_id", "seller_gstin", "filing_period"]),
    ("SYNTHETIC_FEE", ["fee_id", "fee_amount", "tax_amount"]),
    ("SYNTHETIC_REFUND", ["refund_id", "refund_amount", "refund_type"]),
    ("SYNTHETIC_ADJUSTMENT", ["adjustment_id", "adjustment_type"]),
    ("SYNTHETIC_MERCHANT", ["merchant_id", "gstin", "bank_ifsc"]),
    ("SYNTHETIC_CUSTOMER", ["customer_id", "merchant_id", "email"]),
    ("RAZORPAY_PAYMENT", ["id", "entity", "amount", "currency", "method"]),
    ("RAZORPAY_SETTLEMENT", ["id", "entity", "amount", "fees", "tax"]),
    ("RAZORPAY_REFUND", ["id", "entity", "amount", "payment_id"]),
    ("RAZORPAY_WEBHOOK", ["event", "payload", "entity"]),
    ("BANK_STATEMENT_CSV", ["transaction_date", "description", "amount", "balance"]),
    ("BANK_STATEMENT_CSV", ["date", "narration", "debit", "credit", "balance"]),
    ("GST_PORTAL", ["gstin", "return_period", "taxable_value"]),
]
# Name part -> layout, first contained part wins.
NAME_PARTS = [
    ("payment", "SYNTHETIC_PAYMENT"), ("order", "SYNTHETIC_ORDER"),
    ("invoice", "SYNTHETIC_INVOICE"), ("settlement", "SYNTHETIC_SETTLEMENT"),
    ("bank_record", "SYNTHETIC_BANK"), ("book", "SYNTHETIC_BOOK"),
    ("gst_record", "SYNTHETIC_GST"), ("fee", "SYNTHETIC_FEE"),
    ("refund", "SYNTHETIC_REFUND"), ("adjustment", "SYNTHETIC_ADJUSTMENT"),
    ("merchant", "SYNTHETIC_MERCHANT"), ("customer", "SYNTHETIC_CUSTOMER"),
]
# Statement header -> column, per bank.
BANK_HEADERS = {
    "HDFC": {
        "Date": "transaction_date", "Narration": "description", "Chq./Ref.No.": "reference",
        "Value Dt": "value_date", "Withdrawal Amt.": "debit_amount",
        "Deposit Amt.": "credit_amount", "Closing Balance": "balance_after",
    },
    "ICICI": {
        "Transaction Date": "transaction_date", "Transaction Remarks": "description",
        "Ref No./Cheque No.": "reference", "Value Date": "value_date",
        "Withdrawal Amount (INR)": "debit_amount", "Deposit Amount (INR)": "credit_amount",
        "Balance (INR)": "balance_after",
    },
    "AXIS": {
        "Tran Date": "transaction_date", "Particulars": "description", "Chq No.": "reference",
        "Debit": "debit_amount", "Credit": "credit_amount", "Balance": "balance_after",
    },
    "SBI": {
        "Txn Date": "transaction_date", "Description": "description",
        "Ref No./Cheque No.": "reference", "Debit": "debit_amount",
        "Credit": "credit_amount", "Balance": "balance_after",
    },
    "GENERIC": {
        "date": "transaction_date", "tran_date": "transaction_date",
        "transaction_date": "transaction_date", "value_date": "value_date",
        "narration": "description", "particulars": "description", "remarks": "description",
        "description": "description", "transaction_remarks": "description",
        "debit": "debit_amount", "dr": "debit_amount", "withdrawal": "debit_amount",
        "credit": "credit_amount", "cr": "credit_amount", "deposit": "credit_amount",
        "amount": "amount",
        "reference": "reference", "ref_no": "reference", "chq_no": "reference", "utr": "utr",
        "balance": "balance_after", "closing_balance": "balance_after",
        "running_balance": "balance_after",
    },
}
# Canonical column -> accepted names; the last one present wins.
INVOICE_NAMES = {
    "invoice_id": ["invoice_id"],
    "invoice_number": ["invoice_number", "invoice_no", "inv_no", "bill_no"],
    "invoice_date": ["invoice_date", "inv_date", "bill_date"],
    "due_date": ["due_date"], "order_id": ["order_id"], "merchant_id": ["merchant_id"],
    "customer_id": ["customer_id"],
    "total_amount": ["total_amount", "total", "net_amount"],
    "subtotal": ["subtotal"], "discount": ["discount"], "taxable_amount": ["taxable_amount"],
    "cgst": ["cgst"], "sgst": ["sgst"], "igst": ["igst"],
    "total_tax": ["total_tax", "tax_amount"], "currency": ["currency"],
    "seller_gstin": ["seller_gstin", "gstin", "gst_no"], "status": ["status"],
}
GST_NAMES = {
    "gst_record_id": ["gst_record_id"], "invoice_id": ["invoice_id"],
    "invoice_number": ["invoice_number"], "merchant_id": ["merchant_id"],
    "seller_gstin": ["seller_gstin", "gstin_of_supplier"],
    "buyer_gstin": ["buyer_gstin", "gstin_of_recipient"], "supply_type": ["supply_type"],
    "taxable_amount": ["taxable_amount", "taxable_value"],
    "cgst": ["cgst", "central_tax"], "sgst": ["sgst", "state_ut_tax"],
    "igst": ["igst", "integrated_tax"], "total_tax": ["total_tax"],
    "total_amount": ["total_amount"], "filing_period": ["filing_period", "return_period"],
    "return_type": ["return_type"], "status": ["status"],
}
BOOK_NAMES = {
    "entry_id": ["entry_id"], "merchant_id": ["merchant_id"],
    "entry_date": ["entry_date", "voucher_date"], "account_code": ["account_code"],
    "account_name": ["account_name", "ledger_name"], "debit": ["debit", "dr_amount"],
    "credit": ["credit", "cr_amount"], "reference_type": ["reference_type"],
    "reference_id": ["reference_id"], "description": ["description", "narration"],
    "entry_type": ["entry_type", "voucher_type"],
}
# Gateway field -> column. ``_paise`` counts hundredths, ``_unix`` seconds.
GATEWAY_PAYMENT = {
    "id": "payment_id", "order_id": "order_id", "merchant_id": "merchant_id",
    "amount": "amount_paise", "currency": "currency", "method": "payment_method",
    "status": "status", "captured": "is_captured", "description": "description",
    "email": "customer_email", "contact": "customer_phone", "created_at": "created_at_unix",
    "captured_at": "captured_at_unix", "error_code": "error_code",
    "error_description": "error_description", "bank": "bank_name",
    "wallet": "wallet_provider", "vpa": "upi_id", "card.name": "card_holder_name",
    "card.network": "card_network", "card.type": "card_type", "card.last4": "card_last4",
    "card.issuer": "card_issuer", "acquirer_data.utr": "utr",
    "acquirer_data.rrn": "bank_reference",
}
GATEWAY_SETTLEMENT = {
    "id": "settlement_id", "entity": "_entity_type", "amount": "net_amount_paise",
    "fees": "total_fees_paise", "tax": "total_fee_tax_paise", "utr": "utr",
    "created_at": "created_at_unix", "description": "description",
}
GATEWAY_REFUND = {
    "id": "refund_id", "entity": "_entity_type", "amount": "refund_amount_paise",
    "currency": "currency", "payment_id": "payment_id", "status": "status",
    "speed_processed": "speed", "notes": "notes", "created_at": "created_at_unix",
    "processed_at": "refund_date_unix",
}
# Upload kind -> (word in the declared type, telling columns), in order.
UPLOAD_KINDS = [
    ("bank_record", "bank", ["bank_record_id", "reference_utr"]),
    ("payment", "payment", ["payment_id"]), ("settlement", "settlement", ["settlement_id"]),
    ("order", "order", ["order_id"]), ("invoice", "invoice", ["invoice_id"]),
    ("refund", "refund", ["refund_id"]), ("fee", "fee", ["fee_id"]),
    ("book", "book", ["entry_id"]), ("gst", "gst", ["gst_record_id"]),
    ("adjustment", "adjustment", ["adjustment_id"]),
]


def standard_headers(df: DataFrame) -> DataFrame:
    """Snake-case headers; when two headers collide the later column wins."""
    latest = {standard_header(name): place for place, name in enumerate(df.columns)}
    positional = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return positional.select(*[F.col(f"_{i}").alias(name) for name, i in latest.items()])


def layout_of_columns(columns: list[str]) -> str:
    have = set(columns)
    return next((name for name, need in FINGERPRINTS if have.issuperset(need)), "UNKNOWN")


def layout_of_keys(keys: Column) -> Column:
    """Layout of each row given the array of field names it holds."""
    out = None
    for name, need in FINGERPRINTS:
        lacking = F.size(F.array_except(F.array(*[F.lit(f) for f in need]), keys))
        out = F.when(lacking == 0, name) if out is None else out.when(lacking == 0, name)
    return out.otherwise("UNKNOWN")


def layout_of_name(name: Column) -> Column:
    text = F.regexp_replace(F.lower(name), "-", "_")
    out = None
    for part, layout in NAME_PARTS:
        hit = text.contains(part)
        out = F.when(hit, layout) if out is None else out.when(hit, layout)
    return out


def bank_of_columns(columns: list[str]) -> str:
    have = {c.strip() for c in columns}
    if {"Narration", "Withdrawal Amt."} <= have:
        return "HDFC"
    if "Transaction Remarks" in have:
        return "ICICI"
    if {"Particulars", "Tran Date"} <= have:
        return "AXIS"
    return "SBI" if "Txn Date" in have else "GENERIC"


def map_bank_statement(df: DataFrame, bank: str | None = None) -> DataFrame:
    """Canonical bank columns; debit and credit fold into one amount and a direction."""
    bank = bank or bank_of_columns(df.columns)
    exact = {c: c for c in df.columns}
    loose = {c.strip().lower(): c for c in reversed(df.columns)}
    found: dict[str, Column] = {}
    for header, target in BANK_HEADERS[bank].items():
        source = exact.get(header) or loose.get(header.lower())
        if source:
            found[target] = F.col(f"`{source}`")
    if "debit_amount" in found or "credit_amount" in found:
        def side(name: str) -> Column:
            value = found.pop(name, F.lit(None).cast("string"))
            text = F.when(blank(value), F.lit("0")).otherwise(value.cast("string"))
            return F.regexp_replace(text, ",", "").try_cast("decimal(18,2)")

        debit, credit = side("debit_amount"), side("credit_amount")
        readable = debit.isNotNull() & credit.isNotNull()
        folded = F.when(readable, F.when(credit > 0, credit).otherwise(debit))
        # An unreadable pair leaves whatever the amount column already held.
        found["amount"] = F.coalesce(folded.cast("string"), found["amount"].cast("string")) \
            if "amount" in found else folded.cast("string")
        found["transaction_type"] = F.when(readable, F.when(credit > 0, "CREDIT").otherwise(
            "DEBIT"))
    record = next((F.col(f"`{c}`") for c in ("reference", "Chq./Ref.No.") if c in exact),
                  F.lit(""))
    return df.select(*[c.alias(t) for t, c in found.items()],
                     F.lit(f"BANK_STATEMENT_{bank}").alias("_source"),
                     record.alias("_source_record_id"))


def map_names(df: DataFrame, names: dict[str, list[str]], source: str, ids: list[str]
              ) -> DataFrame:
    """Canonical columns by accepted name; header case and blanks do not matter."""
    loose = {c.strip().lower(): c for c in reversed(df.columns)}
    picked = []
    for target, accepted in names.items():
        present = [loose[n] for n in accepted if n in loose]
        if present:
            picked.append(F.col(f"`{present[-1]}`").alias(target))
    origin = F.col("_source") if "_source" in df.columns else F.lit(source)
    record = next((F.col(c) for c in ids if c in df.columns), F.lit(""))
    return df.select(*picked, origin.alias("_source"), record.alias("_source_record_id"))


def map_invoices(df: DataFrame) -> DataFrame:
    return map_names(df, INVOICE_NAMES, "SYNTHETIC_INVOICE", ["invoice_id", "invoice_number"])


def map_gst(df: DataFrame) -> DataFrame:
    return map_names(df, GST_NAMES, "SYNTHETIC_GST", ["gst_record_id", "invoice_number"])


def map_books(df: DataFrame) -> DataFrame:
    return map_names(df, BOOK_NAMES, "SYNTHETIC_BOOK", ["entry_id"])


def flatten(df: DataFrame) -> DataFrame:
    """Nested fields become dotted columns."""

    def walk(schema: T.StructType, path: list[str]):
        for field in schema.fields:
            here = [*path, field.name]
            if isinstance(field.dataType, T.StructType):
                yield from walk(field.dataType, here)
            else:
                yield F.col(".".join(f"`{p}`" for p in here)).alias(".".join(here))

    return df.select(*walk(df.schema, []))


def _map_gateway(df: DataFrame, names: dict[str, str], source: str) -> DataFrame:
    flat = flatten(df)
    picked = []
    for name, target in names.items():
        if name not in flat.columns:
            continue
        value = F.col(f"`{name}`")
        if target.endswith("_paise"):
            # Hundredths divide exactly in decimal; other text passes unchanged.
            exact = (value.cast("string").try_cast("decimal(20,0)") / 100).cast("decimal(20,2)")
            value = F.coalesce(exact.cast("string"), value.cast("string"))
        elif target.endswith("_unix"):
            moment = F.timestamp_seconds(value.cast("string").try_cast("bigint"))
            value = F.coalesce(dates.iso_text(moment), value.cast("string"))
        picked.append(value.alias(target))
    record = F.coalesce(F.col("`id`"), F.lit("")) if "id" in flat.columns else F.lit("")
    return flat.select(*picked, F.lit(source).alias("_source"),
                       record.alias("_source_record_id"))


def map_gateway_payments(df: DataFrame) -> DataFrame:
    return _map_gateway(df, GATEWAY_PAYMENT, "RAZORPAY_PAYMENT")


def map_gateway_settlements(df: DataFrame) -> DataFrame:
    return _map_gateway(df, GATEWAY_SETTLEMENT, "RAZORPAY_SETTLEMENT")


def map_gateway_refunds(df: DataFrame) -> DataFrame:
    return _map_gateway(df, GATEWAY_REFUND, "RAZORPAY_REFUND")


def upload_kind(declared: str | None, columns: list[str]) -> str:
    word = (declared or "auto_detect").lower()
    have = {standard_header(c) for c in columns}
    return next((kind for kind, part, telling in UPLOAD_KINDS
                 if part in word or have.intersection(telling)), "bank_record")


def _first(df: DataFrame, *names: str) -> Column:
    """First of the named columns that holds something."""
    held = [F.when(~blank(n), F.col(n)) for n in names if n in df.columns]
    return F.coalesce(*held, F.lit(None).cast("string"))


def map_upload(df: DataFrame, kind: str, source_file: str) -> DataFrame:
    """Uploaded rows of the three supported kinds, with defaults for optional fields only.

    A missing id or an unreadable amount or merchant is listed in ``_errors``
    and left null; no id, merchant or money is ever made up.
    """
    raw = standard_headers(df)
    out: dict[str, Column] = {}
    errors: list[Column] = []

    def identity(target: str, *names: str) -> Column:
        value = _first(raw, *names)
        out[target] = canonical_id(value)
        errors.append(F.when(canonical_id(value).isNull(), F.lit(f"MISSING_REQUIRED: {target}")))
        return value

    def money(target: str, value: Column) -> None:
        out[target] = amounts.parse_amount(value)
        errors.append(amounts.amount_error(value, target))
        errors.append(F.when(amounts.amount_absent(value), F.lit(f"MISSING_REQUIRED: {target}")))

    if kind == "bank_record":
        record = identity("bank_record_id", "bank_record_id", "id", "record_id")
        identity("merchant_id", "merchant_id")
        money("amount", _first(raw, "amount", "net_amount"))
        word = F.upper(F.coalesce(_first(raw, "type", "transaction_type"), F.lit("CREDIT")))
        out["transaction_type"] = F.when(word.isin("CREDIT", "DEBIT"), word).otherwise("CREDIT")
        day = dates.upload_date(_first(raw, "transaction_date", "date")).try_cast("date")
        out["transaction_date"], out["value_date"] = day, day
        out["reference"] = _first(raw, "reference_utr", "reference", "utr", "ref")
        out["canonical_reference"] = out["reference"]
        text = _first(raw, "description", "narration")
        out["description"] = F.coalesce(text, F.concat(F.lit("Transaction "),
                                                       out["bank_record_id"]))
        out["currency"] = F.substring(F.upper(F.coalesce(_first(raw, "currency"),
                                                         F.lit("INR"))), 1, 3)
    elif kind == "payment":
        record = identity("payment_id", "payment_id", "id")
        identity("merchant_id", "merchant_id")
        identity("order_id", "order_id")
        money("amount", _first(raw, "amount"))
        out["currency"] = F.lit("INR")
        out["status"] = enums.status(F.coalesce(_first(raw, "status"), F.lit("captured")),
                                     "payment")
    elif kind == "settlement":
        record = identity("settlement_id", "settlement_id", "id")
        identity("merchant_id", "merchant_id")
        money("net_amount", _first(raw, "net_amount", "amount"))
        gross = amounts.parse_amount(_first(raw, "gross_amount"))
        out["gross_amount"] = F.coalesce(gross, out["net_amount"])
        out["utr"] = _first(raw, "utr", "reference")
        out["currency"] = F.lit("INR")
        out["status"] = enums.status(F.coalesce(_first(raw, "status"), F.lit("settled")),
                                     "settlement")
    else:
        raise ValueError(f"uploads of {kind} are not supported")
    out["lineage_source"] = F.lit("USER_UPLOAD")
    out["lineage_source_record_id"] = record
    out["lineage_source_file_id"] = F.lit(source_file)
    out["lineage_normalizer_ver"] = F.lit(vocab.CANONICALIZER_VERSION)
    return raw.select(*[c.alias(n) for n, c in out.items()],
                      F.array_compact(F.array(*errors)).alias("_errors"))


def merchant_stubs(df: DataFrame, merchants: DataFrame) -> DataFrame:
    """Rows for merchants that are referred to but not known yet."""
    wanted = df.select("merchant_id").filter(F.col("merchant_id").isNotNull()).distinct()
    return wanted.join(merchants.select("merchant_id"), "merchant_id", "left_anti").select(
        "merchant_id", F.concat(F.lit("Merchant "), F.col("merchant_id")).alias("merchant_name"),
        F.lit("GENERAL").alias("industry"),
        F.concat(F.lit("27AABC"), F.expr("right(regexp_replace(merchant_id, '_', ''), 7)"),
                 F.lit("Z1")).alias("gstin"),
        F.lit("INR").alias("currency"), F.lit("ACTIVE").alias("status"))
