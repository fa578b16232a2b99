"""Vocabularies, lookup tables, formats and model contracts.

Everything here must equal the published behaviour for results to agree, so
the values are stated as they are.
"""

from __future__ import annotations

# --- pair types, methods, statuses ------------------------------------------

ORDER_PAYMENT = "ORDER_PAYMENT"
ORDER_INVOICE = "ORDER_INVOICE"
PAYMENT_FEE = "PAYMENT_FEE"
PAYMENT_REFUND = "PAYMENT_REFUND"
PAYMENT_SETTLEMENT = "PAYMENT_SETTLEMENT"
SETTLEMENT_BANK = "SETTLEMENT_BANK"
INVOICE_GST = "INVOICE_GST"
EVENT_BOOKS = "EVENT_BOOKS"
SETTLEMENT_ADJUSTMENT = "SETTLEMENT_ADJUSTMENT"
SETTLEMENT_ARITHMETIC = "SETTLEMENT_ARITHMETIC"

MATCHED = "MATCHED_EXACT"
DISCREPANCY = "MATCHED_WITH_DISCREPANCY"
UNMATCHED = "UNMATCHED"
AMBIGUOUS = "AMBIGUOUS"
ML_MATCHED = "MATCHED_ML"

# Higher is worse; the first of equals wins.
STATUS_RANK = {UNMATCHED: 3, AMBIGUOUS: 3, DISCREPANCY: 2, ML_MATCHED: 1, MATCHED: 0}
STATUSES_TO_CLASSIFY = [UNMATCHED, AMBIGUOUS, DISCREPANCY]

ENTITY_CODES = {
    "order": "ORD", "orders": "ORD",
    "invoice": "INV", "invoices": "INV",
    "payment": "PAY", "payments": "PAY",
    "fee": "FEE", "fees": "FEE",
    "refund": "REF", "refunds": "REF",
    "settlement": "STL", "settlements": "STL",
    "bank": "BNK", "bank_record": "BNK", "bank_records": "BNK",
    "book": "LED", "books": "LED",
    "gst": "GST", "gst_records": "GST",
    "adjustment": "ADJ", "adjustments": "ADJ",
}

# --- run settings -------------------------------------------------------------

WINDOW_DAYS = 25
CANDIDATE_LIMIT = 20
AMBIGUITY_MARGIN = 0.08
MATCH_THRESHOLD = 0.275
NORMALIZER_VERSION = "v1.0.0"
CANONICALIZER_VERSION = "v2.0.0"

# --- identifiers --------------------------------------------------------------

ID_WIDTH = 6
# canonical prefix -> accepted spellings, longest first
ID_FAMILIES = {
    "ORD": ["ORDER", "ORD", "O"],
    "INV": ["INVOICE", "INV", "I"],
    "PAY": ["PAYMENT", "PAY", "P"],
    "STL": ["SETTLEMENT", "STL", "S"],
    "FEE": ["FEE", "F"],
    "REF": ["REFUND", "REF", "R"],
    "GST": ["GST", "G"],
    "ADJ": ["ADJUSTMENT", "ADJ", "A"],
    "BNK": ["BANK", "BNK", "B"],
    "LED": ["LEDGER", "LED", "L"],
    "MER": ["MERCHANT", "MER", "M"],
    "CUS": ["CUSTOMER", "CUS", "C"],
}
# canonical prefix -> aliases used for lookup keys (a smaller set than above)
LOOKUP_ALIASES = {
    "MER": ["MER", "MERCHANT"],
    "CUS": ["CUS", "CUSTOMER"],
    "ORD": ["ORD", "ORDER", "O"],
    "INV": ["INV", "INVOICE"],
    "PAY": ["PAY", "PAYMENT"],
    "FEE": ["FEE"],
    "REF": ["REF", "REFUND"],
    "STL": ["STL", "SETTLEMENT", "S"],
    "BNK": ["BNK", "BANK"],
    "LED": ["LED", "LEDGER"],
    "GST": ["GST"],
    "ADJ": ["ADJ", "ADJUSTMENT"],
}

# --- currency -----------------------------------------------------------------

DEFAULT_CURRENCY = "INR"
CURRENCY_ALIASES = {
    "₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR", "rupee": "INR",
    "rupees": "INR", "indian rupee": "INR",
    "$": "USD", "usd": "USD", "us dollar": "USD", "dollar": "USD",
    "€": "EUR", "eur": "EUR", "euro": "EUR",
    "£": "GBP", "gbp": "GBP", "pound": "GBP", "sterling": "GBP",
    "¥": "JPY", "jpy": "JPY", "yen": "JPY",
}
CURRENCY_CODES = ["INR", "USD", "EUR", "GBP", "JPY", "AED", "SGD", "AUD"]

# --- statuses -----------------------------------------------------------------

STATUS_WORDS = {
    "payment": {
        "captured": "CAPTURED", "paid": "CAPTURED", "success": "CAPTURED",
        "successful": "CAPTURED", "settled": "CAPTURED", "completed": "CAPTURED",
        "approved": "CAPTURED",
        "failed": "FAILED", "failure": "FAILED", "declined": "FAILED",
        "rejected": "FAILED", "error": "FAILED", "cancelled": "FAILED",
        "canceled": "FAILED",
        "authorized": "AUTHORIZED", "auth": "AUTHORIZED", "on_hold": "AUTHORIZED",
        "refunded": "REFUNDED", "reversed": "REFUNDED", "chargeback": "REFUNDED",
        "pending": "PENDING", "processing": "PENDING", "created": "PENDING",
        "initiated": "PENDING", "in_progress": "PENDING",
    },
    "order": {
        "completed": "COMPLETED", "complete": "COMPLETED", "confirmed": "COMPLETED",
        "delivered": "COMPLETED", "fulfilled": "COMPLETED",
        "cancelled": "CANCELLED", "canceled": "CANCELLED",
        "cancellation": "CANCELLED", "abandoned": "CANCELLED",
        "pending": "PENDING", "placed": "PENDING", "processing": "PENDING",
        "created": "PENDING",
    },
    "settlement": {
        "settled": "SETTLED", "processed": "SETTLED", "completed": "SETTLED",
        "paid": "SETTLED",
        "pending": "PENDING", "processing": "PENDING", "initiated": "PENDING",
        "failed": "FAILED", "error": "FAILED", "rejected": "FAILED",
    },
    "refund": {
        "processed": "PROCESSED", "completed": "PROCESSED", "success": "PROCESSED",
        "successful": "PROCESSED", "paid": "PROCESSED",
        "pending": "PENDING", "initiated": "PENDING", "processing": "PENDING",
        "failed": "FAILED", "error": "FAILED", "rejected": "FAILED",
    },
    "invoice": {
        "issued": "ISSUED", "sent": "ISSUED", "generated": "ISSUED",
        "paid": "PAID", "settled": "PAID", "cleared": "PAID",
        "cancelled": "CANCELLED", "canceled": "CANCELLED", "voided": "CANCELLED",
        "overdue": "OVERDUE", "expired": "OVERDUE", "past_due": "OVERDUE",
    },
    "bank": {
        "credit": "CREDIT", "cr": "CREDIT", "deposit": "CREDIT", "receipt": "CREDIT",
        "debit": "DEBIT", "dr": "DEBIT", "withdrawal": "DEBIT", "payment": "DEBIT",
    },
    "gst": {
        "filed": "FILED", "submitted": "FILED",
        "pending": "PENDING", "due": "PENDING",
        "revised": "REVISED", "amended": "REVISED",
    },
}

# --- enums --------------------------------------------------------------------

ENUM_WORDS = {
    "payment_method": {
        "upi": "UPI", "unified payments interface": "UPI",
        "card": "CARD", "credit card": "CARD", "debit card": "CARD",
        "netbanking": "NETBANKING", "net_banking": "NETBANKING",
        "net banking": "NETBANKING", "internet banking": "NETBANKING",
        "ib": "NETBANKING",
        "wallet": "WALLET", "e-wallet": "WALLET", "ewallet": "WALLET",
        "emi": "EMI", "buy_now_pay_later": "BNPL", "bnpl": "BNPL", "paylater": "BNPL",
    },
    "card_type": {
        "credit": "CREDIT", "credit card": "CREDIT", "debit": "DEBIT",
        "debit card": "DEBIT", "prepaid": "PREPAID", "corporate": "CORPORATE",
    },
    "card_network": {
        "visa": "VISA", "mastercard": "MASTERCARD", "master": "MASTERCARD",
        "mc": "MASTERCARD", "rupay": "RUPAY", "ru pay": "RUPAY", "amex": "AMEX",
        "american express": "AMEX", "maestro": "MAESTRO", "discover": "DISCOVER",
        "diners": "DINERS", "diners club": "DINERS",
    },
    "entry_type": {
        "sale": "SALE", "revenue": "SALE", "income": "SALE",
        "payment": "PAYMENT", "receipt": "PAYMENT",
        "fee": "FEE", "charge": "FEE", "commission": "FEE",
        "refund": "REFUND", "reversal": "REFUND",
        "settlement": "SETTLEMENT", "payout": "SETTLEMENT",
        "tax": "TAX", "gst": "TAX",
        "adjustment": "ADJUSTMENT", "correction": "ADJUSTMENT",
        "write_off": "ADJUSTMENT",
    },
    "adjustment_type": {
        "chargeback": "CHARGEBACK", "charge_back": "CHARGEBACK",
        "dispute": "CHARGEBACK", "rounding": "ROUNDING",
        "rounding_adjustment": "ROUNDING", "reversal": "REVERSAL",
        "reversed": "REVERSAL", "manual": "MANUAL_ADJUSTMENT",
        "manual_adjustment": "MANUAL_ADJUSTMENT",
        "settlement_adjustment": "SETTLEMENT_ADJUSTMENT",
    },
    "supply_type": {
        "intra_state": "INTRA_STATE", "intra-state": "INTRA_STATE",
        "intrastate": "INTRA_STATE", "local": "INTRA_STATE",
        "inter_state": "INTER_STATE", "inter-state": "INTER_STATE",
        "interstate": "INTER_STATE", "central": "INTER_STATE",
    },
}

# --- fees and taxes -----------------------------------------------------------

# method -> (rate, least fee, greatest fee)
FEE_RATES = {
    "UPI": ("0.0000", "0.00", "0.00"),
    "CARD": ("0.0180", "2.00", "5000.00"),
    "NETBANKING": ("0.0150", "5.00", "3000.00"),
    "WALLET": ("0.0200", "1.00", "2000.00"),
}
GST_RATE = "0.18"
HALF_GST_RATE = "0.09"

# --- ledger accounts: key -> (code, name) -------------------------------------

ACCOUNTS = {
    "REVENUE": ("4000", "Revenue"),
    "ACCOUNTS_RECEIVABLE": ("1200", "Accounts Receivable"),
    "CGST_PAYABLE": ("2101", "CGST Payable"),
    "SGST_PAYABLE": ("2102", "SGST Payable"),
    "IGST_PAYABLE": ("2103", "IGST Payable"),
    "GATEWAY_RECEIVABLE": ("1210", "Gateway Receivable"),
    "PROCESSING_FEE": ("5100", "Payment Processing Fee"),
    "FEE_GST_INPUT": ("1300", "GST Input Credit (Fees)"),
    "REFUND_EXPENSE": ("5200", "Refund Expense"),
    "BANK_ACCOUNT": ("1100", "Bank Account"),
    "ADJUSTMENT_INCOME": ("4100", "Adjustment Income"),
    "ADJUSTMENT_EXPENSE": ("5300", "Adjustment Expense"),
}

# --- fields per entity --------------------------------------------------------

AMOUNT_FIELDS = {
    "payment": ["amount"],
    "order": ["subtotal", "discount", "taxable_amount", "cgst", "sgst", "igst",
              "total_tax", "total_amount"],
    "invoice": ["subtotal", "discount", "taxable_amount", "cgst", "sgst", "igst",
                "total_tax", "total_amount"],
    "settlement": ["gross_amount", "total_fees", "total_fee_tax", "total_refunds",
                   "total_adjustments", "net_amount"],
    "bank": ["amount", "balance_after"],
    "book": ["debit", "credit"],
    "fee": ["fee_amount", "tax_amount", "total_fee"],
    "refund": ["refund_amount"],
    "gst": ["taxable_amount", "cgst", "sgst", "igst", "total_tax", "total_amount"],
    "adjustment": ["amount"],
}
DATE_FIELDS = {
    "payment": ["payment_date", "captured_at"],
    "order": ["order_date"],
    "invoice": ["invoice_date"],
    "settlement": ["settlement_date"],
    "bank": ["transaction_date", "value_date"],
    "book": ["entry_date"],
    "refund": ["refund_date"],
    "adjustment": ["adjustment_date"],
}
LOOKUP_KEY_FIELDS = {
    "payment": ("payment_id", "canonical_payment_id"),
    "order": ("order_id", "canonical_order_id"),
    "invoice": ("invoice_number", "normalized_invoice_number"),
    "settlement": ("settlement_id", "canonical_settlement_id"),
    "bank": ("reference", "canonical_reference"),
    "book": ("reference_id", "canonical_reference_id"),
}
REQUIRED_FIELDS = {
    "payment": ["payment_id", "order_id", "amount"],
    "order": ["order_id", "merchant_id", "total_amount"],
    "invoice": ["invoice_id", "order_id", "total_amount"],
    "settlement": ["settlement_id", "merchant_id", "net_amount"],
    "bank": ["bank_record_id", "merchant_id", "amount"],
    "book": ["entry_id", "merchant_id"],
    "fee": ["fee_id", "payment_id", "fee_amount"],
    "refund": ["refund_id", "payment_id", "refund_amount"],
    "gst": ["gst_record_id", "invoice_id"],
    "adjustment": ["adjustment_id", "settlement_id"],
}
VALIDATED_FIELDS = {
    "order": ["order_id", "merchant_id", "customer_id", "total_amount",
              "taxable_amount", "total_tax", "currency"],
    "payment": ["payment_id", "order_id", "amount", "currency", "status"],
    "invoice": ["invoice_id", "order_id", "invoice_number", "total_amount",
                "taxable_amount", "currency"],
    "settlement": ["settlement_id", "merchant_id", "gross_amount", "net_amount",
                   "currency"],
    "bank": ["bank_record_id", "merchant_id", "amount", "transaction_date", "currency"],
    "book": ["entry_id", "merchant_id", "entry_date", "account_code"],
    "fee": ["fee_id", "payment_id", "fee_amount", "tax_amount"],
}
CONTENT_FIELDS = {
    "payment": ["payment_id", "amount", "currency", "order_id"],
    "bank": ["amount", "transaction_date", "reference", "description"],
    "settlement": ["settlement_id", "net_amount", "utr"],
    "invoice": ["invoice_number", "total_amount", "invoice_date"],
    "book": ["entry_id", "debit", "credit", "account_code", "entry_date"],
    "fee": ["fee_id", "payment_id", "fee_amount"],
    "refund": ["refund_id", "payment_id", "refund_amount"],
}
PAYMENT_STATUSES = ["CAPTURED", "FAILED", "AUTHORIZED", "REFUNDED", "PENDING"]
BLOCKING_CODES = ["MISSING_REQUIRED", "ARITHMETIC_FAIL", "AMOUNT_PARSE_ERROR"]

PRIMARY_KEYS = {
    "merchants": "merchant_id", "customers": "customer_id", "orders": "order_id",
    "invoices": "invoice_id", "gst_records": "gst_record_id",
    "payments": "payment_id", "fees": "fee_id", "refunds": "refund_id",
    "settlements": "settlement_id", "bank_records": "bank_record_id",
    "books": "entry_id", "adjustments": "adjustment_id",
}
# (child table, column, parent table) in audit order
FOREIGN_KEYS = [
    ("customers", "merchant_id", "merchants"),
    ("orders", "merchant_id", "merchants"),
    ("orders", "customer_id", "customers"),
    ("invoices", "merchant_id", "merchants"),
    ("invoices", "customer_id", "customers"),
    ("invoices", "order_id", "orders"),
    ("payments", "merchant_id", "merchants"),
    ("payments", "customer_id", "customers"),
    ("payments", "order_id", "orders"),
    ("fees", "merchant_id", "merchants"),
    ("fees", "payment_id", "payments"),
    ("refunds", "merchant_id", "merchants"),
    ("refunds", "order_id", "orders"),
    ("refunds", "payment_id", "payments"),
    ("gst_records", "merchant_id", "merchants"),
    ("gst_records", "invoice_id", "invoices"),
    ("settlements", "merchant_id", "merchants"),
    ("settlement_payments", "settlement_id", "settlements"),
    ("settlement_payments", "payment_id", "payments"),
    ("bank_records", "merchant_id", "merchants"),
    ("bank_records", "settlement_id", "settlements"),
    ("adjustments", "merchant_id", "merchants"),
    ("adjustments", "settlement_id", "settlements"),
]
CRITICAL_FK_COLUMNS = ["merchant_id", "order_id", "payment_id", "invoice_id"]

# --- exception taxonomy -------------------------------------------------------

EXCEPTION_CLASSES = [
    "AMOUNT_DISCREPANCY", "DESCRIPTION_MISMATCH", "DUPLICATE", "FORMAT_MISMATCH",
    "MISSING_RECORD", "TIMING_DIFFERENCE", "WRONG_REFERENCE",
]
# change type -> (class, severity, hint, needs a person)
CHANGE_CLASSES = {
    "ID_NOISE": ("FORMAT_MISMATCH", "LOW",
                 "Normalize ID formats and retry matching", False),
    "DESCRIPTION_NOISE": ("DESCRIPTION_MISMATCH", "LOW",
                          "Apply fuzzy text matching on narration/description", False),
    "DATE_NOISE": ("TIMING_DIFFERENCE", "LOW",
                   "Apply date tolerance window (T+1 to T+3)", False),
    "AMOUNT_NOISE": ("AMOUNT_DISCREPANCY", "MEDIUM",
                     "Investigate fee/tax/settlement arithmetic", True),
    "MISSING_RECORD": ("MISSING_RECORD", "HIGH",
                       "Unmatched record — no counterpart found in target system", True),
    "DUPLICATE": ("DUPLICATE", "MEDIUM",
                  "Potential duplicate entry — verify and deduplicate", True),
    "WRONG_REFERENCE": ("WRONG_REFERENCE", "HIGH",
                        "Cross-reference points to incorrect entity — manual "
                        "investigation needed", True),
}
# cause -> (severity, hint)
AMOUNT_CAUSES = {
    "FEE_ADJUSTMENT": ("MEDIUM", "Fee calculation difference — verify fee rules applied"),
    "PARTIAL_SETTLEMENT": ("HIGH", "Settlement amount doesn't match expected — check "
                                   "partial payout"),
    "TAX_MISMATCH": ("MEDIUM", "Tax calculation discrepancy — verify GST rates"),
    "ROUNDING": ("LOW", "Minor rounding difference — auto-resolve within threshold"),
    "UNKNOWN": ("HIGH", "Unexplained amount difference — escalate for manual review"),
}

# --- model contracts ----------------------------------------------------------

MATCH_FEATURES = [
    "absolute_amount_difference", "absolute_amount_difference_vs_gross",
    "amount_difference", "amount_ratio", "bank_amount", "bank_category",
    "best_vs_second_best_amount_gap", "best_vs_second_best_date_gap",
    "best_vs_second_best_reference_gap", "candidate_count",
    "candidate_rank_by_amount", "candidate_rank_by_date",
    "candidate_rank_by_reference", "date_difference_days",
    "description_token_overlap", "exact_amount_match", "is_best_amount_candidate",
    "is_best_date_candidate", "is_best_reference_candidate", "merchant_match",
    "payment_count", "reference_exact_match", "relative_amount_difference",
    "same_day", "settlement_fee_amount", "settlement_fee_tax_amount",
    "settlement_gross_amount", "settlement_net_amount", "settlement_refund_amount",
    "transaction_type_is_credit", "utr_similarity", "value_date_difference_days",
    "within_1_day", "within_3_days", "within_7_days",
]
MATCH_CATEGORICAL = ["bank_category"]
EXCEPTION_FEATURES = [
    "entity_type", "affected_field", "value_pair_present", "value_exact_match",
    "value_normalized_id_match", "value_str_similarity", "value_token_overlap",
    "value_numeric_diff", "value_numeric_abs_diff", "value_numeric_rel_diff",
    "value_is_numeric_pair", "value_date_diff_days", "value_is_date_pair",
    "entity_amount", "fee_amount_context", "tax_amount_context",
    "refund_amount_context", "adjustment_amount_context", "diff_to_adjustment_ratio",
]
EXCEPTION_CATEGORICAL = ["entity_type", "affected_field"]

AMOUNT_GROUP = [
    "bank_amount", "settlement_net_amount", "settlement_gross_amount",
    "settlement_fee_amount", "settlement_fee_tax_amount", "settlement_refund_amount",
    "amount_difference", "absolute_amount_difference", "relative_amount_difference",
    "amount_ratio", "exact_amount_match", "absolute_amount_difference_vs_gross",
]
DATE_GROUP = ["date_difference_days", "value_date_difference_days", "same_day",
              "within_1_day", "within_3_days", "within_7_days"]
REFERENCE_GROUP = ["reference_exact_match", "utr_similarity",
                   "settlement_id_in_description", "description_token_overlap"]
ENTITY_GROUP = ["merchant_match"]
CONTEXT_GROUP = ["transaction_type_is_credit", "bank_category", "payment_count"]
AMBIGUITY_GROUP = [
    "candidate_count", "candidate_rank_by_amount", "candidate_rank_by_date",
    "candidate_rank_by_reference", "is_best_amount_candidate", "is_best_date_candidate",
    "is_best_reference_candidate", "best_vs_second_best_amount_gap",
    "best_vs_second_best_date_gap", "best_vs_second_best_reference_gap",
]

# --- documents and questions --------------------------------------------------

DOCUMENT_SUFFIXES = [".md", ".txt", ".rst"]
EXCLUDED_NAME_PARTS = [".env", ".env.example", ".gitignore", ".secret", "__pycache__",
                       ".pyc", ".env.local", ".env.*"]
QUESTION_STOPWORDS = ["the", "a", "an", "is", "of", "and", "in", "to", "what", "how",
                      "why", "are", "for"]
SENTENCE_MARKS = [". ", "! ", "? ", "\n\n", "\n"]
# (pattern, record type), first match wins
MENTION_PATTERNS = [
    (r"(BNK_\w+)", "bank_record"),
    (r"(PAY_\w+)", "payment"),
    (r"(STL_\w+)", "settlement"),
    (r"(ORD_\w+)", "order"),
    (r"(TXN\w+)", "transaction"),
]
GENERIC_NARRATIONS = ["BANK TRANSFER CREDIT", "NEFT CREDIT", "ACCOUNT CREDIT",
                      "ONLINE TRANSFER", "BANK CREDIT", "ELECTRONIC TRANSFER",
                      "TRANSFER CREDIT"]
