"""Money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import vocab
from ledgerloom.functions.base import col, lookup, strip

MONEY = "decimal(15,2)"
RATE = "decimal(5,4)"
# Stripped one after the other, because removing one mark can join the next.
_MARKS = ["₹", r"(?i)Rs\.?\s*", r"(?i)INR\s*", "[$€£¥]", r"(?i)USD\s*", r"(?i)EUR\s*", ","]
_ABSENT = ["", "null", "none", "n/a", "-"]


def _bare(value: Column | str) -> Column:
    text = strip(col(value).cast("string"))
    for mark in _MARKS:
        text = F.regexp_replace(text, mark, "")
    return strip(text)


def amount_absent(value: Column | str) -> Column:
    text = strip(col(value).cast("string"))
    return text.isNull() | F.lower(text).isin(_ABSENT)


def parse_amount(value: Column | str) -> Column:
    """Money rounded half up, or null when absent or unreadable; never zero by default."""
    text = _bare(value)
    return F.when(
        ~amount_absent(value) & text.rlike(r"^-?\d+(\.\d+)?$"), text.try_cast(MONEY)
    )


def amount_error(value: Column | str, field: str, parsed: Column | None = None) -> Column:
    """Error text when a value is present but no amount can be read from it.

    ``parsed`` is the amount already read from the value, when there is one.
    """
    raw = col(value).cast("string")
    read = parse_amount(value) if parsed is None else parsed
    return F.when(
        ~amount_absent(value) & read.isNull(),
        F.concat(F.lit(f"AMOUNT_PARSE_ERROR: {field}: "), strip(raw)),
    )


def amount_text(value: Column | str) -> Column:
    return col(value).cast(MONEY).cast("string")


def to_number(value: Column | str) -> Column:
    """Anything that reads as a plain or scientific number, as double; else null."""
    text = strip(col(value).cast("string"))
    shape = r"^[+-]?(\d[\d_]*\.?[\d_]*|\.\d[\d_]*)([eE][+-]?\d+)?$"
    return F.when(text.rlike(shape), F.regexp_replace(text, "_", "").try_cast("double"))


def amounts_equal(left: Column | str, right: Column | str, tolerance: str = "0.01") -> Column:
    """Strictly closer than the tolerance; unknown amounts are never equal."""
    gap = F.abs(col(left) - col(right))
    return F.coalesce(gap < F.lit(tolerance).cast("decimal(15,4)"), F.lit(False))


def amounts_close(left: Column | str, right: Column | str, share: float = 0.02,
                  absolute: float = 1.0) -> Column:
    a, b = col(left).cast("double"), col(right).cast("double")
    gap = F.abs(a - b)
    top = F.greatest(F.abs(a), F.abs(b))
    # Rounding to the stored scale keeps binary noise out of the comparison.
    near = (F.round(F.try_divide(gap, top), 12) <= share) | (F.round(gap, 6) <= absolute)
    return F.coalesce(F.when(top == 0, gap == 0).otherwise(near), F.lit(False))


def order_tax(subtotal: Column, discount_rate: Column, seller: Column, buyer: Column) -> dict:
    """Discount, taxable amount and tax parts of one order line, each rounded half up."""
    discount = F.round(subtotal * discount_rate, 2).cast(MONEY)
    taxable = F.round(subtotal - discount, 2).cast(MONEY)
    zero = F.lit("0.00").cast(MONEY)
    half = F.round(taxable * F.lit(vocab.HALF_GST_RATE).cast(RATE), 2).cast(MONEY)
    full = F.round(taxable * F.lit(vocab.GST_RATE).cast(RATE), 2).cast(MONEY)
    local = F.coalesce(seller == buyer, F.lit(False))
    cgst = F.when(local, half).otherwise(zero)
    igst = F.when(local, zero).otherwise(full)
    tax = (cgst + cgst + igst).cast(MONEY)
    return {
        "discount": discount, "taxable_amount": taxable, "cgst": cgst, "sgst": cgst,
        "igst": igst, "total_tax": tax, "total_amount": (taxable + tax).cast(MONEY),
    }


def gateway_fee(amount: Column, method: Column) -> dict:
    """Clamped fee, its tax and their sum; a zero-rate method is free."""
    rate = lookup({k: v[0] for k, v in vocab.FEE_RATES.items()}, method).cast(RATE)
    least = lookup({k: v[1] for k, v in vocab.FEE_RATES.items()}, method).cast(MONEY)
    most = lookup({k: v[2] for k, v in vocab.FEE_RATES.items()}, method).cast(MONEY)
    clamped = F.least(F.greatest(F.round(amount * rate, 2).cast(MONEY), least), most)
    fee = F.when(rate == 0, F.lit("0.00").cast(MONEY)).otherwise(clamped)
    tax = F.round(fee * F.lit(vocab.GST_RATE).cast(RATE), 2).cast(MONEY)
    return {"fee_amount": fee, "tax_amount": tax, "total_fee": (fee + tax).cast(MONEY)}


def settlement_net(gross: Column, fees: Column, fee_tax: Column, refunds: Column,
                   adjustments: Column) -> Column:
    return F.round(gross - fees - fee_tax - refunds + adjustments, 2).cast(MONEY)


def refund_amount(amount: Column, kind: Column, fraction: Column | None = None) -> Column:
    part = F.lit("0.50").cast(RATE) if fraction is None else fraction
    return (
        F.when(kind.isin("FULL", "REVERSAL"), amount)
        .when(kind == "PARTIAL", F.round(amount * part, 2).cast(MONEY))
    )
