"""Column functions against the published examples."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, dates, enums, identifiers, similarity, text

CANONICAL = {
    "ORD_000123": "ORD_000123", "ORD-000123": "ORD_000123", "ORD/000123": "ORD_000123",
    "ord_000123": "ORD_000123", "ord000123": "ORD_000123", "ORDER_000123": "ORD_000123",
    "ORDER000123": "ORD_000123", "O-000123": "ORD_000123", "INV/000001": "INV_000001",
    "inv_000005": "INV_000005", "INV-001016": "INV_001016", "PAY000014": "PAY_000014",
    "P-000006": "PAY_000006", "P000638": "PAY_000638", "SETTLEMENT_000001": "STL_000001",
    "FEE_000001": "FEE_000001", "GST_000001": "GST_000001", "BNK_000001": "BNK_000001",
    "ADJ_000001": "ADJ_000001", "LED_000001": "LED_000001", "MER_000001": "MER_000001",
    "CUS_000001": "CUS_000001", "I_001545": "INV_001545", "S_000003": "STL_000003",
    " ord_7 ": "ORD_000007", "ORD_12345678": "ORD_12345678", "RANDOMSTRING": None,
    "BNK_000001_DUP": None, "": None,
}


def values(spark, items, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v string")
    return [r.x for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_canonical_ids(spark):
    assert values(spark, CANONICAL, identifiers.canonical_id) == list(CANONICAL.values())


def test_lookup_keys(spark):
    got = values(spark, ["ORD-000123", "ORDER_000123", "ord/123", "I-5", None],
                 identifiers.lookup_key)
    assert got == ["ORD000123", "ORD000123", "ORD123", "I5", ""]


def test_amounts(spark):
    cases = {"₹5,000": "5000.00", "Rs. 5000": "5000.00", "INR 5,000.00": "5000.00",
             "5000": "5000.00", "-200.50": "-200.50", "0.005": "0.01", "": None, "n/a": None,
             "₹10O0": None, "1.2.3": None, None: None}
    got = values(spark, cases, lambda c: amounts.parse_amount(c).cast("string"))
    assert got == list(cases.values())
    flagged = values(spark, cases, lambda c: amounts.amount_error(c, "amount").isNotNull())
    assert flagged == [False] * 8 + [True, True, False]


def test_instants(spark):
    cases = {
        "2026-08-01T10:30:00+05:30": "2026-08-01T05:00:00+00:00",
        "2026-08-01T10:30:00.250000+0000": "2026-08-01T10:30:00.250000+00:00",
        "2026-08-01": "2026-07-31T18:30:00+00:00", "01/08/2026": "2026-07-31T18:30:00+00:00",
        "08/31/2026": "2026-08-30T18:30:00+00:00", "01-08-2026": "2026-07-31T18:30:00+00:00",
        "Aug 01 2026": "2026-07-31T18:30:00+00:00", "1 august 2026": "2026-07-31T18:30:00+00:00",
        "01 Aug 2026 10:30:00": "2026-08-01T05:00:00+00:00", "2026-02-30": None, "soon": None,
    }
    got = values(spark, cases, lambda c: dates.iso_text(dates.parse_instant(c)))
    assert got == list(cases.values())


def test_written_dates(spark):
    got = values(spark, ["2026-08-01T23:59:00+05:30", "20260801", "95.00", None],
                 lambda c: dates.written_date(c).cast("string"))
    assert got == ["2026-08-01", "2026-08-01", None, None]


def test_text(spark):
    assert values(spark, ["  RAZORPAY-SETTLEMENT / STL_001  ", "ﬁne № 5"], text.clean_text) == [
        "razorpay settlement stl 001", "fine no 5"]
    assert values(spark, ["NEFT CR upi pay", "CR NEFT x"], text.clean_narration) == [
        "upi pay", "neft x"]
    assert values(spark, ["  shopease india pvt. ltd.  "], text.clean_name) == [
        "shopease india pvt ltd"]


def test_enums(spark):
    assert values(spark, ["₹", "Rs.", "usd", "aed", "", "doge"], enums.currency) == [
        "INR", "INR", "USD", "AED", "INR", "INR"]
    assert values(spark, ["Paid", "on hold", "odd", ""],
                  lambda c: enums.status(c, "payment")) == [
        "CAPTURED", "AUTHORIZED", "ODD", None]
    assert values(spark, ["Net Banking", "credit card", "E-Wallet"],
                  lambda c: enums.enum(c, "payment_method")) == [
        "NETBANKING", "CREDIT CARD", "WALLET"]


@pytest.mark.parametrize("left,right", [("tide", "diet"), ("diet", "tide"), ("", ""), ("a", ""),
                                        ("UTIB0000123", "UTIB0000132")])
def test_similarity(spark, left, right):
    df = spark.createDataFrame([(left, right)], "a string, b string")
    got = df.select(similarity.similarity("a", "b")).first()[0]
    assert got == pytest.approx(SequenceMatcher(None, left, right).ratio())


def test_similarity_of_null_is_zero(spark):
    df = spark.createDataFrame([(None, "x")], "a string, b string")
    assert df.select(similarity.similarity("a", "b")).first()[0] == 0.0


def test_close_amounts(spark):
    df = spark.createDataFrame([(100.0, 100.5), (100.0, 103.0), (0.0, 0.0), (None, 1.0)],
                               "a double, b double")
    assert [r[0] for r in df.select(amounts.amounts_close("a", "b")).collect()] == [
        True, False, True, False]
