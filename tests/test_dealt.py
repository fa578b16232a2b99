"""Joins whose sides grow with the input deal both out; none is copied through the driver."""

import datetime as dt
import re

from pyspark.sql import functions as F

from ledgerloom.operators import candidates, cases, features, retrieval
from ledgerloom.session import written

DAY = dt.date(2024, 1, 1)
AMOUNT = "cast(%s as decimal(15,2))"


def stored(spark, rows, schema):
    """Files, whose size Spark knows: these are small enough to be copied."""
    return written(spark.createDataFrame(rows, schema), "dealt")


def bank(spark, n=40):
    rows = [(f"B{i}", f"M{i % 4}", DAY + dt.timedelta(days=7 * i) if i % 9 else None, i) for i in range(n)]
    return stored(spark, rows, "bank_record_id string, merchant_id string, transaction_date date, i int").selectExpr(
        "bank_record_id", "merchant_id", "transaction_date", "transaction_date as value_date",
        AMOUNT % "i" + " as amount", "concat('REF', i) as reference", "'paid' as description",
        "'CREDIT' as transaction_type", "'SETTLEMENT' as category")


def settlements(spark, n=60):
    rows = [(f"S{i}", f"M{i % 5}", dt.datetime(2023, 12, 20) + dt.timedelta(days=6 * i), i) for i in range(n)]
    money = ["gross_amount", "net_amount", "total_fees", "total_fee_tax", "total_refunds", "total_adjustments"]
    return stored(spark, rows, "settlement_id string, merchant_id string, settlement_date timestamp, i int").selectExpr(
        "settlement_id", "merchant_id", "settlement_date", *[AMOUNT % "i" + f" as {m}" for m in money],
        "concat('REF', i) as utr", "1 as payment_count")


def copied(df):
    """Joins that Spark plans as copies of one side."""
    return re.findall("BroadcastHashJoin", df._jdf.queryExecution().executedPlan().toString())


def pairs(spark):
    b, s = bank(spark), settlements(spark)
    return candidates.pair_with_menus(b, candidates.candidate_menus(b, s))


def test_menus_copy_no_side(spark):  # F1
    assert not copied(pairs(spark))


def test_bank_cases_copy_no_side(spark):  # F2
    assert not copied(cases.reconcile_bank(bank(spark), settlements(spark), beyond_window=False))


def test_description_flags_copy_no_side(spark):  # F3
    assert not copied(pairs(spark).select("bank_record_id", features.id_in_description(pairs(spark)).alias("named")))


def test_pair_features_copy_no_side(spark):  # F6
    assert not copied(features.pair_features(pairs(spark).withColumn("utr_similarity", F.lit(0.0))))


def test_context_features_copy_no_side(spark):  # F13
    plain = features.pair_features(pairs(spark).withColumn("utr_similarity", F.lit(0.0)))
    assert not copied(features.add_context(plain))


def test_tokens_are_not_copied(spark):  # F4, F5
    words = stored(spark, [("alpha",), ("beta",)], "word string")
    tokens = stored(spark, [("alphabet", 2), ("betas", 1)], "token string, n long")
    found = retrieval.words_in_tokens(words, tokens)
    assert re.findall("SortMergeJoin", found._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(tuple, found.collect())) == [("alpha", "alphabet", 2), ("beta", "betas", 1)]


def test_menus_by_spans_equal_every_pair(spark):
    b, s = bank(spark).collect(), settlements(spark).collect()
    want = set()
    for x in b:
        mine = [y for y in s if y.merchant_id == x.merchant_id]
        near = [y for y in mine if x.transaction_date and abs(
            (y.settlement_date.date() - x.transaction_date).days) <= 25]
        want |= {(x.bank_record_id, y.settlement_id) for y in near or mine}
    got = pairs(spark).filter("settlement_id is not null").select("bank_record_id", "settlement_id").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
