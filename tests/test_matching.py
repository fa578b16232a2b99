"""Rules, candidates and decisions on hand-made records and against brute force."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom import vocab
from ledgerloom.operators import candidates, cases, features, matching, ordering

BANK = ("bank_record_id string, merchant_id string, transaction_date date, value_date date, "
        "amount decimal(15,2), reference string, description string, transaction_type string, "
        "category string")
STL = ("settlement_id string, merchant_id string, settlement_date timestamp, "
       "gross_amount decimal(15,2), net_amount decimal(15,2), total_fees decimal(15,2), "
       "total_fee_tax decimal(15,2), total_refunds decimal(15,2), "
       "total_adjustments decimal(15,2), utr string, payment_count int")
DAY = dt.date(2026, 8, 19)


def bank(i, amount="100.00", ref="UTIB123", mer="MER_1", day=DAY):
    return (i, mer, day, day, Decimal(amount), ref, "settlement", "CREDIT", "SETTLEMENT")


def stl(i, net="100.00", utr="UTIB123", mer="MER_1", day=DAY):
    d = Decimal
    when = day and dt.datetime(day.year, day.month, day.day, 9)
    return (i, mer, when, d("110.00"), d(net), d("8"), d("1"), d("0"), d("0"), utr, 2)


def decide(spark, banks, settlements):
    b, s = spark.createDataFrame(banks, BANK), spark.createDataFrame(settlements, STL)
    pairs = candidates.pair_with_menus(b, candidates.candidate_menus(b, s))
    key = lambda r: r.source_record_id
    by_menu = sorted(candidates.resolve(pairs).collect(), key=key)
    by_key = sorted(candidates.resolve(candidates.reference_pairs(b, s)).collect(), key=key)
    assert by_menu == by_key
    return {r.source_record_id: r for r in by_key}


def test_exact_reference_only_and_none(spark):
    got = decide(spark, [bank("B1"), bank("B2", "95.00", "utib-124"), bank("B3", ref="AAAA")],
                 [stl("S1"), stl("S2", utr="UTIB124")])
    assert (got["B1"].status, got["B1"].rule) == (vocab.MATCHED, "EXACT_AMOUNT_AND_UTR")
    assert got["B2"].status == vocab.DISCREPANCY and got["B2"].amount_difference == -5.0
    assert got["B3"].status == vocab.UNMATCHED and not got["B3"].resolved


def test_ambiguous_matches_stay_unresolved(spark):
    got = decide(spark, [bank("B1"), bank("B2", "1.00", "R2")],
                 [stl("S1"), stl("S2"), stl("S3", utr="R2"), stl("S4", utr="R2")])
    assert got["B1"].rule == "AMBIGUOUS_EXACT_MATCHES"
    assert got["B1"].explanation_facts["candidate_ids"] == "S1,S2"
    assert got["B2"].rule == "AMBIGUOUS_UTR"


def test_reference_beyond_window_is_found(spark):
    far = DAY + dt.timedelta(days=60)
    b = spark.createDataFrame([bank("B1", ref="FAR")], BANK)
    s = spark.createDataFrame([stl("S1", utr="NEAR"), stl("S2", utr="FAR", day=far)], STL)
    pairs = candidates.pair_with_menus(b, candidates.candidate_menus(b, s))
    assert candidates.resolve(pairs).first().status == vocab.UNMATCHED
    assert candidates.resolve_within_and_beyond(b, s).first().matched_record_id == "S2"


def test_many_settlements_of_a_day_hide_no_match(spark):
    far = DAY + dt.timedelta(days=90)
    stls = [stl(f"S{i:03}", utr="UTIB123" if i in (5, 69) else f"R{i}") for i in range(70)]
    stls += [stl(f"F{i:03}", utr="FAR", day=far, mer="MER_2") for i in range(3)] + [stl("N", mer="MER_2", utr="X")]
    got = decide(spark, [bank("B1")], stls)
    assert got["B1"].rule == "AMBIGUOUS_EXACT_MATCHES"
    assert got["B1"].explanation_facts["candidate_ids"] == "S005,S069"
    b, s = spark.createDataFrame([bank("B2", ref="FAR", mer="MER_2")], BANK), spark.createDataFrame(stls, STL)
    beyond = candidates.resolve_within_and_beyond(b, s).first()
    assert beyond.rule == "AMBIGUOUS_EXACT_MATCHES"
    assert beyond.explanation_facts["candidate_ids"] == "F000,F001,F002"


def test_menus_equal_brute_force_under_skew(spark):
    rng = random.Random(7)

    def when():
        return DAY + dt.timedelta(days=rng.randrange(120))

    # One merchant holds most rows, so its windows overflow the limit.
    banks = [bank(f"B{i:03}", mer="MER_1" if i % 3 else f"MER_{i % 5}",
                  day=None if i % 17 == 0 else when()) for i in range(80)]
    stls = [stl(f"S{i:03}", mer="MER_1" if i % 4 else f"MER_{i % 6}",
                day=None if i % 23 == 0 else when()) for i in range(300)]
    b, s = spark.createDataFrame(banks, BANK), spark.createDataFrame(stls, STL)
    menus = candidates.candidate_menus(b, s, window_limit=7, merchant_limit=9)
    got = {}
    for r in candidates.pair_with_menus(b, menus).collect():
        got.setdefault(r.bank_record_id, set()).add(r.settlement_id)
    for record in banks:
        own = [x for x in stls if x[1] == record[1]]
        own.sort(key=lambda x: (x[2] is None, x[2] or dt.datetime.max, x[0]))
        near = [x[0] for x in own if record[2] and x[2]
                and abs((x[2].date() - record[2]).days) <= 25][:7]
        want = set(near or [x[0] for x in own][:9]) or {None}
        assert got[record[0]] == want


def test_context_ranks_and_gaps(spark):
    b = spark.createDataFrame([bank("B1", ref="NEAR")], BANK)
    s = spark.createDataFrame([stl("S_TOP", utr="NEAR"), stl("S_LOW", "80.00", "XXXX")], STL)
    pairs = candidates.pair_with_menus(b, candidates.candidate_menus(b, s))
    rows = {r.target_id: r for r in features.add_context(features.pair_features(pairs)).collect()}
    top = rows["S_TOP"]
    assert (top.is_best_amount_candidate, top.is_best_reference_candidate) == (1, 1)
    assert top.best_vs_second_best_amount_gap == 20.0 and top.candidate_count == 2
    assert rows["S_LOW"].candidate_rank_by_amount == 2


def test_contract_columns(spark):
    b = spark.createDataFrame([bank("B1")], BANK)
    s = spark.createDataFrame([stl("S1", day=None)], STL)
    pairs = candidates.pair_with_menus(b, candidates.candidate_menus(b, s))
    full = features.align(features.add_context(features.pair_features(pairs)),
                          ["bank_record_id"])
    assert full.columns[1:] == vocab.MATCH_FEATURES and len(vocab.MATCH_FEATURES) == 35
    assert len(vocab.EXCEPTION_FEATURES) == 19
    row = full.first()
    assert (row.same_day, row.within_7_days, row.date_difference_days) == (0, 0, None)


@pytest.mark.parametrize("scores,status,matched,margin", [
    ((0.91, 0.20), vocab.ML_MATCHED, "S0", 0.71), ((0.40, 0.38), vocab.AMBIGUOUS, "S0", 0.02),
    ((0.10, 0.05), vocab.UNMATCHED, None, 0.05), ((0.9,), vocab.ML_MATCHED, "S0", None)])
def test_score_decision(spark, scores, status, matched, margin):
    rows = [("B1", f"S{i}", s, 1.0, 1, 0, 0.5, 1, i) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "bank_record_id string, target_id string, score double, "
                               "absolute_amount_difference double, date_difference_days int, "
                               "reference_exact_match int, utr_similarity double, "
                               "candidate_rank_by_amount int, closeness_rank int")
    got = cases.decide_by_score(df).first()
    assert (got.status, got.matched_record_id) == (status, matched)
    assert got.confidence_margin == (None if margin is None else pytest.approx(margin))


def test_cases_without_model_say_so(spark):
    b = spark.createDataFrame([bank("B1"), bank("B2", ref="ZZ", amount="7.00")], BANK)
    s = spark.createDataFrame([stl("S1")], STL)
    got = {r.source_record_id: r for r in cases.reconcile_bank(b, s).collect()}
    assert got["B1"].status == vocab.MATCHED
    assert got["B2"].reason_codes[0] == "ML_UNAVAILABLE"
    assert list(got["B1"].asDict()) == cases.CASE


def test_either_key_counts_an_entry_once(spark):
    rows = [("A", "A", 5), ("A-", "A", 7), ("B", None, 1), (None, "B", 2)]
    df = spark.createDataFrame(rows, "k string, other string, v int")
    got = {r._id: r.total for r in matching.totals_by_either_key(
        df, "k", "other", F.sum("v").alias("total")).collect()}
    assert got == {"A": 12, "A-": 7, "B": 3}


def test_worst_decision_takes_first_of_equals(spark):
    def row(stage, status, code):
        return ("P", status, "R", "why", f"M{stage}", "S1", 1.0, 1, [code], {}, True,
                (stage, f"M{stage}"))

    schema = ("pair_type string, status string, rule string, reason string, "
              "matched_record_id string, source_record_id string, amount_difference double, "
              "date_difference int, reason_codes array<string>, "
              "explanation_facts map<string,string>, resolved boolean, "
              "_seq struct<stage:int,id:string>")
    df = spark.createDataFrame([row(0, vocab.MATCHED, "A"), row(1, vocab.UNMATCHED, "B"),
                                row(2, vocab.AMBIGUOUS, "A"), row(3, vocab.DISCREPANCY, "C")],
                               schema)
    got = matching.worst_per_source(df).first()
    assert got.matched_record_id == "M1" and got.all_codes == ["A", "B", "C"]


def test_positions_and_running_sums_match_one_window(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.6 else rng.choice("abc"), rng.randrange(40),
             rng.randrange(100)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, k string, t int, v int")
    placed = ordering.position(df, ["k"], [F.col("t"), F.col("id")])
    got = ordering.running_sum(placed, ["k"], [F.col("t"), F.col("id")], F.col("v")).collect()
    for key in {r[1] for r in rows}:
        place = total = 0
        have = {r.id: (r.position, r.running) for r in got if r.k == key}
        for r in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])):
            place, total = place + 1, total + r[3]
            assert have[r[0]] == (place, total)
