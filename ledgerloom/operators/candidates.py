"""Settlement candidates of bank records, and the exact rules over them.

Rules meet settlements by merchant and reference alone, so a decision reads only
the pairs it can be about and no limit can hide one. Candidate menus serve the
ranking of records that the rules leave open. A menu depends only on a record's
merchant and date, so menus are built once per distinct (merchant, date); limits
on them are off unless asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import vocab
from ledgerloom.functions.amounts import amounts_equal
from ledgerloom.functions.dates import day_gap
from ledgerloom.functions.identifiers import match_key
from ledgerloom.functions.similarity import similarity
from ledgerloom.operators.matching import DECISION, decision, facts
from ledgerloom.operators.ordering import top_per_group
from ledgerloom.session import dealt

SETTLEMENT_COLUMNS = ["settlement_id", "settlement_date", "gross_amount", "net_amount",
                      "total_fees", "total_fee_tax", "total_refunds", "total_adjustments", "utr",
                      "payment_count"]
BANK_COLUMNS = ["bank_record_id", "merchant_id", "transaction_date", "value_date", "amount",
                "reference", "description", "transaction_type", "category"]


def days_around(wanted: DataFrame, days: DataFrame, window_days: int) -> DataFrame:
    """``wanted`` (``merchant_id``, ``center``) with the rows of ``days`` (``merchant_id``,
    ``day``) at most ``window_days`` away. Days are met by spans as long as the window, so a
    date looks into two of them at most, not into each day around it."""
    def span(day: Column) -> Column:
        return F.floor(F.unix_date(day) / (2 * window_days + 1))

    looked = F.sequence(span(F.date_sub("center", window_days)),
                        span(F.date_add("center", window_days)))
    asked = wanted.filter(F.col("center").isNotNull()).withColumn("_span", F.explode(looked))
    held = days.withColumn("_span", span(F.col("day")))
    return asked.join(dealt(held), ["merchant_id", "_span"]).filter(
        F.abs(F.datediff("day", "center")) <= window_days).drop("_span")


def candidate_menus(bank: DataFrame, settlements: DataFrame, window_days: int = vocab.WINDOW_DAYS,
                    window_limit: int | None = None, merchant_limit: int | None = None
                    ) -> DataFrame:
    """Settlements on the menu of every (merchant, date) that some bank record has.

    The menu holds the merchant's settlements within the window; when there are
    none, or the date is unknown, all of the merchant's. ``window_limit`` and
    ``merchant_limit`` keep the first ones by date, for callers who want that.
    """
    held = settlements.select("merchant_id", F.struct(*SETTLEMENT_COLUMNS).alias("s"),
                              F.to_date("settlement_date").alias("day"))
    order = [F.col("s.settlement_date").asc_nulls_last(), F.col("s.settlement_id")]
    dated = held.filter(F.col("day").isNotNull())
    wanted = bank.select("merchant_id", F.col("transaction_date").alias("center")).distinct()

    daily = dated.groupBy("merchant_id", "day").agg(F.count(F.lit(1)).alias("n"))
    open_days = days_around(wanted, daily, window_days)
    inside = dated
    if window_limit is not None:
        earlier = Window.partitionBy("merchant_id", "center").orderBy("day").rowsBetween(
            Window.unboundedPreceding, -1)
        open_days = (
            open_days.withColumn("take", F.lit(window_limit)
                                 - F.coalesce(F.sum("n").over(earlier), F.lit(0)))
            .filter(F.col("take") > 0)
        )
        # Nothing past the limit within one day can be on any menu.
        of_day = Window.partitionBy("merchant_id", "day").orderBy(*order)
        inside = dated.withColumn("place", F.row_number().over(of_day)).filter(
            F.col("place") <= window_limit)
    near = open_days.join(dealt(inside), ["merchant_id", "day"])
    if window_limit is not None:
        near = near.filter(F.col("place") <= F.col("take"))
    near = near.select("merchant_id", "center", "s")

    served = open_days.select("merchant_id", "center").distinct()
    unserved = wanted.join(
        dealt(served.withColumnsRenamed({"merchant_id": "_m", "center": "_c"})),
        (F.col("merchant_id") == F.col("_m")) & (F.col("center") == F.col("_c")), "left_anti")
    firsts = held.drop("day")
    if merchant_limit is not None:
        firsts = top_per_group(firsts, ["merchant_id"], order, merchant_limit)
    far = unserved.join(dealt(firsts), "merchant_id").select("merchant_id", "center", "s")
    return near.unionByName(far)


def pair_with_menus(bank: DataFrame, menus: DataFrame) -> DataFrame:
    """Every bank record with each settlement on its menu; no menu leaves one row of nulls."""
    kept = [c for c in BANK_COLUMNS if c in bank.columns]
    menu = menus.withColumnsRenamed({"merchant_id": "_m", "center": "_c"})
    same = (F.col("merchant_id") == F.col("_m")) & F.col("transaction_date").eqNullSafe(
        F.col("_c"))
    return bank.join(dealt(menu), same, "left").select(*kept, "s.*").withColumn(
        "date_difference", day_gap("transaction_date", F.to_date("settlement_date")))


def _reference_equal() -> Column:
    key = match_key("reference")
    return (key != "") & (key == match_key("utr"))


def reference_pairs(bank: DataFrame, settlements: DataFrame,
                    window_days: int = vocab.WINDOW_DAYS) -> DataFrame:
    """Every bank record with the settlements of its menu that share its reference, or with
    nulls. The same pairs as on unlimited menus, without building the menus."""
    kept = [c for c in BANK_COLUMNS if c in bank.columns]
    held = settlements.select(F.col("merchant_id").alias("_m"), match_key("utr").alias("_key"),
                              *SETTLEMENT_COLUMNS).filter(F.col("_key") != "")
    # Whether any settlement lies in the window, from the days that have one.
    days = settlements.select("merchant_id", F.to_date("settlement_date").alias("day")).filter(
        F.col("day").isNotNull()).distinct()
    wanted = bank.select("merchant_id", F.col("transaction_date").alias("center")).distinct()
    served = days_around(wanted, days, window_days).select(
        F.col("merchant_id").alias("_m2"), F.col("center").alias("_center")).distinct().withColumn(
        "_served", F.lit(True))
    mine = bank.select(*kept, match_key("reference").alias("_ref_key")).join(
        dealt(served), (F.col("merchant_id") == F.col("_m2"))
        & (F.col("transaction_date") == F.col("_center")), "left").drop("_m2", "_center")
    met = mine.join(dealt(held), (F.col("merchant_id") == F.col("_m"))
                    & (F.col("_ref_key") == F.col("_key")), "left")
    gap = day_gap("transaction_date", F.to_date("settlement_date"))
    on_menu = F.col("_served").isNull() | (gap <= window_days)
    shown = [F.when(on_menu, F.col(c)).alias(c) for c in SETTLEMENT_COLUMNS]
    return met.select(*kept, *shown, F.when(on_menu, gap).alias("date_difference"))


def resolve(pairs: DataFrame) -> DataFrame:
    """One decision per bank record: a unique exact match wins, then a unique reference match."""
    both = amounts_equal("amount", "net_amount") & _reference_equal()
    only = _reference_equal() & ~amounts_equal("amount", "net_amount")
    judged = pairs.withColumns({"_both": both, "_only": only})
    hit = F.struct("settlement_id", "net_amount", "utr", "date_difference")
    first = F.col("settlement_id")
    summary = judged.groupBy("bank_record_id").agg(
        F.first("amount").alias("amount"), F.first("reference").alias("reference"),
        F.count_if("_both").alias("_n_both"), F.count_if("_only").alias("_n_only"),
        F.min_by(hit, F.when(F.col("_both"), first)).alias("_hit_both"),
        F.min_by(hit, F.when(F.col("_only"), first)).alias("_hit_only"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("_both"), first))), ",")
        .alias("_both_ids"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("_only"), first))), ",")
        .alias("_only_ids"),
    )
    return _decide(summary)


def _decide(summary: DataFrame) -> DataFrame:
    n_both, n_only = F.col("_n_both"), F.col("_n_only")
    exact, several = n_both == 1, n_both > 1
    loose = (n_both == 0) & (n_only == 1)
    loose_several = (n_both == 0) & (n_only > 1)
    hit = F.when(exact, F.col("_hit_both")).when(loose, F.col("_hit_only"))
    rule = (F.when(exact, "EXACT_AMOUNT_AND_UTR").when(several, "AMBIGUOUS_EXACT_MATCHES")
            .when(loose, "EXACT_UTR_AMOUNT_MISMATCH").when(loose_several, "AMBIGUOUS_UTR")
            .otherwise("NO_DETERMINISTIC_SETTLEMENT_BANK_MATCH"))
    reason = (
        F.when(exact, "Bank amount equals settlement net amount and normalized references match.")
        .when(several, "Multiple settlements share exact amount and UTR.")
        .when(loose, "UTR matches uniquely but amounts differ.")
        .when(loose_several, "Multiple settlements share the same UTR with amount mismatches.")
        .otherwise("No settlement satisfied exact amount+UTR rules."))
    codes = (
        F.when(exact, F.array(F.lit("EXACT_AMOUNT"), F.lit("EXACT_UTR")))
        .when(several, F.array(F.lit("AMBIGUOUS_DETERMINISTIC")))
        .when(loose, F.array(F.lit("EXACT_UTR"), F.lit("AMOUNT_DISCREPANCY")))
        .when(loose_several, F.array(F.lit("AMBIGUOUS_UTR")))
        .otherwise(F.array(F.lit("UNRESOLVED"))))
    known = (
        F.when(several, facts(candidate_ids=F.col("_both_ids")))
        .when(loose_several, facts(candidate_ids=F.col("_only_ids")))
        .otherwise(facts(bank_amount=F.col("amount").cast("double"),
                         settlement_net_amount=hit["net_amount"].cast("double"),
                         bank_reference=F.col("reference"), settlement_utr=hit["utr"])))
    return summary.select(*decision(
        vocab.SETTLEMENT_BANK,
        F.when(exact, vocab.MATCHED).when(loose, vocab.DISCREPANCY).otherwise(vocab.UNMATCHED),
        rule, reason, hit["settlement_id"], F.col("bank_record_id"),
        F.col("amount") - hit["net_amount"], hit["date_difference"], codes, known,
        exact | loose,
    ))


def resolve_by_reference(bank: DataFrame, settlements: DataFrame) -> DataFrame:
    """The same decision over all settlements of the merchant, with no window or limit.

    Settlements are counted per (merchant, reference) and per (merchant,
    reference, amount) first, so a bank record meets one row of each, whatever
    the number of settlements that share a reference. An ambiguous decision names
    all of them, which is the answer asked for.
    """
    keyed = settlements.select(
        F.col("merchant_id").alias("_m"), match_key("utr").alias("_key"), "settlement_id",
        "net_amount", "utr", F.to_date("settlement_date").alias("_day"),
    ).filter(F.col("_key") != "")
    least = F.min(F.struct("settlement_id", "net_amount", "utr", "_day"))
    every = F.array_join(F.sort_array(F.collect_list("settlement_id")), ",")
    by_ref = keyed.groupBy("_m", "_key").agg(F.count(F.lit(1)).alias("_n_ref"),
                                             least.alias("_ref"), every.alias("_ref_ids"))
    by_both = keyed.groupBy("_m", "_key", "net_amount").agg(
        F.count(F.lit(1)).alias("_n_eq"), least.alias("_eq"), every.alias("_eq_ids")).select(
        F.col("_m").alias("_m2"), F.col("_key").alias("_key2"),
        F.col("net_amount").alias("_net2"), "_n_eq", "_eq", "_eq_ids")
    mine = bank.withColumn("_ref_key", match_key("reference"))
    joined = (
        mine.join(by_ref, (F.col("merchant_id") == F.col("_m"))
                  & (F.col("_ref_key") == F.col("_key")), "left")
        .join(by_both, (F.col("merchant_id") == F.col("_m2"))
              & (F.col("_ref_key") == F.col("_key2")) & (F.col("amount") == F.col("_net2")),
              "left")
    )

    def hit(name: str) -> Column:
        return F.struct(F.col(f"{name}.settlement_id"), F.col(f"{name}.net_amount"),
                        F.col(f"{name}.utr"),
                        day_gap("transaction_date", F.col(f"{name}._day")).alias(
                            "date_difference"))

    both = F.coalesce("_n_eq", F.lit(0))
    summary = joined.select(
        "bank_record_id", "amount", "reference", both.alias("_n_both"),
        (F.coalesce("_n_ref", F.lit(0)) - both).alias("_n_only"),
        hit("_eq").alias("_hit_both"), hit("_ref").alias("_hit_only"),
        F.col("_eq_ids").alias("_both_ids"), F.col("_ref_ids").alias("_only_ids"))
    return _decide(summary)


def resolve_within_and_beyond(bank: DataFrame, settlements: DataFrame) -> DataFrame:
    """Decisions within the window; a record without a reference match there is looked up over
    all settlements."""
    inside = resolve(reference_pairs(bank, settlements))
    found = inside.filter(F.col("rule") != "NO_DETERMINISTIC_SETTLEMENT_BANK_MATCH")
    open_ids = inside.filter(F.col("rule") == "NO_DETERMINISTIC_SETTLEMENT_BANK_MATCH").select(
        F.col("source_record_id").alias("bank_record_id"))
    rest = bank.join(open_ids, "bank_record_id", "left_semi")
    return found.unionByName(resolve_by_reference(rest, settlements)).select(*DECISION)


def rank_candidates(pairs: DataFrame, window_days: int = vocab.WINDOW_DAYS,
                    limit: int | None = vocab.CANDIDATE_LIMIT) -> DataFrame:
    """Closest candidates per bank record by amount, reference and date: the top ``limit``
    of the ranking, or all for None.

    Pairs outside the window are dropped unless a date is unknown.
    """
    near = pairs.filter(
        F.col("settlement_id").isNotNull()
        & (F.col("date_difference").isNull() | (F.col("date_difference") <= window_days)))
    gap = F.abs(F.col("amount") - F.col("net_amount")).cast("double")
    scored = near.withColumn(
        "utr_similarity", similarity(match_key("reference"), match_key("utr"))
    ).withColumn(
        "closeness",
        F.coalesce(1 / (1 + gap), F.lit(0.0)) + F.col("utr_similarity")
        + F.coalesce(1 / (1 + F.col("date_difference")), F.lit(0.0)))
    if limit is None:
        return scored
    return top_per_group(scored, ["bank_record_id"], [
        F.col("closeness").desc(), F.col("settlement_date").asc_nulls_last(),
        F.col("settlement_id")], limit)
