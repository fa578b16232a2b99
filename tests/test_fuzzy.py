"""Each threshold of the fuzzy tier, at it and past it."""

from pyspark.sql import functions as F

from ledgerloom.operators import matching


def test_thresholds(spark):
    rows = [("past", 0.81, 0.71, 0.76, 0.049, 3), ("at", 0.8, 0.7, 0.75, 0.05, 4), ("none", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "k string, i double, t double, utr_similarity double, "
                                     "relative_amount_difference double, date_difference_days int")
    flags = ["fuzzy_id", "fuzzy_reference", "fuzzy_text", "fuzzy_amount", "fuzzy_days"]
    got = {r.k: ([r[f] for f in flags], r.fuzzy_passed)
           for r in matching.fuzzy_flags(df, F.col("t"), F.col("i")).collect()}
    assert got == {"past": ([1] * 5, 5), "at": ([0] * 5, 0), "none": ([0] * 5, 0)}
