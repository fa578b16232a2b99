"""Model quality from scored rows, computed by grouped counts only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.ordering import running

# Thresholds from 0.01 to 0.99 in equal steps.
GRID_START, GRID_STEP, GRID_SIZE = 0.01, 0.005, 197


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    f1 = _ratio(2 * tp, 2 * tp + fp + fn)
    f0 = _ratio(2 * tn, 2 * tn + fp + fn)
    return {
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn), "precision": precision,
        "recall": recall, "f1": f1, "macro_f1": (f1 + f0) / 2,
        "predicted_positive_rate": _ratio(tp + fp, tp + fp + tn + fn),
        "tp": tp, "fp": fp, "fn": fn, "tn": tn,
    }


def threshold_grid(scored: DataFrame) -> DataFrame:
    """Rates at every grid threshold; a row is positive when score >= threshold.

    Rows are counted by the highest threshold they reach, then the few hundred
    counts are summed downwards, so rows and thresholds are never crossed.
    """
    spot = F.floor((F.col("score") - GRID_START) / GRID_STEP + 1e-9).cast("int")
    place = F.greatest(F.lit(-1), F.least(F.lit(GRID_SIZE - 1), spot))
    counts = scored.groupBy(place.alias("place")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    spark = scored.sparkSession
    grid = spark.range(-1, GRID_SIZE).select(F.col("id").cast("int").alias("place"))
    full = grid.join(counts, "place", "left").fillna(0)
    reached = Window.orderBy(F.col("place").desc())
    whole = Window.partitionBy()
    summed = full.withColumns({
        "tp": F.sum("pos").over(reached), "fp": F.sum("neg").over(reached),
        "_p": F.sum("pos").over(whole), "_n": F.sum("neg").over(whole)})
    tp, fp = F.col("tp"), F.col("fp")
    rates = _rates(tp, fp, F.col("_p") - tp, F.col("_n") - fp)
    return summed.filter(F.col("place") >= 0).select(
        F.round(GRID_START + F.col("place") * GRID_STEP, 3).alias("threshold"),
        *[v.alias(k) for k, v in rates.items()])


def best_threshold(scored: DataFrame) -> DataFrame:
    """First threshold with the best macro F1."""
    return threshold_grid(scored).orderBy(F.col("macro_f1").desc(), "threshold").limit(1)


def _by_score(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Positives and negatives per distinct score, with those scoring higher."""
    groups = scored.groupBy(*keys, "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    return running(groups, keys, [F.col("score").desc()],
                   {"pos_upto": F.col("pos"), "neg_upto": F.col("neg")})


def ranking_quality(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Average precision and area under the ROC curve, ties counted half.

    Average precision sums precision over recall steps at distinct scores, which
    is not the interpolated area under the precision-recall curve.
    """
    keys = keys or []
    steps = _by_score(scored, keys)
    precision = F.col("pos_upto") / (F.col("pos_upto") + F.col("neg_upto"))
    above = F.col("pos_upto") - F.col("pos") / 2
    sums = steps.groupBy(*keys).agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"),
        F.sum(F.col("pos") * precision).alias("_ap"), F.sum(F.col("neg") * above).alias("_auc"))
    return sums.select(*keys, F.try_divide("_ap", "_p").alias("pr_auc"),
                       F.try_divide("_auc", F.col("_p") * F.col("_n")).alias("roc_auc"))


def binary_metrics(scored: DataFrame, threshold: float) -> DataFrame:
    """All binary measures at one threshold, in one row."""
    hit = F.col("score") >= threshold
    pos = F.col("label") == 1
    counts = scored.agg(
        F.count_if(hit & pos).alias("a"), F.count_if(hit & ~pos).alias("b"),
        F.count_if(~hit & pos).alias("c"), F.count_if(~hit & ~pos).alias("d"))
    rates = _rates(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    ranked = ranking_quality(scored).select(F.struct("pr_auc", "roc_auc")).scalar()
    flat = counts.select(*[v.alias(k) for k, v in rates.items()], ranked.alias("_r"))
    return flat.withColumns({
        "pr_auc": F.col("_r.pr_auc"), "roc_auc": F.col("_r.roc_auc"),
        "threshold": F.lit(threshold)}).drop("_r")


def compare_models(metrics: dict[str, DataFrame], order: list[str]) -> DataFrame:
    """One row per model, best first."""
    rows = reduce(DataFrame.unionByName, [m.withColumn("model", F.lit(n))
                                          for n, m in metrics.items()])
    return rows.orderBy(*[F.col(o).desc() for o in order], "model")


# --- several classes -----------------------------------------------------------------


def confusion(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("row_count"))


def confusion_matrix(df: DataFrame, classes: list[str], actual: str = "actual",
                     predicted: str = "predicted") -> DataFrame:
    return df.groupBy(actual).pivot(predicted, classes).agg(F.count(F.lit(1))).fillna(0)


def class_report(df: DataFrame, actual: str = "actual", predicted: str = "predicted"
                 ) -> DataFrame:
    """Precision, recall, F1, support and errors per class, from the confusion counts."""
    cells = confusion(df, actual, predicted)
    sides = F.array(
        F.struct(F.col(actual).alias("class"), F.col("row_count").alias("support"),
                 F.lit(0).cast("bigint").alias("claimed")),
        F.struct(F.col(predicted).alias("class"), F.lit(0).cast("bigint").alias("support"),
                 F.col("row_count").alias("claimed")))
    hit = F.when(F.col(actual) == F.col(predicted), F.col("row_count")).otherwise(0)
    long = cells.select(F.explode(sides).alias("s"), hit.alias("hit"))
    sums = long.groupBy("s.class").agg(
        F.sum("s.support").alias("support"), F.sum("s.claimed").alias("claimed"),
        (F.sum("hit") / 2).cast("bigint").alias("hits"))
    return sums.select(
        "class", "support", _ratio(F.col("hits"), F.col("claimed")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("support") + F.col("claimed")).alias("f1"),
        (F.col("support") - F.col("hits")).alias("errors"))


def multiclass_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted"
                       ) -> DataFrame:
    """Accuracy, balanced accuracy, macro rates and weighted F1."""
    r = class_report(df, actual, predicted)
    support = F.col("support")
    return r.agg(
        F.try_divide(F.sum(support - F.col("errors")), F.sum(support)).alias("accuracy"),
        F.avg(F.when(support > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        F.try_divide(F.sum(F.col("f1") * support), F.sum(support)).alias("weighted_f1"))


def one_vs_rest_auc(df: DataFrame, probabilities: str, actual: str = "actual") -> DataFrame:
    """Area under the ROC curve of every class against the rest; ``probabilities`` is a map."""
    long = df.select(F.col(actual).alias("_a"), F.explode(probabilities).alias("class", "score"))
    rows = long.select("class", "score", (F.col("class") == F.col("_a")).cast("int")
                       .alias("label"))
    return ranking_quality(rows, ["class"]).select("class", "roc_auc")


def confidence(df: DataFrame, probabilities: str) -> DataFrame:
    """Top and second probability and the gap between them."""
    ordered = F.sort_array(F.map_values(probabilities), asc=False)
    return df.withColumns({"top": ordered[0], "second": ordered[1],
                           "margin": ordered[0] - ordered[1]})


def described(df: DataFrame, groups: list[str], values: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of each of ``values`` per group.

    Quartiles are exact, linear between neighbours. Equal values are counted first; running
    counts over sampled ranges then find the places of the quartiles, so a group of any
    number of different values is as many ranges as it takes. Null and not-a-number are
    left out; a group with nothing else has a count of 0 and nulls.
    """
    entries = F.array(*[F.struct(F.lit(v).alias("name"), F.nanvl(
        F.col(v).cast("double"), F.lit(None)).alias("value")) for v in values])
    keys = [*[f"_g{i}" for i in range(len(groups))], "_name"]
    long = df.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], F.explode(entries).alias("_e")).select(
        *keys[:-1], F.col("_e.name").alias("_name"), F.col("_e.value").alias("_value"))
    counts = long.groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_n"))
    shape = long.groupBy(*keys).agg(
        F.count("_value").alias("row_count"), F.avg("_value").alias("mean"),
        F.stddev_samp("_value").alias("std"), F.min("_value").alias("min"), F.max("_value").alias("max"))
    placed = running(counts.filter(F.col("_value").isNotNull()), keys, ["_value"], {"_upto": F.col("_n")})
    both = placed.select(*[placed[k].alias(f"_p{k}") for k in keys], "_value", "_n", "_upto")
    same = reduce(lambda a, k: a & F.col(f"_p{k}").eqNullSafe(F.col(k)), keys, F.lit(True))
    quartiles = {"q1": 1, "median": 2, "q3": 3}
    ends = {}
    for name, q in quartiles.items():
        last = F.col("row_count") - 1
        for side, place in (("low", F.floor(last * q / 4)), ("high", F.ceil(last * q / 4))):
            ends[f"{name}_{side}"] = F.max(F.when(
                (place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_n")), F.col("_value")))
    facts = ["row_count", "mean", "std", "min", "max"]
    met = shape.join(both, same, "left").groupBy(*keys, *facts).agg(*[c.alias(n) for n, c in ends.items()])

    def between(name: str, q: int) -> Column:
        share = (F.col("row_count") - 1) * q / 4
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        return (low + (high - low) * (share - F.floor(share))).alias(name)

    return met.select(*[F.col(k).alias(g) for g, k in zip(groups, keys)], F.col("_name").alias("value_name"),
                      *facts[:4], *[between(n, q) for n, q in quartiles.items()], "max")


def least_confident(df: DataFrame, key: str, limit: int = 50) -> DataFrame:
    return df.orderBy("margin", key).limit(limit)


def feature_ranking(df: DataFrame, features: list[str], split: str = "split") -> DataFrame:
    """Per split and feature: AUC, distinct values, positives among non-zero rows."""
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(
        F.col(f).cast("double"), F.lit(0.0)).alias("score")) for f in features])
    long = df.select(split, "label", F.explode(entries).alias("e")).select(
        split, "label", "e.feature", "e.score")
    shape = long.groupBy(split, "feature", "score").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).groupBy(split, "feature").agg(
        F.count(F.lit(1)).alias("nunique"),
        F.try_divide(F.sum(F.when(F.col("score") != 0, F.col("p"))),
                     F.sum(F.when(F.col("score") != 0, F.col("n"))))
        .alias("positive_rate_when_set"))
    auc = ranking_quality(long, [split, "feature"]).select(split, "feature", "roc_auc")
    return shape.join(auc, [split, "feature"])


def single_flag_diagnostic(df: DataFrame, flag: str, label: str = "label") -> DataFrame:
    """How well one flag alone tells the label: shares per flag value, and overall accuracy."""
    cells = df.groupBy(flag).agg(
        F.count(F.lit(1)).alias("row_count"), F.avg(F.col(label).cast("double")).alias("share_1"))
    right = df.agg(F.avg((F.col(flag) == F.col(label)).cast("double"))).scalar()
    return cells.select(F.col(flag).cast("bigint").alias("flag"), "row_count",
                        (1 - F.col("share_1")).alias("share_0"), "share_1",
                        right.alias("accuracy"))


def missing_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), (F.col(c) * 100).alias("missing_percent"))
        for c in columns])).alias("x")).select("x.*")


def unknown_classes(df: DataFrame, column: str, expected: list[str]) -> DataFrame:
    """Labels outside the taxonomy, and taxonomy classes with no rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
    known = df.sparkSession.createDataFrame([(c,) for c in expected], "class string")
    both = known.join(counts, F.col("class") == F.col(column), "full")
    return both.select(
        F.coalesce("class", column).alias("class"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.when(F.col("class").isNull(), "UNKNOWN").when(F.col("row_count").isNull(), "EMPTY")
        .otherwise("OK").alias("state"))


def class_distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("row_count"))
