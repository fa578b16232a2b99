"""Positions and running totals over groups of any size.

A plain window over a hot key sorts the whole group in one task. Here rows are dealt by
ranges of (key, order), whose ends Spark draws from a sample, so a range is about as
long as any other however many rows one key, one day or one score has. Ranges are
written once; each is summed on its own, and the totals of a key's earlier ranges are
carried into its later ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import written

RANGE = "_range"


def ranged(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``df``, stored, with the number of the range each row stands in; ranges follow
    (key, order), so only the rows of one key that are equal in ``order`` cannot be split."""
    cut = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return written(cut.withColumn(RANGE, F.spark_partition_id()), "ranges")


def running(df: DataFrame, keys: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """Sum of each of ``sums`` over the rows of a key up to and including each row;
    ``order`` must be total."""
    values = {f"_value_{name}": value for name, value in sums.items()}
    cut = ranged(df.withColumns(values), keys, order)
    groups = [*keys, RANGE]
    totals = cut.groupBy(*groups).agg(*[F.sum(v).alias(v) for v in values])
    ranges = Window.partitionBy(*keys).orderBy(RANGE)
    earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)
    # Only keys that run on into another range have anything to carry: each range but
    # the first begins in the middle of one key at most, so there are fewer of these
    # rows than ranges.
    carried = totals.select(
        *[F.col(g).alias(f"_o_{g}") for g in groups], F.row_number().over(ranges).alias("_nth"),
        *[F.sum(v).over(earlier).alias(f"_before{v}") for v in values],
    ).filter(F.col("_nth") > 1).drop("_nth")
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    here = Window.partitionBy(*groups).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumns({v: F.sum(v).over(here) for v in values})
    return local.join(F.broadcast(carried), same, "left").select(*df.columns, *[
        (F.col(f"_value_{name}") + F.coalesce(F.col(f"_before_value_{name}"), F.lit(0)))
        .alias(name) for name in sums])


def position(df: DataFrame, keys: list[str], order: list, name: str = "position") -> DataFrame:
    """1-based place of each row in its group."""
    return running(df, keys, order, {name: F.lit(1).cast("bigint")})


def running_sum(df: DataFrame, keys: list[str], order: list, value: Column,
                name: str = "running") -> DataFrame:
    """Sum of ``value`` up to and including each row; ``order`` must be total."""
    return running(df, keys, order, {name: value})


def first_per_key(df: DataFrame, keys: list, order: Column) -> DataFrame:
    """One whole row per key, the least by ``order``.

    Aggregated rather than ranked: copies collapse before the shuffle, so a
    key with very many rows costs no more than any other.
    """
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.min_by(row, order).alias("_row")).select("_row.*")


def top_per_group(df: DataFrame, keys: list[str], order: list, limit: int) -> DataFrame:
    """First ``limit`` rows per group; Spark trims each map output to ``limit`` first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")
