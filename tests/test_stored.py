"""Stored tables are worked out once and lie in a file per core at least."""

from pyspark.sql import functions as F

from ledgerloom.plans.fixtures import Fixtures


def test_stored_table_runs_its_plan_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(n):
        seen.add(1)
        return n

    rows = spark.range(40).select(F.udf(count, "bigint")("id").alias("n"))
    table = Fixtures(spark, str(tmp_path)).stored("counted", lambda: rows.groupBy("n").agg(F.count(F.lit(1)).alias("c")))
    assert seen.value == 40
    assert sorted(tuple(r) for r in table.collect()) == [(n, 1) for n in range(40)]
    assert len(table.inputFiles()) >= spark.sparkContext.defaultParallelism
