"""Summaries per group against numpy, over ties, nulls, hot and empty groups."""

import random

import numpy as np
import pytest

from ledgerloom.operators import evaluate


def test_quartiles_equal_numpy(spark):
    draw = random.Random(3)
    rows = [("hot", draw.choice([draw.gauss(0, 5), float(draw.randrange(4))])) for _ in range(3000)]
    rows += [(draw.choice(["a", "b", None]), float(draw.randrange(6))) for _ in range(90)]
    rows += [("one", 2.5), ("none", None), ("none", float("nan")), ("hot", None)]
    df = spark.createDataFrame(rows, "grp string, v double").selectExpr("grp", "v", "-v as w")
    got = {(r.grp, r.value_name): r for r in evaluate.described(df, ["grp"], ["v", "w"]).collect()}
    assert len(got) == 2 * len({g for g, _ in rows})
    for group in {g for g, _ in rows}:
        for name, sign in (("v", 1), ("w", -1)):
            values = [sign * v for g, v in rows if g == group and v is not None and v == v]
            r = got[group, name]
            assert r.row_count == len(values)
            if not values:
                assert (r["mean"], r["min"], r.q1, r["median"], r.q3, r["max"]) == (None,) * 6
                continue
            assert [r["min"], r.q1, r["median"], r.q3, r["max"]] == pytest.approx(
                np.percentile(values, [0, 25, 50, 75, 100]).tolist())
            assert r["mean"] == pytest.approx(np.mean(values))
            assert r["std"] == (pytest.approx(np.std(values, ddof=1)) if len(values) > 1 else None)
    assert evaluate.described(df.limit(0), ["grp"], ["v"]).collect() == []
