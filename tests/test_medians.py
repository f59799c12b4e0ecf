"""Exact medians against the built-in one and against sorting."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from statistics import median

import pytest
from pyspark.sql import functions as F

from tessera.operators.medians import exact_median, exact_summary


@pytest.mark.parametrize("seed", range(3))
def test_medians_are_those_of_sorting(spark, seed):
    rng = random.Random(seed)
    draw = [lambda: rng.choice([5.0, 5.0, 7.5]), lambda: rng.uniform(-3, 3), lambda: rng.choice([-1, 1]) * math.exp(rng.uniform(-700, 700)), lambda: 7000 + rng.random() * 1e-6, lambda: float(rng.randint(-2, 2)), lambda: rng.choice([0.0, -0.0, 1e-320])]
    rows = [(k if k != "n" else None, rng.randint(0, 1), draw[i]()) for i, k in enumerate(["a", "b", "c", "d", "n", "z"]) for _ in range(rng.choice([1, 2, 37, 200]))]
    rows += [("a", 0, None), ("empty", 1, None), ("inf", 0, math.inf), ("inf", 0, 3.0), ("inf", 0, -math.inf)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, j int, x double")
    want = defaultdict(list)
    for k, j, x in rows:
        if x is not None:
            want[k, j].append(x)
    got = {(r.k, r.j): r.median for r in exact_median(df, ["k", "j"], "x").collect()}
    assert got == pytest.approx({k: median(v) for k, v in want.items()}, rel=1e-15)
    for r in exact_summary(df.filter("abs(x) < 1e100 OR x IS NULL"), ["k", "j"], "x").collect():
        have = [x for x in want[r.k, r.j] if abs(x) < 1e100]
        assert (r.n, r.median, r.low, r.high) == (len(have), median(have), min(have), max(have)) and r["mean"] == pytest.approx(sum(have) / len(have), abs=1e-9 * max(map(abs, have)))
    whole = exact_median(df, [], "x").collect()
    assert len(whole) == 1 and whole[0].median == df.agg(F.median("x")).first()[0]


def test_one_value_that_most_rows_share_and_no_values(spark):
    df = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).otherwise(50.0).alias("x"), F.lit("g").alias("g"))
    assert exact_median(df, ["g"], "x", "m").collect() == [("g", df.agg(F.median("x")).first()[0])]
    assert exact_median(df.limit(0), ["g"], "x").count() == 0 and exact_median(df.select(F.lit(None).cast("double").alias("x")), [], "x").first().median is None


def test_no_task_gathers_the_values(spark):
    plan = exact_median(spark.range(10).select(F.col("id").cast("double").alias("x")), [], "x")._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect" not in plan
