"""Exact medians of groups of any size, in one plan: no task sorts or holds a group's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of a bucket's logarithm: values of one bucket differ by at most 0.05 %.
STEPS = 2048


def _bucket(v: Column) -> tuple[Column, Column]:
    """Two whole numbers that rise with the value: its sign (NaN last, as in sorting) and a step of its logarithm."""
    sign = F.when(F.isnan(v), 2).otherwise(F.signum(v)).cast("int")
    step = F.floor(F.least(F.log(F.abs(v)) * STEPS, F.lit(1e9)))
    return sign, F.when(F.abs(sign) == 1, sign * step).otherwise(0).cast("long")


def _counted(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """_by0 and so on, _v and _n: how often each group has each value."""
    rows = df.select(*(F.col(b).alias(f"_by{i}") for i, b in enumerate(by)), F.col(value).cast("double").alias("_v"))
    return rows.filter("_v IS NOT NULL").groupBy(*(f"_by{i}" for i in range(len(by))), "_v").agg(F.count("*").alias("_n"))


def exact_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n (values), mean, median, low and high of each group, from one count of its values; without `by` one row, nulls (n 0) if there are no values."""
    key = [f"_by{i}" for i in range(len(by))]
    v, n = F.col("_v"), F.col("_n")
    rest = _counted(df, by, value).groupBy(*key).agg(F.coalesce(F.sum(n), F.lit(0)).alias("n"), (F.sum(v * n) / F.sum(n)).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"))
    rest = rest.select(*(F.col(k).alias(b) for b, k in zip(by, key, strict=True)), "n", "mean", "low", "high")
    medians = exact_median(df, by, value)
    out = with_median(rest, medians, by) if by else rest.withColumn("median", medians.agg(F.max("median")).scalar())
    return out.select(*by, "n", "mean", "median", "low", "high")


def exact_median(df: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """by and the median of each group's values (of an even number the mean of the middle two), as F.median gives it; groups without values are left out.

    Equal values are counted before they are shuffled; counts by bucket (a few thousand a group) say in which bucket the middle lies, and only that
    bucket's values are ranked. F.median gathers all distinct values of a group in one task instead. Null keys are a group; without `by` there is
    one row.
    """
    key = [f"_by{i}" for i in range(len(by))]
    v, counted = F.col("_v"), _counted(df, by, value)
    sign, step = _bucket(v)
    placed = counted.withColumns({"_sign": sign, "_step": step})
    group, ordered = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("_sign", "_step")
    buckets = placed.groupBy(*key, "_sign", "_step").agg(F.sum("_n").alias("_n")).withColumns({"_all": F.sum("_n").over(group), "_upto": F.sum("_n").over(ordered)})
    low, high = F.expr("(_all - 1) div 2"), F.expr("_all div 2")  # places from 0
    middle = buckets.filter((F.col("_upto") > low) & (F.col("_upto") - F.col("_n") <= high)).select(*key, "_sign", "_step", "_all", (F.col("_upto") - F.col("_n")).alias("_before"))
    p, m = placed.alias("p"), middle.alias("m")
    same = (F.col("p._sign") == F.col("m._sign")) & (F.col("p._step") == F.col("m._step"))
    for k in key:
        same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"m.{k}"))
    inner = p.join(m, same).select("p.*", "m._all", "m._before")
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*key, "_sign", "_step").orderBy("_v"))
    inner = inner.withColumn("_upto", upto)
    holds = lambda place: (F.col("_upto") > place) & (F.col("_upto") - F.col("_n") <= place)
    both = inner.groupBy(*key).agg(F.max(F.when(holds(low), v)).alias("_low"), F.max(F.when(holds(high), v)).alias("_high"))
    return both.select(*(F.col(k).alias(b) for b, k in zip(by, key, strict=True)), (0.5 * F.col("_low") + 0.5 * F.col("_high")).alias(name))


def with_median(stats: DataFrame, medians: DataFrame, by: list[str], name: str = "median") -> DataFrame:
    """Statistics of groups with their medians; null keys meet."""
    s, m = stats.alias("s"), medians.alias("m")
    same = F.lit(True)
    for b in by:
        same = same & F.col(f"s.{b}").eqNullSafe(F.col(f"m.{b}"))
    return s.join(m, same, "left").select("s.*", f"m.{name}")
