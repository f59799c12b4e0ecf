"""Price statistics: overall, by district, by map pin; modes, bands, reference prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import position_band
from ..functions.text import has_accent, normalize
from .medians import exact_median, exact_summary, with_median


def kpis(df: DataFrame, value: str = "price_m2", digits: int = 2) -> DataFrame:
    """n, mean, median, low and high of a value, one row; zeros if there are no rows."""
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    s = exact_summary(df, [], value)
    return s.select("n", zero(F.round("mean", 2), "mean"), zero(F.round("median", digits), "median"), zero(F.col("low"), "low"), zero(F.col("high"), "high"))


def by_requested_district(df: DataFrame, requested: list[str], digits: int = 2) -> DataFrame:
    """Statistics of each requested name, in the order of the median, highest first; a listing counts under every name its district holds.

    No rows unless two names or more are requested; names without listings are left out.
    """
    spark = df.sparkSession
    names = spark.createDataFrame([(n,) for n in requested], "requested string")
    wanted = F.array(*[F.lit(n) for n in requested]) if requested else F.array().cast("array<string>")
    hit = F.filter(wanted, lambda n: F.contains(normalize(F.col("district")), normalize(n)))
    rows = df.withColumn("requested", F.explode(hit)).select("requested", "price_m2")
    n = rows.groupBy("requested").agg(F.count("*").alias("_all"))  # listings without a price count too
    out = n.join(exact_summary(rows, ["requested"], "price_m2"), "requested", "left").select("requested", F.col("_all").alias("n"), F.round("mean", 2).alias("mean"), F.round("median", digits).alias("median"), "low", "high")
    return (out if len(requested) > 1 else out.join(names.limit(0), "requested", "left_semi")).orderBy(F.desc("median"), "requested")


def first_seen_mode(df: DataFrame, keys: list[str], value: str, order: str = "idx") -> DataFrame:
    """keys and the most frequent value; of equally frequent ones that which was seen first."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("_n"), -F.col("_first"))).alias(value))


def display_spelling(df: DataFrame, column: str) -> DataFrame:
    """key (normal form) and its spelling: the most frequent, then one that is not already normal, then the last in order."""
    norm = normalize(F.col(column))
    counted = df.filter(F.col(column).isNotNull()).groupBy(norm.alias("key"), F.col(column).alias("name")).agg(F.count("*").alias("n"))
    return counted.groupBy("key").agg(F.max_by("name", F.struct(F.col("n"), F.col("name") != F.col("key"), F.col("name"))).alias("spelling"), F.sum("n").alias("n"))


def preferred_spelling(df: DataFrame, column: str, order: str = "idx") -> DataFrame:
    """key and its spelling: one with accents before one without, then the first seen, then the least."""
    return df.filter(F.col(column).isNotNull()).groupBy(normalize(F.col(column)).alias("key")).agg(F.min_by(column, F.struct(~has_accent(F.col(column)), F.col(order), F.col(column))).alias("spelling"))


def outlier_band(df: DataFrame, keys: list[str], value: str = "price_m2", low: float = 0.5, high: float = 1.8, least: int = 3) -> DataFrame:
    """Adds group_median, group_n and outlier: outside low to high times the median of a group of `least` rows or more.

    Medians are a grouped table joined back, so that a group's rows need not meet in one task.
    """
    some = df.filter(F.col(value) > 0).select(*keys, value)
    g = with_median(some.groupBy(*keys).agg(F.count("*").alias("group_n")), exact_median(some, keys, value, "group_median"), keys, "group_median").select(*keys, "group_median", "group_n")
    joined = df.join(g, [df[k].eqNullSafe(g[k]) for k in keys], "left").drop(*(g[k] for k in keys))
    out = (F.col("group_n") >= least) & ~F.col(value).between(F.col("group_median") * low, F.col("group_median") * high)
    return joined.withColumn("outlier", F.coalesce(out, F.lit(False)))


def map_pins(df: DataFrame, digits: int = 2) -> DataFrame:
    """Rows at one place (5 decimals): count, median price per area, and whether any of them is only estimated."""
    return df.filter("lat IS NOT NULL AND lng IS NOT NULL").groupBy(F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng")).agg(F.count("*").alias("n"), F.round(F.median("price_m2"), digits).alias("median"), F.bool_or(F.coalesce(F.col("coord_origin") != "exact", F.lit(True))).alias("estimated"))


def pin_counts(pins: DataFrame) -> DataFrame:
    return pins.agg(F.count_if(~F.col("estimated")).alias("exact_pins"), F.count_if("estimated").alias("estimated_pins"))


def district_centroids(df: DataFrame, least: int = 2) -> DataFrame:
    """key (normal form of the district), lat, lng: mean of the located rows, at least two. Estimated places never count."""
    real = df.filter("lat IS NOT NULL AND lng IS NOT NULL AND district IS NOT NULL AND coalesce(coord_origin, 'exact') <> 'district_centroid'")
    return real.groupBy(normalize(F.col("district")).alias("key")).agg(F.avg("lat").alias("c_lat"), F.avg("lng").alias("c_lng"), F.count("*").alias("c_n")).filter(F.col("c_n") >= least)


def fill_centroids(df: DataFrame) -> DataFrame:
    """Rows without place get their district's centroid and say so; doing it again changes nothing."""
    c = district_centroids(df)
    missing = (F.col("lat").isNull() | F.col("lng").isNull()) & F.col("c_n").isNotNull()
    joined = df.join(c, normalize(F.col("district")) == c.key, "left")
    return joined.withColumns({"lat": F.when(missing, F.col("c_lat")).otherwise(F.col("lat")), "lng": F.when(missing, F.col("c_lng")).otherwise(F.col("lng")), "coord_origin": F.when(missing, "district_centroid").otherwise(F.col("coord_origin"))}).drop("key", "c_lat", "c_lng", "c_n")


def latest_reference(prices: DataFrame) -> DataFrame:
    """Of each city and number of rooms the reference price set last."""
    return prices.groupBy(normalize(F.col("city")).alias("city_key"), "rooms").agg(F.max_by("price_m2", "updated_at").alias("reference"), F.max("updated_at").alias("updated_at"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both tables' rows, of each key the last by `order`; of ties the new one."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    whole = F.struct(*(F.col(c) for c in both.columns if c not in ("_new",)))
    return both.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.max_by(whole, F.struct(order, "_new")).alias("r")).select("r.*")


def with_position(df: DataFrame, value: str = "price_m2", band: float = 0.10) -> DataFrame:
    """Adds each row's band around the mean of all rows (a scalar subquery)."""
    return df.withColumn("all_mean", df.agg(F.avg(value)).scalar()).withColumn("position", position_band(F.col(value), F.col("all_mean"), band))


def success_rate(keys: DataFrame, attempts: DataFrame, key: str) -> DataFrame:
    """Of each key the share of attempts that had results; 0.5 where nothing was tried."""
    rate = attempts.groupBy(key).agg(F.avg(F.col("ok").cast("double")).alias("rate"), F.count("*").alias("tries"))
    return keys.join(rate, key, "left").select(key, F.coalesce("rate", F.lit(0.5)).alias("rate"), F.coalesce("tries", F.lit(0)).alias("tries"))


def any_true(x: Column) -> Column:
    """Three-valued or: true if any is, else false if any is, else null."""
    return F.bool_or(x)


def share_of_largest(df: DataFrame, value: str, n: str, weak: int = 15) -> DataFrame:
    """Adds each row's share of the largest value and whether its sample is weak."""
    return df.withColumns({"share": F.col(value) / df.agg(F.max(value)).scalar(), "weak": F.col(n) < weak})


def extremes(df: DataFrame, value: str = "price_m2", label: str = "title") -> DataFrame:
    """The rows with the least and the greatest value."""
    return df.agg(F.min_by(label, F.struct(value, label)).alias("low_row"), F.min(value).alias("low"), F.max_by(label, F.struct(value, label)).alias("high_row"), F.max(value).alias("high"))


def numbered_labels(df: DataFrame, label: str, order: str) -> DataFrame:
    """Equal labels as 'name', 'name (2)', 'name (3)' in the given order."""
    k = F.row_number().over(Window.partitionBy(label).orderBy(order))
    return df.withColumn("label", F.when(k == 1, F.col(label)).otherwise(F.concat(F.col(label), F.lit(" ("), k.cast("string"), F.lit(")"))))
