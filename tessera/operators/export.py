"""The logical tables of the workbook: listings, districts, groups by level, summary, and the parameters they depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import position_band, price_per_area, variation_percent
from .medians import exact_median

BAND = 0.10


def listings_table(df: DataFrame, reference: float | None = None, band: float = BAND, digits: int = 2) -> DataFrame:
    """Listings with price per area, deviation from the mean of all, band and deviation from the reference price."""
    rows = df.withColumn("per_m2", price_per_area(F.col("price"), F.col("area"), digits))
    mean = rows.agg(F.avg("per_m2")).scalar()
    return rows.withColumn("mean_all", mean).withColumns({"vs_mean": F.round(F.col("per_m2") / F.col("mean_all") - 1, 4), "position": position_band(F.col("per_m2"), F.col("mean_all"), band), "vs_reference": variation_percent(F.col("per_m2"), F.lit(reference).cast("double"), digits - 1)}).drop("mean_all")


def districts_table(df: DataFrame, reference: float | None = None, band: float = BAND, missing: str = "(no district)", digits: int = 2) -> DataFrame:
    """By district: count, mean price per area against the mean of all, band, mean area; highest mean first."""
    rows = df.withColumn("per_m2", price_per_area(F.col("price"), F.col("area"), digits))
    mean = rows.agg(F.avg("per_m2")).scalar()
    g = rows.groupBy(F.coalesce("district", F.lit(missing)).alias("district")).agg(F.count("*").alias("n"), F.avg("per_m2").alias("m"), F.round(F.avg("area"), 2).alias("mean_area"))
    return g.withColumn("all", mean).select("district", "n", F.round("m", 2).alias("mean"), F.round(F.col("m") / F.col("all") - 1, 4).alias("vs_mean"), position_band(F.col("m"), F.col("all"), band).alias("position"), variation_percent(F.col("m"), F.lit(reference).cast("double")).alias("vs_reference"), "mean_area").orderBy(F.desc("mean"), "district")


def groups_table(groups: DataFrame, level: str, overall_mean: float, band: float = BAND) -> DataFrame:
    """One level's groups with counts, frozen median, mean, band, area range, sources."""
    area = F.when(F.col("area_low") == F.col("area_high"), F.format_number("area_low", 0)).otherwise(F.concat_ws("–", F.format_number("area_low", 0), F.format_number("area_high", 0)))
    return groups.filter(F.col("level") == level).select("group_id", F.col("name_key").alias("name"), "n_listings", "n_probable", "n_units", "median", "mean", F.round(F.col("mean") / overall_mean - 1, 4).alias("vs_mean"), position_band(F.col("mean"), F.lit(overall_mean), band).alias("position"), area.alias("areas"), "sources").orderBy(F.desc("median"), "group_id")


def summary_table(df: DataFrame, reference: float | None = None, band: float = BAND, digits: int = 2) -> DataFrame:
    """One row: mean, median, least, greatest, count, and how many lie below and above the band."""
    rows = df.withColumn("per_m2", price_per_area(F.col("price"), F.col("area"), digits))
    mean = rows.agg(F.avg("per_m2")).scalar()
    share = F.col("per_m2") / F.col("all") - 1
    out = rows.withColumn("all", mean).agg(F.count("per_m2").alias("n"), F.round(F.avg("per_m2"), 2).alias("mean"), F.min("per_m2").alias("low"), F.max("per_m2").alias("high"), F.count_if(share < -band).alias("below"), F.count_if(share > band).alias("above"))
    median = exact_median(rows, [], "per_m2").agg(F.max("median")).scalar()
    out = out.select("n", "mean", F.round(median, digits).alias("median"), "low", "high", "below", "above")
    return out.withColumn("vs_reference", variation_percent(F.col("mean"), F.lit(reference).cast("double")))


def parameters_table(spark, reference: float | None = None, band: float = BAND) -> DataFrame:
    return spark.createDataFrame([("band", band), ("reference_price", reference)], "name string, value double")


def group_counts(groups: DataFrame) -> DataFrame:
    return groups.groupBy("level").agg(F.count("*").alias("groups"), F.sum("n_listings").alias("listings"))


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """Writes each table as Parquet under its name; Spark's own commit keeps half-written tables out."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
