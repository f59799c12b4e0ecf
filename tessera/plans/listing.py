"""The bundled tables seen as listings and observations, so that every operator can be run and checked on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import price_per_area


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as listings. Column pruning leaves only the joins' columns that a query asks for."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    idx = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")
    source = F.col("l_suppkey") % 5
    return rows.select(
        idx.alias("idx"), F.concat(F.lit("https://s"), source, F.lit(".example/"), F.col("l_orderkey"), F.lit("/"), F.col("l_linenumber"), F.lit("?q=1")).alias("url"), F.concat(F.lit("s"), source).alias("source"), F.col("r_name").alias("city"),
        F.col("n_name").alias("district"), F.col("p_brand").alias("builder"), F.nullif(F.col("p_size") % 5, F.lit(0)).alias("rooms"), F.col("l_quantity").alias("area"), F.col("l_extendedprice").alias("price"), price_per_area(F.col("l_extendedprice"), F.col("l_quantity"), 8).alias("price_m2"),
        F.col("o_custkey").alias("search_id"), F.col("l_shipdate").alias("collected_at"), F.col("p_name").alias("title"), F.col("l_partkey").alias("part"), (F.lit(-3.70) - (F.col("l_partkey") % 200) / 2000).alias("lat"), (F.lit(-38.50) - (F.col("l_suppkey") % 50) / 1000).alias("lng"),
    )


LISTING_SQL = """
listing AS (SELECT (l_orderkey * 10 + l_linenumber) * 10000000000 + l_partkey * 10000 + l_suppkey AS idx, 'https://s' || (l_suppkey % 5) || '.example/' || l_orderkey || '/' || l_linenumber || '?q=1' AS url,
  's' || (l_suppkey % 5) AS source, r_name AS city, n_name AS district, p_brand AS builder, nullif(p_size % 5, 0) AS rooms, l_quantity AS area, l_extendedprice AS price,
  round(l_extendedprice / l_quantity, 8) AS price_m2, o_custkey AS search_id, l_shipdate AS collected_at, p_name AS title, l_partkey AS part,
  -3.70::DOUBLE - (l_partkey % 200) / 2000 AS lat, -38.50::DOUBLE - (l_suppkey % 50) / 1000 AS lng
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)
"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.col("user_id").alias("key"), F.col("event_type").alias("district"), F.col("value").alias("price_m2"), F.col("ts").alias("seen_at"))
