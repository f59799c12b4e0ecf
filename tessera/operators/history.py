"""Observations over time: latest by period, first and last sight, activity, series, snapshots, cache look-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import History
from ..functions.numbers import week_label
from ..functions.text import normalize, url_key


def latest_per_period(df: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """Of each week and key the observation seen last; of equal times the first in order. Adds column week. An aggregation, so hot keys combine early."""
    rows = df.withColumn("week", week_label(F.col(ts))).filter(F.col(ts).isNotNull())
    whole = F.struct(*(F.col(c) for c in rows.columns))
    return rows.groupBy(F.col("week").alias("_w"), F.col(key).alias("_k")).agg(F.max_by(whole, F.struct(F.col(ts), -F.col(order))).alias("r")).select("r.*")


def first_last_seen(df: DataFrame, key: str, ts: str, order: str, tags: str | None = None) -> DataFrame:
    """Of each key the latest row, first_seen, last_seen, sightings and (of a tag column) all tags seen."""
    whole = F.struct(*(F.col(c) for c in df.columns))
    more = [F.sort_array(F.collect_set(tags)).alias(f"{tags}_seen")] if tags else []
    return df.filter(F.col(ts).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max_by(whole, F.struct(F.col(ts), -F.col(order))).alias("r"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("sightings"), *more).select("r.*", "first_seen", "last_seen", "sightings", *([f"{tags}_seen"] if tags else []))


def with_activity(seen: DataFrame, group: list[str], h: History = History()) -> DataFrame:
    """Adds active: last seen at most so many days before the last sight of anything in the same source and district."""
    last = seen.groupBy(*group).agg(F.max("last_seen").alias("covered_until"))
    joined = seen.join(last, [seen[g].eqNullSafe(last[g]) for g in group], "left").drop(*(last[g] for g in group))
    return joined.withColumn("active", F.col("last_seen") >= F.col("covered_until") - F.make_dt_interval(days=F.lit(h.active_days)))


def last_n(df: DataFrame, key: str, ts: str, order: str, n: int = 200) -> DataFrame:
    """The last n rows of each key. Ranked windows with a limit are cut in each task before the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), F.asc(order)))).filter(F.col("rn") <= n)


def top_per_group(df: DataFrame, group: str, rank: list[Column], each: int = 4, overall: int = 12) -> DataFrame:
    """The first `each` rows of each group, then the first `overall` of these."""
    first = df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*rank))).filter(F.col("rn") <= each)
    return first.orderBy(*rank).limit(overall)


def weekly_series(df: DataFrame, value: str, group: list[str], h: History = History(), digits: int = 2) -> DataFrame:
    """By group and week: mean, median, n and whether there are too few for a firm figure. df: one row per key and week."""
    return df.groupBy(*group, "week").agg(F.round(F.avg(value), 2).alias("mean"), F.round(F.median(value), digits).alias("median"), F.count("*").alias("n")).withColumn("low_confidence", F.col("n") < h.firm)


def district_evolution(df: DataFrame, key: str, ts: str, district: str, value: str, order: str, names: list[str] | None = None, h: History = History(), digits: int = 2) -> DataFrame:
    """The weekly series of the districts with most distinct listings (or of the named ones), each with its volume and spelling."""
    rows = df.filter((F.col(value) > 0) & F.col(district).isNotNull()).withColumn("_d", normalize(F.col(district)))
    counted = rows.groupBy("_d", F.col(district).alias("name")).agg(F.count("*").alias("n"))
    spelling = counted.groupBy("_d").agg(F.max_by("name", F.struct(F.col("n"), F.col("name") != F.col("_d"), F.col("name"))).alias("district"))
    volume = rows.groupBy("_d").agg(F.countDistinct(key).alias("volume")).join(spelling, "_d")
    if names:
        volume = volume.filter(F.col("_d").isin([r[0] for r in df.sparkSession.createDataFrame([(n,) for n in names], "n string").select(normalize(F.col("n"))).collect()]))
    else:
        volume = volume.orderBy(F.desc("volume"), "district").limit(h.top_districts)
    series = weekly_series(latest_per_period(rows, key, ts, order), value, ["_d"], h, digits)
    return series.join(F.broadcast(volume), "_d").select("district", "volume", "week", "mean", "median", "n", "low_confidence")


def weekly_pivot(series: DataFrame, group: str, value: str, names: list[str]) -> DataFrame:
    """One row a week, one column a group; weeks without a group's value are null."""
    return series.groupBy("week").pivot(group, names).agg(F.first(value))


def firm_values(series: DataFrame, value: str = "mean") -> DataFrame:
    """Splits a series: firm (null where confidence is low) and the rest."""
    return series.withColumns({"firm": F.when(~F.col("low_confidence"), F.col(value)), "weak": F.when(F.col("low_confidence"), F.col(value))})


def snapshot_diff(now: DataFrame, before: DataFrame, key: str, value: str, source: str, order: str, h: History = History()) -> DataFrame:
    """One row: new, dropped, raised, gone. A listing is gone only if its source delivered anything now; small changes don't count.

    Of rows with one key in a snapshot the last in order counts.
    """
    one = lambda df, tag: df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max_by(F.struct(F.col(value).alias("v"), F.col(source).alias("s")), order).alias(tag))
    answered = now.select(F.col(source).alias("answered")).distinct()
    both = one(now, "a").join(one(before, "b"), "k", "full").join(answered, F.col("b.s") == F.col("answered"), "left")
    change = (F.col("a.v") - F.col("b.v")) / F.nullif(F.col("b.v"), F.lit(0.0)) * 100
    return both.agg(
        F.count_if(F.col("b").isNull()).alias("new"), F.count_if(change < -h.change_percent).alias("dropped"), F.count_if(change > h.change_percent).alias("raised"), F.count_if(F.col("a").isNull() & F.col("answered").isNotNull()).alias("gone")
    )


def merge_collected(history: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """History and newly collected rows by key: new values win, first_seen stays the earlier."""
    h, f = history.alias("h"), fresh.alias("f")
    columns = [c for c in history.columns if c not in (key, "first_seen")]
    return h.join(f, F.col(f"h.{key}") == F.col(f"f.{key}"), "full").select(F.coalesce(f"h.{key}", f"f.{key}").alias(key), *(F.coalesce(f"f.{c}", f"h.{c}").alias(c) for c in columns), F.least("h.first_seen", "f.first_seen").alias("first_seen"))


def same_request(columns: list[str], left: str = "a", right: str = "b") -> Column:
    """Null-safe equality of all columns of a request."""
    return reduce(lambda x, y: x & y, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns))


def previous_same(df: DataFrame, request: list[str], ts: str, order: str, k: int = 1) -> DataFrame:
    """Adds the id of the k-th earlier search with the same request."""
    w = Window.partitionBy(*request).orderBy(ts, order)
    return df.withColumns({"previous_id": F.lag(order, k).over(w), "previous_at": F.lag(ts, k).over(w)})


def cache_hits(df: DataFrame, request: list[str], ts: str, order: str, h: History = History()) -> DataFrame:
    """Adds hit: the same request was made at most so many minutes earlier, and by which row it would be answered."""
    before = previous_same(df, request, ts, order)
    fresh = F.col("previous_at") >= F.col(ts) - F.make_dt_interval(mins=F.lit(h.cache_minutes))
    return before.withColumns({"hit": F.coalesce(fresh, F.lit(False)), "answer_id": F.when(fresh, F.col("previous_id"))})


def unexpired(cache: DataFrame, kind: str, now: Column) -> DataFrame:
    """Entries of a kind that are still valid, the latest of each key."""
    live = cache.filter((F.col("kind") == kind) & (F.col("expires_at") > now))
    return live.groupBy("key").agg(F.max_by("payload", "read_at").alias("payload"), F.max("read_at").alias("read_at"))


def history_rows(observations: DataFrame, searches: DataFrame, spellings: DataFrame, rooms: int | None = None) -> DataFrame:
    """Observations of searches in any spelling of a city (spellings: one column, city), priced, of a number of rooms if one is given."""
    rows = observations.filter("price_m2 > 0").join(searches.join(spellings, "city", "left_semi").select(F.col("search_id"), F.col("created_at")), "search_id")
    rows = rows.withColumns({"key": url_key(F.col("url")), "seen_at": F.coalesce("collected_at", "created_at")})
    return rows.filter(F.col("rooms") == rooms) if rooms else rows
