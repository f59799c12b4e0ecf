"""Validation with a reason for every discard, filters, funnels, and keeping the first of equal rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Rules
from ..functions.text import normalize, tokens, url_before_query

# Patterns of the rules. (?iu) as letters beyond ASCII count.
RENTAL = r"(?iu)\b(alugar|aluguel|alugo|loca[çc][ãa]o|rent|rental|to let|for rent)\b"
AREA_RANGE = r"(?iu)\b\d+\s*(?:-|–|a|to)\s*\d+\s*m[²2]"
ONLY_MONEY = r"(?iu)^\s*(?:R\$|US\$|\$|€)?\s*\d[\d.,]*\s*$"


def reject_reason(request: dict | None = None, rules: Rules = Rules()) -> Column:
    """The first rule that a listing breaks, or null.

    request: rooms (exact; none or 0: any), baths (exact up to 3, 4 means 4 or more), price_min, price_max (both with slack). Columns: title, url, descr,
    price, area, price_m2, rooms, baths.
    """
    r = request or {}
    price, area = F.col("price").try_cast("double"), F.col("area").try_cast("double")
    per = F.coalesce(F.nullif(F.col("price_m2").try_cast("double"), F.lit(0.0)), F.try_divide(price, area))
    text = F.concat_ws(" ", F.col("title"), F.regexp_replace("url", "[-_/]", " "))
    chain = (
        F.when(text.rlike(RENTAL), "rental")
        .when(price.isNull() | (price <= 0), "no_price")
        .when(price < rules.price_least, "not_a_total_price")
        .when(F.coalesce(F.col("title").rlike(AREA_RANGE), F.lit(False)) | F.coalesce(F.substring("descr", 1, rules.description_head).rlike(AREA_RANGE), F.lit(False)), "area_range")
        .when(F.col("title").rlike(ONLY_MONEY), "bad_title")
        .when(area.isNull() | (area <= 0), "no_area")
        .when(~area.between(rules.area_least, rules.area_most), "implausible_area")
        .when(~per.between(rules.price_m2_least, rules.price_m2_most), "implausible_price_m2")
    )
    if r.get("rooms"):
        chain = chain.when(F.col("rooms").try_cast("int") != r["rooms"], "other_rooms")
    if r.get("baths"):
        have = F.col("baths").try_cast("int")
        chain = chain.when(have < 4 if r["baths"] >= 4 else have != r["baths"], "other_baths")
    if r.get("price_min") is not None:
        chain = chain.when(price < r["price_min"] * (1 - rules.price_slack), "outside_price_range")
    if r.get("price_max") is not None:
        chain = chain.when(price > r["price_max"] * (1 + rules.price_slack), "outside_price_range")
    return chain


def with_reason(df: DataFrame, request: dict | None = None, rules: Rules = Rules()) -> DataFrame:
    return df.withColumn("reject_reason", reject_reason(request, rules))


def funnel(checked: DataFrame) -> DataFrame:
    """reason and n of discarded rows, in one pass."""
    return checked.filter("reject_reason IS NOT NULL").groupBy(F.col("reject_reason").alias("reason")).agg(F.count("*").alias("n"))


def combined_funnel(*parts: DataFrame) -> DataFrame:
    """Counts of several stages, added up by reason."""
    first, *rest = parts
    for p in rest:
        first = first.unionByName(p)
    return first.groupBy("reason").agg(F.sum("n").alias("n"))


def funnel_kinds(counts: DataFrame) -> DataFrame:
    """Discards by duplicates and by rules."""
    return counts.groupBy(F.when(F.col("reason").like("duplicate%"), "duplicates").otherwise("rules").alias("kind")).agg(F.sum("n").alias("n"))


def of_type(df: DataFrame, wanted: str, null_as: str | None = None) -> DataFrame:
    """Rows of a building type; rows that don't say fail unless null_as names what they count as."""
    have = F.coalesce("building_type", F.lit(null_as)) if null_as else F.col("building_type")
    return df.filter(have == wanted)


def in_districts(names: list[str], column: str = "district") -> Column:
    """Whether one of the names is part of the normalized district."""
    wanted = F.array(*[normalize(F.lit(n)) for n in names])
    return F.coalesce(F.exists(wanted, lambda n: F.contains(normalize(F.col(column)), n)), F.lit(False))


# District names that say there is no district, and origins of a coordinate that name a place.
NO_DISTRICT = r"(?iu)\b(zona rural|[áa]rea rural|demais bairros|outros|sem bairro)\b"
TRUSTED_ORIGINS = ("exact", "source_approximate")


def residual(low: float | None = None, high: float | None = None, rooms: int | None = None) -> Column:
    """What a source should have filtered itself: the price within the request, and the rooms, where the listing says how many."""
    price = F.col("price").try_cast("double")
    kept = F.lit(True)
    if low is not None:
        kept &= F.coalesce(price >= low, F.lit(False))
    if high is not None:
        kept &= F.coalesce(price <= high, F.lit(False))
    return kept & F.coalesce(F.col("rooms").try_cast("int") == rooms, F.lit(True)) if rooms else kept


def trusted_districts(df: DataFrame, order: str = "idx") -> DataFrame:
    """city, key and name of districts that located listings name: the spelling seen first of each normal form, no residual names."""
    located = df.filter(F.col("coord_origin").isin(*TRUSTED_ORIGINS) & (F.trim("district") != "") & ~F.col("district").rlike(NO_DISTRICT))
    return located.groupBy("city", normalize(F.col("district")).alias("key")).agg(F.min_by(F.trim("district"), order).alias("name"))


def said_in(df: DataFrame, words: str, columns: tuple[str, ...] = ("title", "descr")) -> DataFrame:
    """Rows whose texts hold all words, in whatever order, case and accents."""
    have = tokens(F.concat_ws(" ", *columns))
    return df.filter(F.forall(tokens(F.lit(words)), lambda w: F.array_contains(have, w)))


def keep_first(df: DataFrame, key: Column, order: str = "idx") -> DataFrame:
    """The first row of each key in the given order; rows whose key is null or empty all stay."""
    keyed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.nullif(key, F.lit("")).alias("key"), F.col(order).alias("at"))
    # An aggregate, so rows of one key combine before the shuffle; rows without key do not meet at all.
    first = keyed.filter("key IS NOT NULL").groupBy("key").agg(F.min_by("row", "at").alias("row")).select("row")
    return first.unionByName(keyed.filter("key IS NULL").select("row")).select("row.*")


def first_by_url(df: DataFrame) -> DataFrame:
    return keep_first(df, url_before_query(F.col("url")))


def completeness(columns: list[str]) -> Column:
    """How many of the columns are there and not blank."""
    return sum((F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), 1).otherwise(0) for c in columns), F.lit(0))


def fullness() -> Column:
    """A listing's weight: 3 for photos, 2 for an exact place, 1 for each of builder, address, rooms, baths and parking."""
    photos = F.size(F.coalesce("photos", F.array().cast("array<string>"))) > 0
    place = F.col("lat").isNotNull() & F.col("lng").isNotNull() & (F.coalesce("coord_origin", F.lit("exact")) == "exact")
    return F.when(photos, 3).otherwise(0) + F.when(place, 2).otherwise(0) + completeness(["builder", "address", "rooms", "baths", "parking"])


def photo_means(df: DataFrame) -> DataFrame:
    """By source: rows, rows with photos and their mean number of photos."""
    n = F.size(F.coalesce("photos", F.array().cast("array<string>")))
    return df.groupBy("source").agg(F.count("*").alias("n"), F.count_if(n > 0).alias("with_photo"), F.round(F.avg(F.when(n > 0, n)), 2).alias("mean_photos"))


def survival(raw: DataFrame, checked: DataFrame, refined: DataFrame, most: int = 10) -> DataFrame:
    """stage, name and n: how many rows each stage left (raw, valid, refined) and the districts with most refined rows."""
    n = lambda df, stage: df.agg(F.count("*").alias("n")).select(F.lit(stage).alias("stage"), F.lit(None).cast("string").alias("name"), "n")
    top = refined.groupBy(F.col("district").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(most)
    counts = n(raw, "raw").unionByName(n(checked.filter("reject_reason IS NULL"), "valid")).unionByName(n(refined, "refined"))
    return counts.unionByName(top.select(F.lit("district").alias("stage"), "name", "n"))


def most_common(df: DataFrame, column: str, most: int) -> DataFrame:
    """The most frequent values of a column and how often they occur."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(most)


def source_status(sources: DataFrame, counts: DataFrame) -> DataFrame:
    """source, n and status (ok, zero, error) of all planned sources; counts: source, n, failed."""
    c = counts.groupBy("source").agg(F.sum("n").alias("n"), F.bool_or("failed").alias("failed"))
    n = F.coalesce("n", F.lit(0))
    return sources.join(c, "source", "left").select("source", n.alias("n"), F.when(n > 0, "ok").when(F.col("failed"), "error").otherwise("zero").alias("status"))


def coverage(df: DataFrame) -> DataFrame:
    """By source: rows, rows with coordinates, rows with and without photos."""
    photo = F.size(F.coalesce("photos", F.array().cast("array<string>"))) > 0
    return df.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lat").isNotNull() & F.col("lng").isNotNull()).alias("located"), F.count_if(photo).alias("with_photo"), F.count_if(~photo).alias("without_photo"))
