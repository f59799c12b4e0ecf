"""Numeric, geographic and calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def price_per_area(price: Column, area: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(price, area), digits)


def variation_percent(value: Column, reference: Column, digits: int = 1) -> Column:
    """How far a value lies above a reference, in per cent; null without a reference."""
    return F.round((value - reference) / F.nullif(reference, F.lit(0.0)) * 100, digits)


def relative_gap(a: Column, b: Column) -> Column:
    """Difference as a share of the pair's mean; null if the mean is 0."""
    return F.abs(a - b) / F.nullif((a + b) / 2, F.lit(0.0))


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    p, q = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.sin(p) * F.sin(p) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(q) * F.sin(q)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def cell(x: Column, per_degree: int = 1000) -> Column:
    return F.floor(x * per_degree)


def in_box(lat: Column, lng: Column, south: float = -34.0, north: float = 6.0, west: float = -74.5, east: float = -28.5) -> Column:
    return lat.between(south, north) & lng.between(west, east)


def tile_exists(z: Column, x: Column, y: Column, deepest: int = 20) -> Column:
    """Whether a map tile's coordinates lie on the map."""
    side = F.pow(F.lit(2.0), z)
    return z.between(0, deepest) & (x >= 0) & (x < side) & (y >= 0) & (y < side)


def host_allowed(url: Column, hosts: tuple[str, ...]) -> Column:
    """https, no user, no port but 443, and the host is a listed one or below it."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https://([^/?#@:]+)(?::443)?(?:[/?#]|$)", 1))
    listed = F.exists(F.array(*[F.lit(h) for h in hosts]), lambda h: (host == h) | F.endswith(host, F.concat(F.lit("."), h)))
    return F.coalesce((host != "") & ~host.rlike(r"^[\d.]+$") & listed, F.lit(False))


def position_band(value: Column, mean: Column, band: float = 0.10) -> Column:
    """▼ below, ▲ above, ● within the band around a mean."""
    return F.when(value / mean - 1 < -band, "▼").when(value / mean - 1 > band, "▲").otherwise("●")


def deviation_band(percent: Column) -> Column:
    """Five bands of a deviation in per cent: below -8, -8 to -2, to +2, to +8, above."""
    return F.when(percent < -8, "well below").when(percent < -2, "below").when(percent <= 2, "at").when(percent <= 8, "above").when(percent > 8, "well above")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def imputation_penalty(score: Column, imputed: Column, each: float = 0.05, most: float = 0.20) -> Column:
    return score * (1 - F.least(F.lit(most), each * F.size(imputed)))


def week_label(ts: Column) -> Column:
    """Year and week, weeks from Monday, week 0 before the first Monday."""
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7).cast("string"), 2, "0"))


def week_bounds(label: Column) -> Column:
    """struct(first, last): the days of a labelled week, cut at the year's ends."""
    new_year = F.make_date(F.substring(label, 1, 4).cast("int"), F.lit(1), F.lit(1))
    first_monday = F.date_add(new_year, F.pmod(F.lit(7) - F.weekday(new_year), F.lit(7)))
    start = F.date_add(first_monday, (F.substring(label, 7, 2).cast("int") - 1) * 7)
    end = F.make_date(F.substring(label, 1, 4).cast("int"), F.lit(12), F.lit(31))
    return F.struct(F.greatest(start, new_year).alias("first"), F.least(F.date_add(start, 6), end).alias("last"))


def event_time(collected: Column, created: Column) -> Column:
    return F.coalesce(collected, created)


def older_than(ts: Column, now: Column, minutes: int) -> Column:
    return ts < now - F.make_dt_interval(mins=F.lit(minutes))
