"""Expressions on JSON, arrays and maps as sources deliver them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize


def json_strings(x: Column) -> Column:
    """A JSON array of texts; anything else is an empty array, entries that are no texts are left out."""
    got = F.from_json(x, "array<variant>")
    return F.coalesce(F.filter(F.transform(got, lambda v: F.try_variant_get(v, "$", "string")), lambda s: s.isNotNull()), F.array().cast("array<string>"))


def property_map(pairs: Column) -> Column:
    """A list of structs (name, value) as a map; the last of equal names wins, null names are left out."""
    kept = F.filter(pairs, lambda p: p["name"].isNotNull())
    last = F.filter(kept, lambda p, i: F.size(F.filter(kept, lambda q, j: (j > i) & (q["name"] == p["name"]))) == 0)
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["name"], p["value"])))


def first_present(variant: Column, *names: str) -> Column:
    """The first of several alternative fields that is there, as text."""
    return F.coalesce(*(F.try_variant_get(variant, f"$.{n}", "string") for n in names))


def amenities(text: Column) -> Column:
    """Amenity names of a JSON list of texts or of objects with value or name."""
    return F.filter(F.transform(F.from_json(text, "array<variant>"), lambda v: F.coalesce(F.try_variant_get(v, "$.value", "string"), F.try_variant_get(v, "$.name", "string"), F.try_variant_get(v, "$", "string"))), lambda s: s.isNotNull())


def photo_urls(text: Column, base: Column, most: int = 10) -> Column:
    """Photo addresses of a JSON text, object or list of either: absolute, once each, no logos, icons or unfilled templates."""
    listed = F.coalesce(F.from_json(text, "array<variant>"), F.array(F.try_parse_json(text)))
    raw = F.transform(listed, lambda v: F.coalesce(F.try_variant_get(v, "$.url", "string"), F.try_variant_get(v, "$.contentUrl", "string"), F.try_variant_get(v, "$.src", "string"), F.try_variant_get(v, "$", "string")))
    filled = F.transform(raw, lambda u: F.replace(F.replace(F.replace(F.trim(u), F.lit("{width}"), F.lit("870")), F.lit("{height}"), F.lit("653")), F.lit("{action}"), F.lit("fit-in")))
    absolute = F.transform(filled, lambda u: F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).when(F.startswith(u, F.lit("/")), F.concat(base, u)).otherwise(u))
    good = F.filter(absolute, lambda u: u.rlike("(?i)^https?://") & ~u.rlike(r"(?i)logo|icon|placeholder|\.svg|^data:|[{}]"))
    return F.slice(F.array_distinct(good), 1, most)


def json_blocks(html: Column, kind: str = "application/ld\\+json") -> Column:
    """The bodies of a page's scripts of a type."""
    return F.regexp_extract_all(html, F.lit(rf'(?is)<script[^>]*type=["\']{kind}["\'][^>]*>(.*?)</script>'), F.lit(1))


def graph_items(block: Column) -> Column:
    """A JSON-LD body as a list of objects; @graph and lists are flattened."""
    v = F.try_parse_json(block)
    as_list = lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x))
    inner = F.try_variant_get(v, '$["@graph"]', "array<variant>")
    return F.filter(F.coalesce(inner, as_list(v)), lambda x: x.isNotNull())


def streamed_text(html: Column) -> Column:
    """The text that a page pushes in chunks (self.__next_f.push([1,"..."])), unescaped and joined.

    A chunk ends at the first quote that no odd number of backslashes escapes. Chunks are cut by splitting: a pattern over all of a chunk's characters needs
    stack for each of them.
    """
    end = r'(?<=(?<!\\)(?:\\\\){0,20})"\s*\]\)'
    after = F.split(html, r'push\(\[1,\s*"')
    chunks = F.transform(F.slice(after, F.lit(2), F.size(after)), lambda x: F.when(x.rlike(end), F.concat(F.lit('"'), F.get(F.split(x, end, 2), F.lit(0)), F.lit('"'))))
    return F.array_join(F.transform(chunks, lambda c: F.try_variant_get(F.try_parse_json(c), "$", "string")), "")


def undefined_null(x: Column) -> Column:
    return F.when(~F.startswith(x, F.lit("$")), x)


def same_names(a: Column, b: Column) -> Column:
    """Normalized names that both lists have."""
    return F.array_intersect(F.transform(a, normalize), F.transform(b, normalize))
