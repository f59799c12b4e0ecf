"""Listings out of fetched pages (a table with page_id, url, html): JSON-LD, streamed payloads, embedded state, cards. Built-in JSON functions; HTML cards in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nested import first_present, graph_items, json_blocks, photo_urls, property_map, streamed_text, undefined_null
from ..functions.numbers import in_box
from ..functions.text import area_number, join_address, to_number, url_key
from ..shared import written

LISTING_TYPES = ("Apartment", "House", "SingleFamilyResidence", "Residence", "Product", "Accommodation", "RealEstateListing")


def _get(v: Column, *paths: str) -> Column:
    return F.coalesce(*(F.try_variant_get(v, p, "string") for p in paths))


def _item(v: Column, source: str) -> list[Column]:
    """A JSON-LD listing's columns."""
    price = to_number(_get(v, "$.offers.price", "$.offers.lowPrice", "$.price"))
    area = area_number(_get(v, "$.floorSize.value", "$.floorSize", "$.area"))
    return [
        F.lit(source).alias("source"), _get(v, "$.name").alias("title"), _get(v, "$.url", '$["@id"]', "$.offers.url").alias("url"), _get(v, "$.description").alias("descr"), price.alias("price"), area.alias("area"),
        F.round(F.try_divide(price, area), 2).alias("price_m2"), _get(v, "$.numberOfRooms", "$.numberOfBedrooms").try_cast("int").alias("rooms"), _get(v, "$.numberOfBathroomsTotal").try_cast("int").alias("baths"),
        _get(v, "$.address.addressLocality").alias("city"), _get(v, "$.address.neighborhood", "$.address.addressNeighborhood").alias("district"), join_address(_get(v, "$.address.streetAddress"), F.lit(None).cast("string")).alias("address"),
        _get(v, "$.address.postalCode").alias("zip"), _get(v, "$.geo.latitude").try_cast("double").alias("lat"), _get(v, "$.geo.longitude").try_cast("double").alias("lng"),
        photo_urls(F.to_json(F.try_variant_get(v, "$.image", "variant")), F.lit("")).alias("photos"),
    ]


def json_ld_listings(pages: DataFrame, source: str, types: tuple[str, ...] = LISTING_TYPES) -> DataFrame:
    """page_id and the listings of item lists (itemListElement, also below offers or mainEntity) and of single objects with a listing type."""
    v = pages.select("page_id", F.explode(json_blocks(F.col("html"))).alias("block")).select("page_id", F.explode(graph_items(F.col("block"))).alias("v"))
    lists = F.coalesce(*(F.try_variant_get("v", p, "array<variant>") for p in ("$.itemListElement", "$.offers.itemListElement", "$.mainEntity.itemListElement")))
    each = F.explode(F.coalesce(lists, F.array("v"))).alias("e")
    found = v.select("page_id", each).withColumn("e", F.coalesce(F.try_variant_get("e", "$.item", "variant"), F.col("e")))
    return found.filter(_get(F.col("e"), '$["@type"]').isin(*types)).select("page_id", *_item(F.col("e"), source))


@F.pandas_udf(T.StringType())
def largest_array_udf(texts: pd.Series) -> pd.Series:
    """The longest array that follows "ads": in a text; finding its end takes a JSON decoder."""
    import json

    decoder = json.JSONDecoder()

    def largest(text: str | None) -> str | None:
        best: list = []
        at = (text or "").find('"ads":')
        while at >= 0:
            try:
                found, _ = decoder.raw_decode(text, at + 6)
                best = found if isinstance(found, list) and len(found) > len(best) else best
            except ValueError:
                pass
            at = text.find('"ads":', at + 6)
        return json.dumps(best, ensure_ascii=False) if best else None

    return texts.map(largest)


def streamed_listings(pages: DataFrame, source: str) -> DataFrame:
    """Listings of the largest "ads" array in a page's streamed payload, each listId once per page; properties (name, value) give rooms, baths, area."""
    ads = pages.select("page_id", largest_array_udf(streamed_text(F.col("html"))).alias("j"))
    v = ads.select("page_id", F.posexplode(F.from_json("j", "array<variant>")).alias("pos", "v"))
    pair = lambda p: F.struct(_get(p, "$.name").alias("name"), _get(p, "$.value").alias("value"))
    props = property_map(F.transform(F.coalesce(F.try_variant_get("v", "$.properties", "array<variant>"), F.array().cast("array<variant>")), pair))
    p = lambda n: F.try_element_at(props, F.lit(n))
    rows = v.select(
        "page_id", "pos", _get(F.col("v"), "$.listId").alias("listing_id"), F.lit(source).alias("source"), _get(F.col("v"), "$.subject", "$.title").alias("title"), _get(F.col("v"), "$.url", "$.friendlyUrl").alias("url"),
        to_number(_get(F.col("v"), "$.priceValue", "$.price")).alias("price"), area_number(p("size")).alias("area"), p("rooms").try_cast("int").alias("rooms"), p("bathrooms").try_cast("int").alias("baths"), p("garage_spaces").try_cast("int").alias("parking"),
        _get(F.col("v"), "$.locationDetails.municipality").alias("city"), _get(F.col("v"), "$.locationDetails.neighbourhood").alias("district"),
    )
    return rows.groupBy("page_id", "listing_id").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("page_id", "listing_id")]), "pos").alias("r")).select("page_id", "listing_id", "r.*").drop("pos")


def state_listings(pages: DataFrame, source: str, state_id: str = "__NEXT_DATA__", houses: str = "$.props.pageProps.initialState.houses", visible: str = "$.props.pageProps.initialState.search.visible") -> DataFrame:
    """Listings of an embedded state: a map of houses by id, in the order of the list of visible ids.

    A page may hold very many houses: its map is taken apart once, and ids meet their houses by a join, not by a search of the map for each id.
    """
    body = F.regexp_extract("html", rf'(?is)<script[^>]*id=["\']{state_id}["\'][^>]*>(.*?)</script>', 1)
    v = pages.select(F.monotonically_increasing_id().alias("page"), "page_id", F.try_parse_json(body).alias("v"))
    v = written(v.select("page", "page_id", F.to_json(F.try_variant_get("v", houses, "variant")).alias("houses"), F.try_variant_get("v", visible, "array<string>").alias("visible")), "states")
    h = F.col("h")  # parsed each by itself: a value of the page's variant would carry the names of all fields of the page
    each = v.select("page", F.explode(F.from_json("houses", "map<string,variant>")).alias("listing_id", "h")).select("page", "listing_id", first_present(h, "title", "name").alias("title"), to_number(first_present(h, "salePrice", "price")).alias("price"), area_number(first_present(h, "area", "totalArea")).alias("area"), first_present(h, "bedrooms", "rooms").try_cast("int").alias("rooms"), first_present(h, "neighbourhood", "regionName").alias("district"))
    rows = v.select("page", "page_id", F.posexplode("visible").alias("pos", "listing_id"))
    # the tables' sizes say nothing of the rows in their texts, so neither side may be broadcast
    return rows.hint("merge").join(each, ["page", "listing_id"], "left").select("page_id", "pos", "listing_id", F.lit(source).alias("source"), "title", "price", "area", "rooms", "district")


def flexible_listings(documents: DataFrame, source: str, keys: tuple[str, ...] = ("results", "items", "listings", "data")) -> DataFrame:
    """Listings of JSON documents (id, json) whose list and fields go by several names: the first list found, the first field found."""
    v = documents.select("id", F.try_parse_json("json").alias("v"))
    found = F.coalesce(*(F.try_variant_get("v", f"$.{k}", "array<variant>") for k in keys), F.try_variant_get("v", "$", "array<variant>"))
    e = F.col("e")
    pair = lambda p: F.struct(first_present(p, "id", "name").alias("name"), first_present(p, "value_name", "value").alias("value"))
    attrs = property_map(F.transform(F.coalesce(F.try_variant_get(e, "$.attributes", "array<variant>"), F.array().cast("array<variant>")), pair))
    a = lambda *names: F.coalesce(*(F.try_element_at(attrs, F.lit(n)) for n in names))
    return v.select("id", F.explode(found).alias("e")).select(
        "id", F.lit(source).alias("source"), first_present(e, "title", "name", "titulo").alias("title"), first_present(e, "permalink", "url", "link").alias("url"), to_number(first_present(e, "price", "preco", "valor")).alias("price"),
        area_number(F.coalesce(first_present(e, "area", "areaUtil"), a("TOTAL_AREA", "COVERED_AREA"))).alias("area"), F.coalesce(first_present(e, "rooms", "quartos"), a("BEDROOMS")).try_cast("int").alias("rooms"), first_present(e, "district", "bairro", "neighborhood").alias("district"),
    )


def location_index(pages: DataFrame) -> DataFrame:
    """url key, street, number, district, coordinates and whether they are exact, from address objects in streamed payloads; the first of a key counts.

    An object must lie between its listing's address and the next one's, so nothing leaks from a neighbour.
    """
    text = pages.select("page_id", F.regexp_replace(streamed_text(F.col("html")), r"\\/", "/").alias("t"))
    parts = text.select("page_id", F.posexplode(F.split("t", r'(?="href":"http)')).alias("pos", "part"))
    field = lambda name: undefined_null(F.nullif(F.regexp_extract("part", rf'"{name}":"((?:[^"\\]|\\.)*)"', 1), F.lit("")))
    number = lambda name: F.nullif(F.regexp_extract("part", rf'"{name}":(-?\d+(?:\.\d+)?)', 1), F.lit("")).cast("double")
    rows = parts.select("page_id", "pos", url_key(field("href")).alias("key"), field("street").alias("street"), field("streetNumber").alias("number"), field("neighborhood").alias("district"), number("latitude").alias("lat"), number("longitude").alias("lng"), F.regexp_extract("part", r'"isApproximateLocation":(true|false)', 1).alias("approximate")).filter("key IS NOT NULL")
    inside = in_box(F.col("lat"), F.col("lng"))
    valid = F.col("number").rlike(r"\d") & ~F.col("number").rlike("^0+$")
    rows = rows.withColumns({"number": F.when(valid, F.col("number")), "lat": F.when(inside, F.col("lat")), "lng": F.when(inside, F.col("lng")), "coord_origin": F.when(inside, F.when(F.col("approximate") == "true", "source_approximate").otherwise("exact"))})
    columns = ["street", "number", "district", "lat", "lng", "coord_origin"]
    return rows.groupBy("key").agg(F.min_by(F.struct(*columns), F.struct("page_id", "pos")).alias("r")).select("key", "r.*")


def with_locations(listings: DataFrame, index: DataFrame) -> DataFrame:
    """Listings with what the index knows: district and place of the index win, an address only fills a gap."""
    i = index.select("key", *(F.col(c).alias(f"_{c}") for c in ("street", "number", "district", "lat", "lng", "coord_origin")))
    joined = listings.withColumn("_key", url_key(F.col("url"))).join(i, F.col("_key") == F.col("key"), "left")
    new = {"district": F.coalesce("_district", "district"), "lat": F.coalesce("_lat", "lat"), "lng": F.coalesce("_lng", "lng"), "address": F.coalesce("address", join_address(F.col("_street"), F.col("_number")))}
    if "coord_origin" in listings.columns:
        new["coord_origin"] = F.coalesce("_coord_origin", "coord_origin")
    else:
        new["coord_origin"] = F.col("_coord_origin")
    return joined.withColumns(new).drop("key", "_key", "_street", "_number", "_district", "_lat", "_lng", "_coord_origin")


class _Cards(HTMLParser):
    """Texts, links and images of elements whose class holds a mark."""

    def __init__(self, mark: str):
        super().__init__(convert_charrefs=True)
        self.mark, self.cards, self.depth = mark, [], 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.depth == 0 and self.mark in (a.get("class") or "").split():
            self.cards.append({"text": [], "url": None, "image": None})
            self.depth = 1
        elif self.depth and tag not in ("br", "img", "input", "meta", "link", "hr", "source"):
            self.depth += 1
        if self.depth:
            card = self.cards[-1]
            card["url"] = card["url"] or (a.get("href") if tag == "a" else None)
            if tag == "img" and not card["image"]:
                wide = (a.get("srcset") or a.get("data-srcset") or "").split(",")[-1].split()
                card["image"] = a.get("data-src") or (wide[0] if wide else None) or a.get("src")

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - 1)

    def handle_data(self, data):
        if self.depth:
            self.cards[-1]["text"].append(data)


def card_listings(pages: DataFrame, source: str, mark: str) -> DataFrame:
    """Listings of result cards (elements with the class `mark`): text, link and first image, then price, area and rooms out of the text."""

    def cards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page, html in zip(b.page_id, b.html, strict=True):
                p = _Cards(mark)
                p.feed(html or "")
                out += [(page, " ".join(" ".join(c["text"]).split()), c["url"], c["image"]) for c in p.cards]
            yield pd.DataFrame(out, columns=["page_id", "text", "url", "image"])

    rows = pages.select("page_id", "html").mapInPandas(cards, "page_id long, text string, url string, image string")
    price = to_number(F.regexp_extract("text", r"R\$\s*([\d.,]+)", 1))
    area = area_number(F.regexp_extract("text", r"(?iu)(\d[\d.,]*\s*m[²2])", 1))
    return rows.select("page_id", F.lit(source).alias("source"), F.col("text").alias("title"), "url", price.alias("price"), area.alias("area"), F.regexp_extract("text", r"(?iu)(\d+)\s*(?:quartos?|dorm|bedrooms?)", 1).try_cast("int").alias("rooms"), F.array_compact(F.array("image")).alias("photos"))


def first_non_empty(frames: list[DataFrame]) -> DataFrame:
    """Rows of the first frame that has any: a source's fallbacks, most specific first. Lazy: the choice is a scalar over priorities."""
    first, *rest = [f.withColumn("_p", F.lit(i)) for i, f in enumerate(frames)]
    for f in rest:
        first = first.unionByName(f, allowMissingColumns=True)
    return first.filter(F.col("_p") == first.agg(F.min("_p")).scalar()).drop("_p")


def of_municipality(df: DataFrame, name: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of a municipality (rows that don't say stay unless strict) and counts of the others."""
    from ..functions.text import normalize

    same = normalize(F.col("city")) == normalize(F.lit(name))
    keep = F.coalesce(same, F.lit(not strict))
    return df.filter(keep), df.filter(~keep).groupBy("city").agg(F.count("*").alias("n"))
