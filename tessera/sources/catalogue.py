"""Official catalogues of builders: links of listing pages, canonical identities of detail pages (never a price), and the cached look-up of a building."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nested import graph_items, json_blocks
from ..functions.text import GENERIC, city_and_region, name_key, name_similarity, normalize, slug, tokens
from ..operators.lookup import compatible_catalogue_name
from ..shared import written
from .details import meta_content, street_in_text, unescaped, visible_text
from .tables import CACHE, Store


@dataclass(frozen=True)
class Provider:
    """A builder's catalogue: where its listing of a city is, and, if known, the address of a building's page ({state} is the region's name)."""

    name: str
    builder: str
    domain: str
    listing: str
    detail: str | None = None


# The builders' public catalogues, the names of regions in their addresses, and how many days listings and details are good.
PROVIDERS = (
    Provider("mrv", "MRV", "https://www.mrv.com.br", "https://www.mrv.com.br/imoveis/{region}/{city}", "https://www.mrv.com.br/imoveis/{state}/{city}/apartamentos-{name}"),
    Provider("direcional", "Direcional", "https://www.direcional.com.br", "https://www.direcional.com.br/empreendimentos/?cidade={city}"),
    Provider("tenda", "Tenda", "https://tenda.com", "https://tenda.com/apartamentos-a-venda/{region}/{city}"),
    Provider("cury", "Cury", "https://cury.net", "https://cury.net/imoveis?cidade={city}"),
)
STATES = {
    "CE": "ceara", "SP": "sao-paulo", "RJ": "rio-de-janeiro", "MG": "minas-gerais", "GO": "goias", "BA": "bahia",
    "PE": "pernambuco", "PR": "parana", "SC": "santa-catarina", "RS": "rio-grande-do-sul", "ES": "espirito-santo", "DF": "distrito-federal",
}
LISTING_DAYS, DETAIL_DAYS = 7, 30
REFERENCE = "name string, aliases array<string>, builder string, address string, district string, city string, source string, url string, provenance map<string,string>"


def absolute(url: Column, base: Column) -> Column:
    """An address of a page on a site (base: scheme and host), resolved; dot segments stay."""
    return (
        F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), url).when(F.startswith(url, F.lit("//")), F.concat(F.substring_index(base, "//", 1), url))
        .when(url.rlike(r"^(?:[/#?]|$)"), F.concat(base, url)).otherwise(F.concat(base, F.lit("/"), url))
    )


def _string(v: Column, path: str) -> Column:
    return F.nullif(F.trim(F.try_variant_get(v, path, "string")), F.lit(""))


def _is(v: Column, path: str, kind: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith(kind)


def _filled(template: str, **values: Column) -> Column:
    """A template with its {names} replaced; null if a value is."""
    x = F.lit(template)
    for k, v in values.items():
        x = F.replace(x, F.lit("{" + k + "}"), v)
    return x


def listing_links(pages: DataFrame, base: Column, least: int = 4) -> DataFrame:
    """All columns but html, and pos, name and url of a page's links, each address once and in the order of the page.

    Item lists in JSON-LD come first (of an address named twice the later name counts), then anchors whose text has `least` characters and whose
    address is on the site (the first counts). pages: one row a page, told apart by its columns but html.
    """
    keys = [c for c in pages.columns if c != "html"]
    rows = pages.select(*keys, "html", base.alias("_base"))
    ld = F.flatten(F.transform(json_blocks(F.col("html")), graph_items))
    items = F.flatten(F.transform(ld, lambda v: F.coalesce(F.try_variant_get(v, "$.itemListElement", "array<variant>"), F.array().cast("array<variant>"))))
    inner = lambda v: F.coalesce(F.try_variant_get(v, "$.item", "variant"), v)
    listed = F.transform(items, lambda v: F.struct(F.when(_is(inner(v), "$", "STRING"), _string(inner(v), "$")).otherwise(_string(inner(v), "$.url")).alias("url"), _string(inner(v), "$.name").alias("name")))
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*>.*?</a\s*>"), F.lit(0))
    href = lambda t: F.coalesce(*(F.nullif(F.regexp_extract(t, rf"(?is)^<a\b[^>]*?\bhref\s*=\s*{q}", 1), F.lit("")) for q in (r'"([^"]*)"', r"'([^']*)'", r"([^\s\"'>]+)")))
    anchors = F.transform(tags, lambda t: F.struct(unescaped(href(t)).alias("url"), F.trim(F.regexp_replace(unescaped(F.regexp_replace(t, r"(?s)<[^>]*>", " ")), r"\s+", " ")).alias("name")))
    found = rows.select(*keys, "_base", F.explode(F.array(F.struct(F.lit(0).alias("kind"), listed.alias("links")), F.struct(F.lit(1).alias("kind"), anchors.alias("links")))).alias("x"))
    each = found.select(*keys, "_base", "x.kind", F.posexplode("x.links").alias("at", "link")).filter("link.url IS NOT NULL AND link.name IS NOT NULL")
    each = each.withColumn("url", absolute(F.col("link.url"), F.col("_base"))).filter((F.col("kind") == 0) | ((F.length("link.name") >= least) & F.startswith("url", F.col("_base"))))
    place = F.struct("kind", "at")
    last = F.max_by(F.when(F.col("kind") == 0, F.col("link.name")), F.when(F.col("kind") == 0, F.col("at")))
    by_url = each.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("url").alias("link_url")).agg(F.min(place).alias("pos"), F.coalesce(last, F.min_by("link.name", place)).alias("link_name"))
    return by_url.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), "pos", "link_name", "link_url")


def references(pages: DataFrame) -> DataFrame:
    """Detail pages (source, builder, url, listing_name, city, html) to canonical identities, the columns of REFERENCE. Prices are never read.

    The name is the headline, else a name in JSON-LD, else the listing's; other names are aliases. The address is that of JSON-LD, else a street with a
    number in the visible text.
    """
    ld = F.flatten(F.transform(json_blocks(F.col("html")), graph_items))
    headline = F.nullif(F.trim(F.regexp_replace(unescaped(F.regexp_replace(F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1\s*>", 1), r"(?s)<[^>]*>", " ")), r"\s+", " ")), F.lit(""))
    names = F.array_compact(F.concat(F.array(headline), F.transform(ld, lambda v: _string(v, "$.name"))))
    place = F.transform(ld, lambda v: F.when(_is(v, "$.address", "STRING"), F.struct(_string(v, "$.address").alias("street"), F.lit(None).cast("string").alias("district"), F.lit(None).cast("string").alias("city"))).otherwise(
        F.struct(_string(v, "$.address.streetAddress").alias("street"), F.coalesce(_string(v, "$.address.addressLocality"), _string(v, "$.address.addressRegion")).alias("district"), _string(v, "$.address.addressLocality").alias("city"))))
    place = F.get(F.filter(place, lambda p: p["street"].isNotNull() | p["district"].isNotNull()), F.lit(0))
    read = pages.select("*", names.alias("_names"), place.alias("_place"))
    name = F.coalesce(F.get(F.filter("_names", lambda n: F.length(n) >= 4), F.lit(0)), F.col("listing_name"))
    address = F.coalesce("_place.street", street_in_text(visible_text(F.col("html")), numbered=True))
    district = F.coalesce("_place.district", meta_content(F.col("html"), "[^\"']*bairro[^\"']*", "[^\"']*neighbou?rhood[^\"']*"))
    read = read.withColumns({"name": name, "address": address, "district": district})
    own = name_key(F.col("name"))
    others = F.array_distinct(F.array_compact(F.concat(F.array("listing_name"), F.col("_names"))))
    aliases = F.filter(others, lambda n: ~name_key(n).eqNullSafe(own))
    said = F.concat(F.lit("catalogue:"), F.col("source"))
    provenance = F.map_filter(F.create_map(F.lit("name"), said, F.lit("address"), F.when(F.col("address").isNotNull(), said)), lambda _, v: v.isNotNull())
    city = F.coalesce("_place.city", F.trim(F.substring_index("city", ",", 1)))
    return read.select("name", aliases.alias("aliases"), "builder", "address", "district", city.alias("city"), "source", "url", provenance.alias("provenance"))


def _looked_up(asked: DataFrame, kind: str, days: int, read, store: Store, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Rows (key, source, url and others) with payload: the cache's, else what `read` makes of those that it doesn't know (key, payload); counts by source.

    What was read goes into the cache; what could not be read is asked for again next time. asked: one row a key.
    """
    known = store.cached(kind, now).select("key", F.col("payload").alias("cached"))
    rows = written(asked.join(known, "key", "left"), "asked")
    new = written(read(rows.filter("cached IS NULL").drop("cached")), "read")
    if not new.isEmpty():
        at = F.lit(now).cast("timestamp_ntz")
        entry = new.join(rows.select("key", "source", "url"), "key").select(F.lit(kind).alias("kind"), "key", "source", "url", "payload", at.alias("read_at"), (at + F.expr(f"INTERVAL {days} DAYS")).alias("expires_at"))
        store.put("identity_cache", entry.select(*(c.split()[0] for c in CACHE.split(", "))), ["kind", "key"], "read_at")
    both = written(rows.join(new, "key", "left").withColumn("payload", F.coalesce("cached", "payload")), "known")
    counts = both.groupBy("source").agg(F.count("*").alias("wanted"), F.count("cached").alias("from_cache"), F.count_if(F.col("cached").isNull() & F.col("payload").isNotNull()).alias("from_pages"), F.count_if(F.col("payload").isNull()).alias("unavailable"))
    return both.filter("payload IS NOT NULL").drop("cached"), counts.select(F.lit(kind).alias("stage"), "*")


def official_references(wanted: DataFrame, pages: DataFrame, store: Store, now: datetime, providers: tuple[Provider, ...] = PROVIDERS) -> tuple[DataFrame, DataFrame]:
    """For wanted buildings (target_id, city as 'Name, UF', name) the official identity (target_id and the columns of REFERENCE), and the counts of
    the look-ups by stage and source.

    Stage one looks up each city's listing page at each builder, stage two the pages of the buildings whose names fit. Both ask the cache
    first; what it doesn't know comes from `pages` (url, html; a page that is not there, or has null html, is unavailable: that source is
    passed over). A target takes the first candidate, by likeness of the names, then in the order of the builders and of their lists, whose page
    names it. Names and links meet by a word of theirs that is not generic, never all with all; targets without a name of their own get nothing.
    """
    goal = wanted.select("target_id", "city", F.col("name").alias("target"), name_key(F.col("name")).alias("key")).filter("key IS NOT NULL AND city IS NOT NULL")
    goal = written(goal, "wanted")
    names = written(goal.select("city", "target", "key").distinct(), "names")  # looked up once, however many targets have that name
    html = pages.filter("url IS NOT NULL AND html IS NOT NULL").groupBy("url").agg(F.min("html").alias("html"))
    place, where = city_and_region(F.col("city")), slug(F.substring_index("city", ",", 1))
    table = F.array(*(F.struct(F.lit(i).alias("no"), F.lit(p.name).alias("source"), F.lit(p.builder).alias("builder"), F.lit(p.domain).alias("domain"), _filled(p.listing, region=F.lower(F.coalesce(place["region"], F.lit(""))), city=where).alias("url")) for i, p in enumerate(providers)))
    lists = names.select("city").distinct().select("city", F.explode(table).alias("p")).select(F.concat("p.source", F.lit(":"), normalize(F.col("city"))).alias("key"), "city", "p.*")
    one = lists.groupBy("key", "source", "url", "domain").agg(F.min("no").alias("no"))  # spellings of a city share a listing

    def read_lists(rows: DataFrame) -> DataFrame:
        found = written(rows.select("key", "url", "domain").join(html, "url"), "lists")
        links = listing_links(found.select("key", "domain", "html"), F.col("domain")).groupBy("key").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", "link_name", "link_url"))), lambda x: F.struct(x["link_name"].alias("name"), x["link_url"].alias("url")))).alias("payload"))
        return found.select("key").join(links, "key", "left").select("key", F.coalesce("payload", F.lit("[]")).alias("payload"))  # a page without links is an answer

    listings, counted = _looked_up(one, "official_listing", LISTING_DAYS, read_lists, store, now)
    links = listings.select("key", "source", F.posexplode(F.from_json("payload", "array<struct<name:string,url:string>>")).alias("pos", "x")).join(lists.select("key", "city", "no", "builder"), "key")
    links = links.select("city", "no", "source", "builder", F.lit(1).alias("turn"), "pos", F.col("x.name").alias("listing_name"), F.col("x.url").alias("url"))
    words = lambda c: F.explode(F.filter(F.array_distinct(tokens(c)), lambda w: ~w.isin(*GENERIC))).alias("word")  # noqa: E731  fitting names share a word that is not generic
    met = names.select("city", "target", "key", words(F.col("target"))).join(links.select("*", words(F.col("listing_name"))), ["city", "word"]).drop("word").distinct()
    met = written(met, "met")
    fits = met.filter(compatible_catalogue_name(F.col("target"), F.col("listing_name"))).withColumn("score", F.coalesce(name_similarity(name_key(F.col("listing_name")), F.col("key")), F.lit(0.0)))
    for i, p in enumerate(providers):
        if p.detail:
            state = F.try_element_at(F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv)), place["region"])
            url = _filled(p.detail, state=state, city=where, name=slug(F.col("target")))
            direct = names.select("city", "target", "key", F.lit(i).alias("no"), F.lit(p.name).alias("source"), F.lit(p.builder).alias("builder"), F.lit(0).alias("turn"), F.lit(0).alias("pos"), F.col("target").alias("listing_name"), url.alias("url"), F.lit(1.0).alias("score"))
            fits = fits.unionByName(direct.filter("url IS NOT NULL"))
    fits = written(fits, "candidates")

    asked = fits.groupBy(F.concat("source", F.lit(":"), "url").alias("key"), "source", "builder", "url").agg(F.min_by(F.struct("listing_name", "city"), F.struct(-F.col("turn"), "listing_name", "city")).alias("x")).select("key", "source", "builder", "url", "x.*")

    def read_details(rows: DataFrame) -> DataFrame:
        return references(rows.join(html, "url")).select(F.concat("source", F.lit(":"), "url").alias("key"), F.to_json(F.struct(*(c.split()[0] for c in REFERENCE.split(", ")))).alias("payload"))

    details, counted_details = _looked_up(asked, "official_detail", DETAIL_DAYS, read_details, store, now)
    known = details.select("source", "url", F.from_json("payload", REFERENCE).alias("ref"))
    order = F.struct((-F.col("score")).alias("a"), F.col("no").alias("b"), F.col("turn").alias("c"), F.col("pos").alias("d"), F.col("url").alias("e"))
    found = fits.select("city", "target", "source", "url", order.alias("order")).join(known, ["source", "url"])
    named = found.select("*", F.explode(F.array_compact(F.concat(F.array("ref.name"), F.coalesce("ref.aliases", F.array().cast("array<string>"))))).alias("one")).filter(compatible_catalogue_name(F.col("target"), F.col("one")))
    best = goal.join(named.groupBy("city", "target").agg(F.min_by(F.struct("ref", "order"), "order").alias("x")), ["city", "target"]).groupBy("target_id").agg(F.min_by("x.ref", "x.order").alias("ref"))
    return best.select("target_id", "ref.*"), counted.unionByName(counted_details)
