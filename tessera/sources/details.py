"""Detail pages of listings: title, name, description, address and place out of JSON-LD, embedded state, meta tags and text, and a cache of what was read."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nested import graph_items, json_blocks
from ..functions.text import development_name
from ..operators.lookup import needy
from ..shared import written
from .tables import CACHE, Store

# By what keys (in lower case) an embedded state names each field, and how long a read detail page is good.
STATE_KEYS = {
    "address": ("streetaddress", "address", "endereco"),
    "district": ("neighborhood", "bairro"),
    "descr": ("description", "descricao"),
    "title": ("title", "name", "titulo"),
    "dev_name": ("developmentname", "condominiumname", "nomeempreendimento"),
}
DETAIL_DAYS = 30
DETAIL = "title string, dev_name string, descr string, address string, district string, lat double, lng double"


def first_by_key(document, groups: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """For each group of keys the first text or number under one of them: an object's own keys come before anything inside its values, and
    values are entered in their order. Blank texts don't count. The walk keeps its own stack, so depth is no matter.
    """
    wanted = {k: g for g, keys in groups.items() for k in keys}
    found: dict[str, str] = {}
    stack = [document]
    while stack and len(found) < len(groups):
        x = stack.pop()
        if isinstance(x, dict):
            for k, v in x.items():
                g = wanted.get(k.lower())
                if g and g not in found and isinstance(v, (str, int, float)) and str(v).strip():
                    found[g] = str(v).strip()
            stack.extend(reversed(x.values()))
        elif isinstance(x, list):
            stack.extend(reversed(x))
    return found


def deep_values(documents: Column, groups: dict[str, tuple[str, ...]] = STATE_KEYS) -> Column:
    """Of a list of JSON texts a struct with the first value of each group of keys, earlier documents first; what is no JSON is passed over.

    Keys keep the order of the text, which no built-in JSON type does; texts go through Python in Arrow batches.
    """

    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for documents in texts:
                found: dict[str, str] = {}
                for text in [] if documents is None else documents:
                    try:
                        x = json.loads(text)
                    except (ValueError, TypeError, RecursionError):
                        continue
                    found = first_by_key(x, groups) | found
                rows.append([found.get(g) for g in groups])
            yield pd.DataFrame(rows, columns=list(groups), dtype=object)

    return F.pandas_udf(walk, ", ".join(f"{g} string" for g in groups))(documents)


def _present(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def _first(items: Column, of) -> Column:
    return F.get(F.filter(F.transform(items, lambda v: _present(of(v))), lambda x: x.isNotNull()), F.lit(0))


def unescaped(x: Column) -> Column:
    """The common character references of attribute values and texts, decoded."""
    for a, b in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def meta_content(html: Column, *names: str) -> Column:
    """The content of the first meta tag with one of the names (as its property, else as its name), in the order of the names."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    content = lambda t: _present(unescaped(F.concat(F.regexp_extract(t, r'(?is)\bcontent\s*=\s*"([^"]*)"', 1), F.regexp_extract(t, r"(?is)\bcontent\s*=\s*'([^']*)'", 1))))
    named = lambda kind, n: F.get(F.transform(F.filter(tags, lambda t: t.rlike(rf"""(?is)\b{kind}\s*=\s*["']?{n}["'\s/>]""")), content), F.lit(0))
    return F.coalesce(*(named(kind, n) for n in names for kind in ("property", "name")))


def visible_text(html: Column) -> Column:
    """A page's text: no comments, scripts, styles and tags; white space as one blank."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|template)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def street_in_text(text: Column, numbered: bool = False) -> Column:
    """The first street that a text names by its kind, with its number if there is one (numbered: only if there is one)."""
    number = r"[,\s]+\d{1,6}" if numbered else r"(?:[,\s]+\d{1,6})?"
    return _present(F.regexp_extract(text, rf"(?iu)\b((?:Rua|R\.|Avenida|Av\.|Travessa|Alameda)\s+[^,;|]{{3,70}}{number})\b", 1))


def details(pages: DataFrame) -> DataFrame:
    """Pages (url, html and others) with title, dev_name, descr, address, district, lat and lng in place of html.

    JSON-LD counts before embedded states (any script that is JSON), these before meta tags, and an address before a street in the visible
    text. A name that no state gives is looked for in title and description. Null html and pages that say nothing give nulls.
    """
    ld = F.flatten(F.transform(json_blocks(F.col("html")), graph_items))
    text = lambda v, p: F.try_variant_get(v, p, "string")
    either = lambda *ps: lambda v: F.coalesce(*(_present(text(v, p)) for p in ps))
    whole = lambda v: F.when(F.schema_of_variant(F.try_variant_get(v, "$.address", "variant")) == "STRING", text(v, "$.address"))
    scripts = F.regexp_extract_all("html", F.lit(r"(?is)<script\b[^>]*>(.*?)</script\s*>"), F.lit(1))
    states = F.filter(scripts, lambda s: (F.length(s) > 30) & F.ltrim(s).rlike(r"^[{\[]"))
    rest = [c for c in pages.columns if c not in ("html", *STATE_KEYS, "lat", "lng")]
    read = pages.select(
        *rest, "html", deep_values(states).alias("_state"), _first(ld, either("$.name", "$.headline")).alias("_title"), _first(ld, either("$.description")).alias("_descr"),
        _first(ld, lambda v: F.coalesce(_present(whole(v)), _present(text(v, "$.address.streetAddress")))).alias("_address"), _first(ld, either("$.address.addressLocality")).alias("_district"),
        _first(ld, either("$.geo.latitude")).try_cast("double").alias("lat"), _first(ld, either("$.geo.longitude")).try_cast("double").alias("lng"),
    )
    title = F.coalesce("_title", "_state.title", meta_content(F.col("html"), "og:title"))
    descr = F.coalesce("_descr", "_state.descr", meta_content(F.col("html"), "og:description", "description"))
    named = read.withColumns({"title": title, "descr": descr, "address": F.coalesce("_address", "_state.address", street_in_text(visible_text(F.col("html")))), "district": F.coalesce("_district", "_state.district")})
    dev_name = F.coalesce("_state.dev_name", development_name(F.concat_ws(" ", "title", "descr")))
    return named.withColumn("dev_name", dev_name).select(*rest, *(c.split()[0] for c in DETAIL.split(", ")))


def cached_details(wanted: DataFrame, pages: DataFrame, store: Store, now: datetime, days: int = DETAIL_DAYS) -> tuple[DataFrame, DataFrame]:
    """Details of the wanted listings (url, source), and how many came from the cache, were read from a page, and had none.

    What the cache knows is not read again. Pages that are not there are no answer and are looked for again next time; what pages say is put
    into the cache, also if it is nothing, for so many days.
    """
    urls = wanted.filter("url IS NOT NULL").groupBy("url").agg(F.min("source").alias("source"))
    known = store.cached("listing_detail", now).select(F.col("key").alias("url"), "payload")
    asked = written(urls.join(known, "url", "left"), "asked")
    missing = asked.filter("payload IS NULL").drop("payload")
    found = pages.filter("url IS NOT NULL AND html IS NOT NULL").groupBy("url").agg(F.min("html").alias("html"))
    read = written(details(missing.join(found, "url")).select("url", "source", F.to_json(F.struct(*(c.split()[0] for c in DETAIL.split(", ")))).alias("payload")), "details")
    if not read.isEmpty():
        at = F.lit(now).cast("timestamp_ntz")
        entry = read.select(F.lit("listing_detail").alias("kind"), F.col("url").alias("key"), "source", "url", "payload", at.alias("read_at"), (at + F.expr(f"INTERVAL {days} DAYS")).alias("expires_at"))
        store.put("identity_cache", entry.select(*(c.split()[0] for c in CACHE.split(", "))), ["kind", "key"], "read_at")
    both = asked.filter("payload IS NOT NULL").unionByName(read)
    out = both.select("url", F.concat(F.lit("detail:"), F.coalesce("source", F.lit("unknown"))).alias("origin"), F.from_json("payload", DETAIL).alias("d")).select("url", "origin", "d.*")
    counts = asked.agg(F.count("*").alias("wanted"), F.count("payload").alias("from_cache")).crossJoin(read.agg(F.count("*").alias("from_pages")))  # one row each
    return out, counts.withColumn("unavailable", F.col("wanted") - F.col("from_cache") - F.col("from_pages"))


def enriched(listings: DataFrame, pages: DataFrame, store: Store, now: datetime, each: int = 4, overall: int = 12, sources: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Listings whose gaps the detail pages of the neediest ones fill, with filled (which columns were) and identity_sources (where what is known
    comes from), and the counts of cached_details.

    Candidates lack a name, an address or a description and have a web address (and one of the sources, if these are given). A place that a
    detail page gave is exact.
    """
    fields, needed = [c.split()[0] for c in DETAIL.split(", ")], ["dev_name", "address", "descr"]
    may = F.lower("url").rlike("^https?://")
    may = may & F.lower("source").isin(*sources) if sources else may
    asked = F.when(may, F.col("url"))
    picked = written(needy(listings.filter(may), needed, each, overall).select("idx", "source", "url"), "needy")
    found, counts = cached_details(picked.select("url", "source"), pages, store, now)
    rows = listings.withColumns({c: F.lit(None).cast(t) for c, t in (x.split() for x in DETAIL.split(", ")) if c not in listings.columns}).withColumn("_asked", asked)
    d = found.select(F.col("url").alias("_k"), *(F.col(c).alias(f"_d_{c}") for c in fields))
    joined = rows.join(F.broadcast(picked.select("idx", F.lit(True).alias("_go"))), "idx", "left").join(F.broadcast(d), (F.col("_asked") == F.col("_k")) & F.col("_go"), "left")  # `overall` rows each
    filled = F.filter(F.array(*(F.when(F.col(c).isNull() & F.col(f"_d_{c}").isNotNull(), F.lit(c)) for c in fields)), lambda x: x.isNotNull())
    own, detail = (F.concat(F.lit(f"{k}:"), F.coalesce("source", F.lit("unknown"))) for k in ("listing", "detail"))
    out = joined.withColumn("filled", filled).withColumn("identity_sources", F.when(F.size("filled") > 0, F.array_sort(F.array(own, detail))).otherwise(F.array(own)))
    out = out.select(*(F.coalesce(c, f"_d_{c}").alias(c) if c in fields else F.col(c) for c in rows.columns if c != "_asked"), "filled", "identity_sources")
    if "coord_origin" in out.columns:
        out = out.withColumn("coord_origin", F.coalesce("coord_origin", F.when(F.array_contains("filled", "lat"), "exact")))
    return out, counts
