"""Queries of detail pages and catalogues: pages as they are, or made from the tables' rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..shared import scratch, temporary
from ..sources import catalogue, details
from ..sources.tables import Store
from .listing import table
from .registry import query

NOW = datetime(2026, 5, 1)
PLAIN = "replace(replace(replace(replace(replace(replace({}, '&quot;', '\"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&')"


@query(rf"""
WITH a AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS base, regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a\s*>') AS tags FROM pages),
t AS (SELECT page_id, base, unnest(tags) AS tag, unnest(range(len(tags))) AS spot FROM a),
l AS (SELECT page_id, base, spot, trim(regexp_replace({PLAIN.format("regexp_replace(tag, '<[^>]*>', ' ', 'g')")}, '\s+', ' ', 'g')) AS name, {PLAIN.format("regexp_extract(tag, 'href=\"([^\"]*)\"', 1)")} AS href FROM t),
u AS (SELECT page_id, spot, name, base, CASE WHEN href LIKE 'http%' THEN href WHEN href LIKE '/%' THEN base || href ELSE base || '/' || href END AS url FROM l WHERE length(name) >= 4 AND href <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY spot) AS r FROM u WHERE starts_with(url, base))
SELECT page_id, spot, name, url FROM f WHERE r = 1""")
def page_links(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1).alias("base"), "html")
    links = catalogue.listing_links(pages, F.col("base"))
    return links.select("page_id", F.col("pos.at").cast("long").alias("spot"), F.col("link_name").alias("name"), F.col("link_url").alias("url"))


@query("""
WITH o AS (SELECT o_custkey AS k, arg_min(o_orderpriority, o_orderkey) AS p, min(o_orderkey) AS first FROM orders GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'Order ' || first END AS title, CASE WHEN c_custkey % 4 < 2 THEN c_mktsegment END AS district,
  CASE WHEN first IS NOT NULL AND c_custkey % 5 = 0 THEN p WHEN c_custkey % 2 = 0 THEN 'second text' END AS descr, CASE WHEN first IS NULL THEN NULL ELSE c_nationkey::VARCHAR END AS address
FROM customer LEFT JOIN o ON o.k = c_custkey""")
def deep_search(spark, sf):
    """Customers with their orders as nested JSON; fields stand at several depths, blank or as objects where they don't count."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    order = F.struct(F.struct(F.concat(F.lit("Order "), "o_orderkey").alias("Title"), F.when(F.col("o_custkey") % 5 == 0, F.col("o_orderpriority")).alias("DESCRIPTION")).alias("item"), F.lit(" ").alias("description"))
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", order.alias("x")))).alias("os"))
    rows = c.join(o, k == F.col("k"), "left")
    near = F.struct(F.struct(F.when(k % 4 == 0, F.col("c_mktsegment")).alias("bairro")).alias("neighborhood"), F.array(F.when(k % 4 == 1, F.struct(F.col("c_mktsegment").alias("Neighborhood")))).alias("list"))
    first = F.to_json(F.struct(near.alias("near"), F.transform("os", lambda x: x["x"]).alias("orders"), F.when(k % 3 == 0, F.col("c_name")).alias("name"), F.when(F.size("os") > 0, F.struct(F.struct(F.col("c_nationkey").alias("endereco")).alias("address"))).alias("place")))
    second = F.when(k % 2 == 0, F.lit('[[], {"x": [null, {"descricao": "second text", "name": "too late"}]}]')).otherwise("{broken")
    third = F.when((k % 3 > 0) & F.col("os").isNull(), F.lit("[]"))
    found = rows.select(k.alias("id"), F.col("os").isNull().alias("none"), details.deep_values(F.array(F.lit("nonsense"), first, second, third)).alias("d"))
    late = F.col("none") & (F.col("id") % 3 > 0)  # then the name of the second text is the first
    return found.select("id", F.when(~late, F.col("d.title")).alias("title"), "d.district", "d.descr", "d.address")


DETAIL_SQL = r"""
WITH p AS (SELECT page_id AS k, page_id % 5 AS c, html, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g') AS t FROM pages),
-- word ends of this dialect are those of ASCII: the street is looked for in a text of the same length where other letters are x
q AS (SELECT *, regexp_extract(regexp_replace(regexp_replace(t, '[^\x00-\x7F\p{L}\p{N}]', '-', 'g'), '[^\x00-\x7F]', 'x', 'g') , '(?i)\b((?:Rua|R\.|Avenida|Av\.|Travessa|Alameda)\s+[^,;|]{3,70}(?:[,\s]+\d{1,6})?)\b', 1) AS m,
  regexp_replace(regexp_replace(t, '[^\x00-\x7F\p{L}\p{N}]', '-', 'g'), '[^\x00-\x7F]', 'x', 'g') AS a FROM p)
SELECT k AS page_id, CASE c WHEN 0 THEN 'Casa ' || k WHEN 1 THEN 'Apto ' || k WHEN 2 THEN 'Residencial Sol ' || k || ' com vista' END AS title,
  CASE WHEN c = 2 THEN 'Sol ' || k WHEN c = 1 THEN 'Torre ' || k END AS dev_name,
  CASE c WHEN 0 THEN 'Rua A, ' || k WHEN 1 THEN 'Av. B ' || k WHEN 3 THEN 'Rua das Flores, ' || (k % 1000000)
    ELSE CASE WHEN m <> '' THEN trim(substr(t, strpos(a, m), length(m))) END END AS address,
  CASE c WHEN 0 THEN 'Centro' WHEN 1 THEN 'Bairro ' || (k % 7) END AS district, CASE WHEN c = 0 THEN -3.5 - k / 1000 END::DOUBLE AS lat, CASE WHEN c = 2 THEN 'A & ' || k END AS descr
FROM q"""


@query(DETAIL_SQL)
def page_details(spark, sf):
    """All pages, four fifths of them with what a listing's page says in JSON-LD, state, meta tags or text put in front of their own."""
    p, k = table(spark, sf, "pages"), F.col("page_id")
    j = lambda *cs: F.to_json(F.struct(*cs))
    ld = F.concat(F.lit('<script type="application/ld+json">'), j(F.concat(F.lit("Casa "), k).alias("headline"), F.struct(F.concat(F.lit("Rua A, "), k).alias("streetAddress"), F.lit("Centro").alias("addressLocality")).alias("address"), F.struct((F.lit(-3.5) - k / 1000).alias("latitude")).alias("geo")), F.lit("</script>"))
    state = F.concat(F.lit('<script id="__NEXT_DATA__">'), j(F.array(F.struct(F.concat(F.lit("Apto "), k).alias("Title"), F.struct(F.concat(F.lit("Av. B "), k).alias("streetAddress"), F.concat(F.lit("Bairro "), k % 7).alias("neighborhood")).alias("at"), F.concat(F.lit("Torre "), k).alias("developmentName"))).alias("listings")), F.lit("</script>"))
    meta = F.concat(F.lit('<meta content="Residencial Sol '), k, F.lit(' com vista" property="og:title"><meta name="description" content="A &amp; '), k, F.lit('">'))
    text = F.concat(F.lit("<p>fica na <b>Rua das</b> Flores, "), k % 1000000, F.lit(" | </p>"))
    html = F.concat(F.when(k % 5 == 0, ld).when(k % 5 == 1, state).when(k % 5 == 2, meta).when(k % 5 == 3, text).otherwise(""), F.col("html"))
    return details.details(p.select("page_id", html.alias("html"))).select("page_id", "title", "dev_name", "address", "district", "lat", "descr")


@query("""
WITH p AS (SELECT p_partkey AS id, p_partkey % 5 AS r, p_partkey % 4 AS v, p_name AS n FROM part),
l AS (SELECT r, n, min(v) AS v FROM p GROUP BY 1, 2), d AS (SELECT r, v, n, min(id) AS first FROM p GROUP BY 1, 2, 3),
b AS (SELECT * FROM (VALUES (0, 'mrv', 'MRV', 'https://www.mrv.com.br'), (1, 'direcional', 'Direcional', 'https://www.direcional.com.br'), (2, 'tenda', 'Tenda', 'https://tenda.com'), (3, 'cury', 'Cury', 'https://cury.net')) t(v, source, builder, domain))
SELECT p.id, 'Residencial ' || p.n AS name, b.builder, b.source, 'Rua ' || d.first || ', 7' AS address, 'District ' || d.v AS district, b.domain || '/e/' || p.r || '/' || replace(p.n, ' ', '-') AS url, 0 AS from_pages
FROM p JOIN l ON l.r = p.r AND l.n = p.n JOIN d ON d.r = l.r AND d.n = l.n AND d.v = l.v JOIN b ON b.v = l.v WHERE regexp_matches(regexp_replace(p.n, '^new ', ''), '[a-z]{4}')""")
def catalogue_references(spark, sf):
    """Parts looked up in the catalogues of four builders in five cities, whose pages list them; twice, the second time without any page."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("n"), (F.col("p_partkey") % 5).alias("r"), (F.col("p_partkey") % 4).cast("int").alias("v"))
    sites = spark.createDataFrame([(i, x.domain, x.listing.replace("{region}", "ce").replace("{city}", "town-")) for i, x in enumerate(catalogue.PROVIDERS)], "v int, domain string, listing string")
    offers = p.groupBy("r", "v", "n").agg(F.min("id").alias("first")).join(F.broadcast(sites), "v")
    path = F.concat(F.lit("/e/"), "r", F.lit("/"), F.replace("n", F.lit(" "), F.lit("-")))
    link = F.concat(F.lit('<a href="'), path, F.lit('">Residencial '), "n", F.lit("</a>"))
    lists = offers.groupBy(F.concat("listing", "r").alias("url")).agg(F.array_join(F.array_sort(F.collect_list(link)), "\n").alias("html"))
    about = F.to_json(F.struct(F.struct(F.concat(F.lit("Rua "), "first", F.lit(", 7")).alias("streetAddress"), F.concat(F.lit("District "), "v").alias("addressRegion")).alias("address"), F.struct(F.col("first").alias("price")).alias("offers")))
    items = offers.select(F.concat("domain", path).alias("url"), F.concat(F.lit("<h1>Residencial "), "n", F.lit('</h1><script type="application/ld+json">'), about, F.lit("</script>")).alias("html"))
    wanted = p.select(F.col("id").alias("target_id"), F.concat(F.lit("Town "), "r", F.lit(", CE")).alias("city"), F.concat(F.lit("Residencial "), F.col("n")).alias("name"))
    store, pages = Store(spark, scratch(spark, "catalogue")), lists.unionByName(items)
    with temporary(spark):
        catalogue.official_references(wanted, pages, store, NOW)
        found, counts = catalogue.official_references(wanted, pages.limit(0), store, NOW + timedelta(days=1))
        read = counts.agg(F.sum("from_pages").cast("int").alias("n")).first().n
        out = found.select(F.col("target_id").alias("id"), "name", "builder", "source", "address", "district", "url", F.lit(read).alias("from_pages"))
        path = scratch(spark, "references")
        out.write.parquet(path)
    return spark.read.parquet(path)
