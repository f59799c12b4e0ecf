"""Queries of the sources' parsers and of small operators of searches: pages are made from the tables' rows, and the SQL says from the same rows what has
to come out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import grouping, lookup
from ..sources import paged, pages, tables
from .listing import listings, table
from .registry import query


def _text(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _json(**fields) -> Column:
    return F.struct(*(v.alias(k) for k, v in fields.items()))


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS n, p_retailprice AS v, p_size AS s FROM part)
SELECT k AS page_id, 'Casa ' || n AS title, 'https://x/' || k || '/a' AS url, v AS price, (s + 40)::DOUBLE AS area, true AS by_area, s % 5 AS rooms, 'Santos' AS city, 'Rua ' || n AS address, 1 AS photos FROM p
UNION ALL SELECT k, n, 'https://x/' || k || '/b', v * 2, NULL, NULL, NULL, NULL, NULL, 0 FROM p WHERE k % 2 = 0""")
def json_ld_pages(spark, sf):
    """Item lists of two listings, the second of which only some pages have and says little, and objects that are no listings."""
    k, v, s = F.col("p_partkey"), F.col("p_retailprice"), F.col("p_size")
    first = _json(**{"@type": F.lit("Apartment")}, name=_text("Casa ", F.col("p_name")), url=_text("https://x/", k, "/a"), offers=_json(price=v), floorSize=_json(value=s + 40), numberOfRooms=s % 5, address=_json(addressLocality=F.lit("Santos"), streetAddress=_text("Rua ", F.col("p_name"))), image=F.array(_text("https://x/", k, ".jpg"), F.lit("https://x/logo.png")))
    second = F.when(k % 2 == 0, _json(item=_json(**{"@type": F.lit("Product")}, name=F.col("p_name"), url=_text("https://x/", k, "/b"), offers=_json(lowPrice=v * 2))))
    other = _json(**{"@type": F.lit("Organization")}, name=F.lit("not a listing"))
    body = F.concat(F.lit('{"@graph": ['), F.to_json(other), F.lit(', {"itemListElement": ['), F.to_json(_json(item=first)), F.coalesce(F.concat(F.lit(", "), F.to_json(second)), F.lit("")), F.lit("]}]}"))
    html = F.concat(F.lit('<html><script type="application/ld+json">{broken</script><script type="application/ld+json">'), body, F.lit("</script></html>"))
    got = pages.json_ld_listings(table(spark, sf, "part").select(k.alias("page_id"), html.alias("html")), "s")
    return got.select("page_id", "title", "url", "price", "area", (F.abs(F.col("price_m2") - F.col("price") / F.col("area")) < 0.0051).alias("by_area"), "rooms", "city", "address", F.size("photos").alias("photos"))


@query("""SELECT o_custkey AS page_id, o_orderkey::VARCHAR AS listing_id, 'Apto ' || o_orderpriority AS title, 'https://x/' || o_orderkey AS url, round(o_totalprice)::DOUBLE AS price, (o_orderkey % 90 + 20)::DOUBLE AS area, o_orderkey % 4 AS rooms, CASE WHEN o_orderkey % 3 = 0 THEN 'Recife' END AS city FROM orders""")
def streamed_pages(spark, sf):
    """A customer's page streams its orders as ads in chunks of escaped text; a shorter list, and every listing a second time, come with it."""
    k, price = F.col("o_orderkey"), F.round("o_totalprice").cast("long")
    props = F.array(_json(name=F.lit("size"), value=_text(k % 90 + 20, "m²")), _json(name=F.lit("rooms"), value=F.lit("9")), _json(name=F.lit("rooms"), value=(k % 4).cast("string")))
    ad = _json(listId=k, subject=_text("Apto ", F.col("o_orderpriority")), url=_text("https://x/", k), priceValue=_text("R$ ", F.replace(F.format_number(price, 0), F.lit(","), F.lit("."))), properties=props, locationDetails=_json(municipality=F.when(k % 3 == 0, F.lit("Recife"))))
    ads = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), ad.alias("ad")))).alias("xs"))
    text = F.to_json(F.concat(F.transform("xs", lambda x: x["ad"]), F.transform("xs", lambda x: x["ad"])))
    state = F.concat(F.lit('0:{"other":{"ads":[]},"list":{"ads":'), text, F.lit("}}"))
    escaped = F.replace(F.replace(state, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    half = (F.length(state) / 2).cast("int")
    chunk = lambda x: F.concat(F.lit('<script>self.__next_f.push([1,"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"])</script>'))
    html = F.concat(chunk(F.substring(state, F.lit(1), half)), F.lit("<p>x</p>"), chunk(F.substring(state, half + 1, F.length(escaped))))
    return pages.streamed_listings(ads.select("page_id", html.alias("html")), "s").select("page_id", "listing_id", "title", "url", "price", "area", "rooms", "city")


@query("""WITH c AS (SELECT c_nationkey AS n, c_custkey AS k, c_acctbal AS v, c_mktsegment AS d, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) - 1 AS pos FROM customer)
SELECT n AS page_id, pos, k::VARCHAR AS listing_id, 'Apto ' || k AS title, abs(round(v))::DOUBLE AS price, (k % 70 + 20)::DOUBLE AS area, k % 5 AS rooms, d AS district FROM c""")
def state_pages(spark, sf):
    """A nation's page holds its customers in a map by id, and the ids in the order in which they are shown; half have the other names of their fields."""
    c, k, v = table(spark, sf, "customer"), F.col("c_custkey"), F.abs(F.round("c_acctbal")).cast("long")
    a = F.to_json(_json(title=_text("Apto ", k), salePrice=v, area=k % 70 + 20, bedrooms=k % 5, neighbourhood=F.col("c_mktsegment")))
    b = F.to_json(_json(name=_text("Apto ", k), price=v, totalArea=_text(k % 70 + 20, " m2"), rooms=(k % 5).cast("string"), regionName=F.col("c_mktsegment")))
    entry = F.concat(F.lit('"'), k, F.lit('": '), F.when(k % 2 == 0, a).otherwise(b))
    grouped = c.groupBy(F.col("c_nationkey").alias("page_id")).agg(F.array_join(F.collect_list(entry), ", ").alias("houses"), F.array_sort(F.collect_list(-k)).alias("ids"))
    shown = F.to_json(F.transform("ids", lambda x: (-x).cast("string")))
    html = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props": {"pageProps": {"initialState": {"houses": {"gone": {"title": "not shown"}, '), "houses", F.lit('}, "search": {"visible": '), shown, F.lit("}}}}}</script>"))
    return pages.state_listings(grouped.select("page_id", html.alias("html")), "s").select("page_id", F.col("pos").cast("long").alias("pos"), "listing_id", "title", "price", "area", "rooms", "district")


@query("""SELECT s_suppkey AS id, s_name AS title, 'https://x/' || s_suppkey AS url, round(abs(s_acctbal))::DOUBLE AS price, (s_nationkey + 30)::DOUBLE AS area, s_nationkey % 4 AS rooms, 'D' || s_nationkey AS district FROM supplier""")
def flexible_documents(spark, sf):
    """One listing a document, under one of five names for the list and several for each field."""
    k, n, v = F.col("s_suppkey"), F.col("s_nationkey"), F.round(F.abs("s_acctbal")).cast("long")
    a = _json(titulo=F.col("s_name"), link=_text("https://x/", k), preco=v, areaUtil=n + 30, quartos=n % 4, bairro=_text("D", n))
    b = _json(title=F.col("s_name"), permalink=_text("https://x/", k), price=v, attributes=F.array(_json(id=F.lit("TOTAL_AREA"), value_name=_text(n + 30, " m²")), _json(id=F.lit("BEDROOMS"), value_name=(n % 4).cast("string"))), neighborhood=_text("D", n))
    item = F.when(k % 2 == 0, F.to_json(a)).otherwise(F.to_json(b))
    where = F.get(F.array(*map(F.lit, ("results", "items", "listings", "data"))), (k % 5).cast("int"))
    json = F.when(k % 5 == 4, F.concat(F.lit("["), item, F.lit("]"))).otherwise(F.concat(F.lit('{"'), where, F.lit('": ['), item, F.lit("]}")))
    return pages.flexible_listings(table(spark, sf, "supplier").select(k.alias("id"), json.alias("json")), "s").select("id", "title", "url", "price", "area", "rooms", "district")


@query("""SELECT c_custkey AS page_id, c_mktsegment || ' R$ ' || (c_custkey * 1000) || ' , ' || (c_custkey % 90 + 10) || ' m² ' || (c_custkey % 5) || ' quartos' AS title, '/i/' || c_custkey AS url, (c_custkey * 1000)::DOUBLE AS price, (c_custkey % 90 + 10)::DOUBLE AS area, c_custkey % 5 AS rooms, CASE c_custkey % 3 WHEN 0 THEN 'lazy' WHEN 1 THEN 'wide' ELSE 'plain' END AS photo FROM customer""")
def card_pages(spark, sf):
    """Cards between other elements: price, area and rooms in the text, the image by the surest of three attributes."""
    k = F.col("c_custkey")
    image = F.when(k % 3 == 0, F.lit('<img src="tiny" srcset="a 1x, wide 2x" data-src="lazy">')).when(k % 3 == 1, F.lit('<img src="tiny" srcset="a 1x, wide 2x">')).otherwise(F.lit('<img src="plain">'))
    html = _text('<div class="x">R$ 1 <a href="/no">no</a></div><div class="y card z"><a href="/i/', k, '">', F.col("c_mktsegment"), "</a>", image, "<p>R$ ", k * 1000, "<br> , <span>", k % 90 + 10, " m²</span>\n ", k % 5, " quartos</p></div><p>2 quartos</p>")
    got = pages.card_listings(table(spark, sf, "customer").select(k.alias("page_id"), html.alias("html")), "s", "card")
    return got.select("page_id", "title", "url", "price", "area", "rooms", F.col("photos")[0].alias("photo"))


@query("""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_acctbal AS v FROM customer)
SELECT k AS id, 'D' || (k % 7) AS district, 'Rua ' || n || CASE WHEN k % 4 > 0 THEN ', ' || (k % 4) ELSE '' END AS address, CASE WHEN k % 3 > 0 THEN -3.5 - k / 100000 END::DOUBLE AS lat, CASE WHEN k % 3 = 1 THEN 'exact' WHEN k % 3 = 2 THEN 'source_approximate' END AS coord_origin FROM c""")
def located_pages(spark, sf):
    """Listings whose street, number, district and place stand in their pages' streamed payload; some places are not in the country, some numbers are 0."""
    k = F.col("c_custkey")
    lat = F.when(k % 3 > 0, F.lit(-3.5) - k / 100000).otherwise(F.lit(77.0))
    part = _text('"href":"https://x/', k, '","address":{"neighborhood":"D', k % 7, '","isApproximateLocation":', F.when(k % 3 == 2, F.lit("true")).otherwise(F.lit("false")), ',"streetNumber":"', k % 4, '","street":"Rua ', F.col("c_nationkey"), '","latitude":', F.format_string("%.5f", lat), ',"longitude":-38.5}')
    escaped = F.replace(part, F.lit('"'), F.lit('\\"'))
    html = F.concat(F.lit('<script>self.__next_f.push([1,"'), escaped, F.lit('"])</script>'))
    c = table(spark, sf, "customer")
    index = pages.location_index(c.select(k.alias("page_id"), html.alias("html")))
    rows = c.select(k.alias("id"), _text("https://x/", k, "?from=search").alias("url"), F.lit("elsewhere").alias("district"), F.lit(None).cast("string").alias("address"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"))
    return pages.with_locations(rows, index).select("id", "district", "address", F.round("lat", 5).alias("lat"), "coord_origin")


@query("""SELECT 'kept' AS what, NULL AS city, count(*) AS n FROM customer WHERE c_mktsegment = 'FURNITURE' OR c_custkey % 10 = 0 UNION ALL
SELECT 'left out', c_mktsegment, count(*) FROM customer WHERE c_mktsegment <> 'FURNITURE' AND c_custkey % 10 > 0 GROUP BY 2 UNION ALL
SELECT 'strict', NULL, count(*) FROM customer WHERE c_mktsegment = 'FURNITURE' AND c_custkey % 10 > 0 UNION ALL SELECT 'fallback', NULL, count(*) FROM customer WHERE c_mktsegment = 'FURNITURE'""")
def municipalities_of_results(spark, sf):
    """Results of one city (some don't say theirs), and the cascade from a district without results to the city's and the state's."""
    c = table(spark, sf, "customer")
    rows = c.withColumn("city", F.when(F.col("c_custkey") % 10 > 0, F.initcap("c_mktsegment")).when(F.col("c_mktsegment").isNull(), F.lit("x")))
    kept, others = pages.of_municipality(rows, "Fúrniture")
    strict, _ = pages.of_municipality(rows, "FURNITURE", strict=True)
    fallback = pages.first_non_empty([c.filter("c_mktsegment = 'none'"), c.filter("c_mktsegment = 'FURNITURE'"), c])
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), F.lit(None).cast("string").alias("city"), "n")
    return count(kept, "kept").unionByName(others.select(F.lit("left out").alias("what"), F.upper("city").alias("city"), "n")).unionByName(count(strict, "strict")).unionByName(count(fallback, "fallback"))


@query("""WITH p AS (SELECT n_name AS name, 'R' || n_regionkey AS region, lower(n_name) AS key, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey * 1000 ELSE 0 END AS population FROM nation WHERE n_regionkey < 3) SELECT * FROM p""")
def municipality_table(spark, sf):
    n = table(spark, sf, "nation").withColumns({"name": F.col("n_name"), "region": _text("R", F.col("n_regionkey"))})
    population = n.filter("n_nationkey % 3 > 0").select(_text(F.col("name"), " - ", F.col("region")).alias("label"), (F.col("n_nationkey") * 1000).alias("population"))
    return tables.municipalities(n.select("name", "region"), population, ("R0", "R1", "R2")).select("name", "region", "key", F.col("population").cast("long").alias("population"))


@query("""WITH c AS (SELECT c_custkey AS idx, 's' || (c_custkey % 4) AS source, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS builder, CASE WHEN c_custkey % 5 = 0 THEN c_name END AS address FROM customer),
l AS (SELECT *, (builder IS NULL)::INT + (address IS NULL)::INT AS lack FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lack DESC, idx) AS r FROM l WHERE lack > 0),
t AS (SELECT idx FROM r WHERE r <= 4 ORDER BY lack DESC, idx LIMIT 12)
SELECT c.idx, coalesce(c.builder, CASE WHEN t.idx IS NOT NULL THEN 'detail ' || c.idx END) AS builder, coalesce(c.address, CASE WHEN t.idx IS NOT NULL AND c.idx % 2 = 0 THEN 'street ' || c.idx END) AS address,
  CASE WHEN t.idx IS NULL THEN '' ELSE concat_ws(',', CASE WHEN c.builder IS NULL THEN 'builder' END, CASE WHEN c.address IS NULL AND c.idx % 2 = 0 THEN 'address' END) END AS filled FROM c LEFT JOIN t ON t.idx = c.idx""")
def filled_candidates(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k.alias("idx"), _text("s", k % 4).alias("source"), _text("u", k).alias("url"), F.when(k % 3 == 0, F.col("c_name")).alias("builder"), F.when(k % 5 == 0, F.col("c_name")).alias("address"))
    details = c.select("url", _text("detail ", F.col("idx")).alias("builder"), F.when(F.col("idx") % 2 == 0, _text("street ", F.col("idx"))).alias("address"))
    return lookup.enrich_candidates(c, details, ["builder", "address"]).select("idx", "builder", "address", F.array_join("filled", ",").alias("filled"))


@query("""WITH g AS (SELECT part AS root, CASE part % 3 WHEN 0 THEN 'same_building' WHEN 1 THEN 'same_place' ELSE 'same_name' END AS level, count(*) AS n, max(price_m2) / min(price_m2) <= 1.3 AS even FROM listing GROUP BY 1)
SELECT level, count(*) AS groups, sum(n)::BIGINT AS listings, round(avg(even::INT), 4) AS even, least(20, max(n)) AS largest FROM g GROUP BY 1""", listing=True)
def levels_of_groups(spark, sf):
    rows, k = listings(spark, sf), F.col("part")
    level = F.when(k % 3 == 0, "same_building").when(k % 3 == 1, "same_place").otherwise("same_name")
    return grouping.level_metrics(rows, rows.select("idx", k.alias("root"), level.alias("level"), F.lit("confirmed").alias("link")).distinct())


@query("""WITH e AS (SELECT event_id % 97 + 1 AS page FROM events), s AS (SELECT event_type AS source, count(*) AS now, count(*) FILTER (user_id % 2 = 0) AS before FROM events GROUP BY 1)
SELECT 'pages' AS what, count(DISTINCT page)::VARCHAR AS value, max(page) >= 97 AS flag FROM e UNION ALL SELECT source, CASE WHEN source = 'click' THEN 'missing' WHEN before >= 0.8 * now THEN 'ok' ELSE 'fell' END, NULL FROM s""")
def source_runs(spark, sf):
    """Pages that brought rows, and sources' rows now against before; one source has gone."""
    e = table(spark, sf, "events")
    stats = paged.paging_stats(e.select((F.col("event_id") % 97 + 1).cast("int").alias("page")), 97).select(F.lit("pages").alias("what"), F.col("pages").cast("string").alias("value"), F.col("hit_cap").alias("flag"))
    runs = lambda df: df.groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("rows"))
    compared = paged.compare_runs(runs(e), runs(e.filter("user_id % 2 = 0 AND event_type <> 'click'")))
    return stats.unionByName(compared.select(F.col("source").alias("what"), F.col("verdict").alias("value"), F.lit(None).cast("boolean").alias("flag")))
