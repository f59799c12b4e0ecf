"""Queries of text, number, calendar and JSON expressions and of small operators: texts are made from the tables' rows, and the SQL says from the
same rows what has to come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nested, numbers, text
from ..operators import export, grouping, history, lookup, quality, stats
from ..schema import FIRST_OWN_ID, union_sources
from .listing import listings, observations, table
from .registry import query


def _part(spark, sf) -> DataFrame:
    return table(spark, sf, "part").withColumn("k", F.col("p_partkey"))


def pick(k: Column, *values) -> Column:
    """The value whose place is k modulo their number."""
    return F.get(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (k % len(values)).cast("int"))


# text


@query("""SELECT p_partkey AS id, ['avenida ', 'rua ', 'praca doutor ', 'sitio ', NULL][p_partkey % 5 + 1] || replace(p_name, ' rod', ' rodovia') AS street,
CASE WHEN p_partkey % 5 IN (0, 1, 3) AND p_partkey % 90 > 0 THEN (p_partkey % 90)::VARCHAR END AS number FROM part""")
def streets(spark, sf):
    p, n = _part(spark, sf), (F.col("k") % 90).cast("string")
    address = pick(F.col("k"), F.concat(F.lit("Av. "), F.initcap("p_name"), F.lit(", 00"), n), F.concat(F.lit("R. da "), F.upper("p_name"), F.lit(", nº "), n, F.lit(", Centro")), F.concat(F.lit("Pça. Dr. "), F.col("p_name"), F.lit(", s/n")), F.concat(F.lit("Sítio "), F.col("p_name"), F.lit(" "), n), F.lit(" , "))
    a = text.street_and_number(address)
    return p.select(F.col("k").alias("id"), a["street"].alias("street"), a["number"].alias("number"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE regexp_replace(p_name, '^new ', '') || ' towers' END AS phrase, contains(p_name, 'widget') AND p_partkey % 3 <> 2 AS said,
CASE WHEN p_partkey % 4 <> 0 THEN contains(p_name, 'small') OR contains('small', p_name) END AS either FROM part""")
def phrases(spark, sf):
    name = pick(F.col("k"), F.concat(F.lit("Residencial "), F.initcap("p_name"), F.lit(" Towers")), F.concat(F.lit("Ed. Condomínio "), F.upper("p_name"), F.lit(" TOWERS")), F.lit("Apto ab"))
    found = text.phrase(name)
    either = text.contains_either(F.when(F.col("k") % 4 != 0, F.col("p_name")), F.lit("small"))
    return _part(spark, sf).select(F.col("k").alias("id"), found.alias("phrase"), F.coalesce(text.mentions(found, F.lit("widget towers")), F.lit(False)).alias("said"), either.alias("either"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_partkey * 1000 + 0.5 WHEN 1 THEN p_partkey * 1000 ELSE NULL END::DOUBLE AS price, (p_partkey % 300 + 0.25)::DOUBLE AS area FROM part""")
def numbers_in_text(spark, sf):
    k = F.col("k")
    money = F.replace(F.format_number(k * 1000, 0), F.lit(","), F.lit("."))
    price = pick(k, F.concat(F.lit("R$ "), money, F.lit(",50")), F.concat(F.lit("a partir de "), money, F.lit(" reais.")), F.lit("sob consulta"))
    area = F.concat((k % 300).cast("string"), F.lit(",25 m2"))
    return _part(spark, sf).select(k.alias("id"), text.to_number(price).alias("price"), text.area_number(area).cast("double").alias("area"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'tower' WHEN 1 THEN CASE WHEN p_partkey % 13 >= 5 THEN 'tower' WHEN p_partkey % 13 >= 1 THEN 'probable_block' ELSE 'undefined' END WHEN 2 THEN 'tower' ELSE 'undefined' END AS kind,
CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS launch FROM part""")
def building_kinds(spark, sf):
    k = F.col("k")
    have = F.when(k % 4 == 0, F.array(F.lit("Piscina"), F.lit("Elevador"))).otherwise(F.array(F.lit("Portaria")))
    said = pick(k, F.lit("vista"), F.concat(F.lit("no "), (k % 13).cast("string"), F.lit("º andar")), F.lit("prédio com 2 elevadores"), F.lit(None).cast("string"))
    flag = text.launch_flag(F.lit("https://x.y/imovel"), pick(k, F.lit("Pronto? Não: na planta"), F.lit("apartamento usado"), F.lit("bom")))
    return _part(spark, sf).select(k.alias("id"), text.building_type(have, said).alias("kind"), flag.alias("launch"))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 THEN p_brand || CASE WHEN p_partkey % 3 = 2 THEN ', ' || p_size ELSE '' END WHEN p_size IS NOT NULL THEN p_size::VARCHAR END AS address,
CASE WHEN p_partkey % 2 = 0 THEN 'Fortaleza' ELSE p_type END AS municipality, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'Centro' END AS district, lower(p_type) AS city, 'CE' AS region FROM part""")
def address_parts(spark, sf):
    k = F.col("k")
    address = text.join_address(F.when(k % 3 > 0, F.concat(F.lit(" "), F.col("p_brand"), F.lit(" "))).otherwise(F.lit(" ")), F.when(k % 3 != 1, F.col("p_size").cast("string")))
    both = text.municipality_and_district(F.when(k % 2 == 0, F.concat(F.lit("Fortaleza, "), F.col("p_type"))).otherwise(F.concat(F.lit("Centro, "), F.col("p_type"))), F.lit("FORTALEZA"))
    place = text.city_and_region(F.concat(F.col("p_type"), pick(k, ", ce", " - CE ")))
    return _part(spark, sf).select(k.alias("id"), address.alias("address"), both["municipality"].alias("municipality"), both["district"].alias("district"), place["city"].alias("city"), place["region"].alias("region"))


@query("""SELECT p_partkey AS id, upper(p_type[1]) || lower(p_type[2:]) || ' · A, b · R$ ' || format('{:,}', p_partkey + 1) || ' – R$ ' || format('{:,}', p_partkey + 900) || CASE WHEN p_size % 3 > 0 THEN ' · ' || (p_size % 3) || ' rooms' ELSE '' END AS label,
'https://x.y/?a=1&token=***&b=' || p_partkey AS safe, 'https://x.y?size=' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '&name=' || replace(p_name, ' ', '+') ELSE '' END AS asked, upper(p_type[1]) || lower(p_type[2:]) AS shown, 'ABC' AS short FROM part""")
def labels_and_paths(spark, sf):
    k = F.col("k")
    label = text.search_label(F.initcap("p_type"), F.array(F.lit("A"), F.lit("b")), k + 1, k + 900, F.col("p_size") % 3)
    safe = text.without_secrets(F.concat(F.lit("https://x.y/?a=1&token=s3cr"), k, F.lit("&b="), k))
    asked = text.query_path(F.lit("https://x.y"), size=F.col("p_size"), name=F.when(k % 2 == 0, F.col("p_name")), none=F.lit(None))
    return _part(spark, sf).select(k.alias("id"), label.alias("label"), safe.alias("safe"), asked.alias("asked"), F.initcap("p_type").alias("shown"), text.capitalised(F.lit("ABC")).alias("short"))


@query("""SELECT n_nationkey AS id, 'Vila das Flores Nation ' || n_nationkey AS name, 'Parque de Nation ' || n_nationkey AS launch, CASE WHEN n_nationkey % 2 = 0 THEN 'Jardim X' || chr((97 + n_nationkey)::INT) END AS district FROM nation""")
def slugs(spark, sf):
    k, slug = F.col("n_nationkey"), text.slug(F.col("n_name"))
    url = F.concat(F.lit("https://x.y/venda-apartamento-jardim-x"), F.char(97 + k), F.when(k % 2 == 0, F.lit("-Sao-Paulo")).otherwise(F.lit("-recife")), F.lit("?z=1"))
    launch = text.launch_name(F.concat(F.lit("https://x.y/lancamento-parque-de-"), slug, F.lit("/?q")))
    district = text.district_from_slug(url, F.lit("São Paulo"))
    return table(spark, sf, "nation").select(k.alias("id"), text.slug_to_name(F.concat(F.lit("vila-das-flores-"), slug)).alias("name"), F.concat(launch, F.lit(" "), k).alias("launch"), district.alias("district"))


@query("""SELECT c_custkey AS id, 'one|' || c_mktsegment || '|Two' AS names FROM customer""")
def split_names(spark, sf):
    values = F.array(F.lit("one, ONE ,, Óne"), F.concat(F.col("c_mktsegment"), F.lit(" ,Two")), F.lower("c_mktsegment"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.array_join(text.split_names(values), "|").alias("names"))


@query("""SELECT p_partkey AS id, (p_partkey % 4 IN (0, 3))::INT::DOUBLE AS alike, (p_partkey % 4 = 3)::INT::DOUBLE AS sorted_alike FROM part""")
def similarities(spark, sf):
    k, name = F.col("k"), F.col("p_name")
    words = F.split(name, " ")
    turned = F.concat_ws(" ", F.get(words, F.lit(1)), F.get(words, F.lit(0)))
    other = F.when(k % 4 == 0, name).when(k % 4 == 1, F.lit("")).when(k % 4 == 2, F.lit("0123456789" * 8)).otherwise(name)
    return _part(spark, sf).select(k.alias("id"), text.similarity(name, other, 0.6).alias("alike"), F.when(k % 4 == 3, text.name_similarity(name, turned)).otherwise(0.0).alias("sorted_alike"))


@query("""WITH s AS (SELECT p_partkey AS id, length(p_name)::DOUBLE AS n, length(p_partkey::VARCHAR)::DOUBLE AS d FROM part), r AS (SELECT *, 2 * n / (2 * n + d) AS longer FROM s)
SELECT id, round(longer, 12) AS longer, round(greatest(n, d) / (n + d), 12) AS turned, round(CASE WHEN longer >= 0.85 THEN longer ELSE 0 END, 12) AS at_least, round(2 * n / (2 * n + 2 * d), 12) AS both_ends FROM r""")
def similarity_ratios(spark, sf):
    """Ratios strictly between 0 and 1: a name against itself with digits after it, with the two parts turned, and with other digits on either side."""
    name, digits = F.col("p_name"), F.col("k").cast("string")
    other = F.translate(digits, "0123456789", "ABCDEFGHIJ")
    ratio = lambda a, b, least=0.0: F.round(text.similarity(a, b, least), 12)
    return _part(spark, sf).select(
        F.col("k").alias("id"), ratio(name, F.concat(name, digits)).alias("longer"), ratio(F.concat(name, digits), F.concat(digits, name)).alias("turned"),
        ratio(name, F.concat(digits, name), 0.85).alias("at_least"), ratio(F.concat(name, digits), F.concat(other, name)).alias("both_ends"),
    )


# numbers and time


@query("""SELECT DISTINCT strftime(o_orderdate, '%Y-W%W') AS week, greatest(date_trunc('week', o_orderdate)::DATE, make_date(year(o_orderdate), 1, 1)) AS first, least((date_trunc('week', o_orderdate) + INTERVAL 6 DAY)::DATE, make_date(year(o_orderdate), 12, 31)) AS last FROM orders""")
def week_days(spark, sf):
    week = numbers.week_label(F.col("o_orderdate"))
    days = table(spark, sf, "orders").select(week.alias("week")).distinct().withColumn("b", numbers.week_bounds(F.col("week")))
    return days.select("week", "b.first", "b.last")


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN ts END, TIMESTAMP '2024-01-10') AS at, ts < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 90 MINUTE AS old,
least(greatest(value, 20.0), 80.0) AS held, round(value * (1 - least(0.2, 0.05 * (event_id % 7))), 9) AS penalised FROM events""")
def times_and_bounds(spark, sf):
    e = table(spark, sf, "events")
    at = numbers.event_time(F.when(F.col("event_id") % 2 == 0, F.col("ts")), F.lit("2024-01-10").cast("timestamp_ntz"))
    imputed = F.slice(F.sequence(F.lit(1), F.lit(7)), F.lit(1), (F.col("event_id") % 7).cast("int"))
    return e.select("event_id", at.alias("at"), numbers.older_than(F.col("ts"), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"), 90).alias("old"), numbers.clamp(F.col("value"), 20.0, 80.0).alias("held"), F.round(numbers.imputation_penalty(F.col("value"), imputed), 9).alias("penalised"))


@query("""SELECT c_custkey AS id, lat BETWEEN -34 AND 6 AND lng BETWEEN -74.5 AND -28.5 AS inside, z BETWEEN 0 AND 20 AND x >= 0 AND x < pow(2, z) AND y >= 0 AND y < pow(2, z) AS tile
FROM (SELECT c_custkey, c_acctbal / 100 - 50 AS lat, -c_acctbal / 100 AS lng, c_custkey % 23 - 1 AS z, c_custkey % 70 AS x, c_nationkey AS y FROM customer)""")
def boxes_and_tiles(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    return c.select(k.alias("id"), numbers.in_box(F.col("c_acctbal") / 100 - 50, -F.col("c_acctbal") / 100).alias("inside"), numbers.tile_exists(k % 23 - 1, k % 70, F.col("c_nationkey")).alias("tile"))


# JSON


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a|' || event_type ELSE '' END AS texts, 'Pool|' || event_type AS amenities, 'https://b.test/1.jpg|https://c.test/' || event_id || '.jpg|https://b.test/870x653.png' AS photos,
json_extract_string(props, '$.k') AS first_named, CASE WHEN user_id % 2 = 0 THEN event_type END AS streamed FROM events""")
def json_parts(spark, sf):
    k = F.col("event_id")
    texts = F.when(k % 3 == 0, F.concat(F.lit('["a", "'), F.col("event_type"), F.lit('"]'))).when(k % 3 == 1, F.lit("no json")).otherwise(F.lit('{"a": 1}'))
    have = F.concat(F.lit('[{"name": "Pool"}, "'), F.col("event_type"), F.lit('"]'))
    shown = F.concat(F.lit('["/1.jpg", {"url": "//c.test/'), k, F.lit('.jpg"}, "/logo.png", "/1.jpg", "https://x.test/{other}.png", "/{width}x{height}.png"]'))
    stream = F.concat(F.lit('<script>self.__next_f.push([1,"'), F.lit('\\"")])').substr(F.lit(1), F.lit(0)), F.col("event_type"), F.lit('"])</script>'))
    streamed = nested.undefined_null(F.when(F.col("user_id") % 2 == 0, nested.streamed_text(stream)).otherwise(F.lit("$undefined")))
    return table(spark, sf, "events").select("event_id", F.array_join(nested.json_strings(texts), "|").alias("texts"), F.array_join(nested.amenities(have), "|").alias("amenities"), F.array_join(nested.photo_urls(shown, F.lit("https://b.test")), "|").alias("photos"), nested.first_present(F.try_parse_json("props"), "none", "k").alias("first_named"), streamed.alias("streamed"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS kind, 3::BIGINT AS n, event_type || '|' || event_id AS graph FROM events""")
def json_maps(spark, sf):
    entry = lambda name, value: F.struct(F.lit(name).cast("string").alias("name"), value.cast("string").alias("value"))
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "string")
    made = nested.property_map(F.array(entry("k", F.lit("old")), entry("kind", F.col("event_type")), entry(None, F.lit("x")), entry("none", F.lit(None)), entry("k", k)))
    page = F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"v": "'), F.col("event_type"), F.lit('"}, {"v": "'), F.col("event_id"), F.lit('"}]}</script>'))
    items = nested.graph_items(F.get(nested.json_blocks(page), F.lit(0)))
    rows = table(spark, sf, "events").select("event_id", made.alias("m"), F.array_join(F.transform(items, lambda v: nested.first_present(v, "v")), "|").alias("graph"))
    return rows.select("event_id", F.col("m")["k"].alias("k"), F.col("m")["kind"].alias("kind"), F.size("m").cast("long").alias("n"), "graph")


# rules and small operators

TITLES = "CASE part % 6 WHEN 0 THEN 'Aluguel de flat' WHEN 1 THEN 'Flats de 40 a 60 m²' WHEN 2 THEN 'R$ 1.000' ELSE title END"


@query(f"""WITH t AS (SELECT idx, {TITLES} AS t, part % 6 AS c, part % 5 AS b, price, area, price_m2, rooms FROM listing)
SELECT idx, CASE WHEN c = 0 THEN 'rental' WHEN price < 20000 THEN 'not_a_total_price' WHEN c = 1 THEN 'area_range' WHEN b = 4 AND c <> 0 THEN 'area_range' WHEN c = 2 THEN 'bad_title' WHEN NOT area BETWEEN 15 AND 500 THEN 'implausible_area'
 WHEN NOT price_m2 BETWEEN 1000 AND 40000 THEN 'implausible_price_m2' WHEN rooms <> 3 THEN 'other_rooms' WHEN b < 3 THEN 'other_baths' WHEN price < 30000 * 0.9 THEN 'outside_price_range' END AS reason FROM t""", listing=True)
def every_reason(spark, sf):
    rows = listings(spark, sf).withColumns({"title": F.expr(TITLES), "descr": F.when(F.col("part") % 5 == 4, "de 30 - 45 m2, piscina"), "baths": (F.col("part") % 5 + 1).cast("int"), "url": F.lit("https://x.y/flat")})
    return quality.with_reason(rows, {"rooms": 3, "baths": 4, "price_min": 30000}).select("idx", F.col("reject_reason").alias("reason"))


@query("""SELECT CASE WHEN reason LIKE 'duplicate%' THEN 'duplicates' ELSE 'rules' END AS kind, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN rooms = 2 THEN 'duplicate_url' WHEN rooms = 3 THEN 'no_price' ELSE 'outlier' END AS reason, 2 * count(*) AS n FROM listing WHERE rooms IS NOT NULL GROUP BY 1) GROUP BY 1""", listing=True)
def discards_by_kind(spark, sf):
    rows = listings(spark, sf).filter("rooms IS NOT NULL").withColumn("reject_reason", F.when(F.col("rooms") == 2, "duplicate_url").when(F.col("rooms") == 3, "no_price").otherwise("outlier"))
    once = quality.funnel(rows)
    return quality.funnel_kinds(quality.combined_funnel(once, once))


@query("""WITH t AS (SELECT idx, price, CASE part % 3 WHEN 0 THEN 'tower' WHEN 1 THEN 'probable_block' END AS b, rooms FROM listing)
SELECT count(*) FILTER (b = 'tower') AS towers, count(*) FILTER (coalesce(b, 'undefined') = 'undefined') AS undefined, count(*) FILTER (price BETWEEN 20000 AND 40000 AND coalesce(rooms = 2, true)) AS residual FROM t""", listing=True)
def type_and_residual(spark, sf):
    rows = listings(spark, sf).withColumn("building_type", F.when(F.col("part") % 3 == 0, "tower").when(F.col("part") % 3 == 1, "probable_block"))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(quality.of_type(rows, "tower"), "towers").crossJoin(n(quality.of_type(rows, "undefined", null_as="undefined"), "undefined")).crossJoin(n(rows.filter(quality.residual(20000, 40000, 2)), "residual"))


@query("""SELECT city, lower(district) AS key, district AS name FROM (SELECT city, district, part % 4 AS o FROM listing) WHERE o < 2 AND district <> 'NATION_3' GROUP BY ALL""", listing=True)
def trusted_districts(spark, sf):
    rows = listings(spark, sf).withColumns({"coord_origin": pick(F.col("part"), "exact", "source_approximate", "district_centroid", F.lit(None).cast("string")), "district": F.when(F.col("district") == "NATION_3", "Zona Rural").otherwise(F.col("district"))})
    return quality.trusted_districts(rows)


@query("SELECT idx FROM listing WHERE contains(title, 'small') AND contains(title, 'widget')", listing=True)
def said_in_texts(spark, sf):
    return quality.said_in(listings(spark, sf).withColumn("descr", F.lit("Boa vista")), "Widget SMÁLL vista").select("idx")


@query("""SELECT idx, (CASE WHEN part % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN part % 3 = 0 THEN 2 ELSE 0 END + 2 + (rooms IS NOT NULL)::INT)::INT AS fullness FROM listing""", listing=True)
def fullness_weights(spark, sf):
    return _full(spark, sf).select("idx", quality.fullness().cast("int").alias("fullness"))


def _full(spark, sf) -> DataFrame:
    k = F.col("part")
    photos = F.when(k % 2 == 0, F.array_repeat(F.lit("p"), (k % 5 + 1).cast("int")))
    return listings(spark, sf).withColumns({"photos": photos, "coord_origin": F.when(k % 3 == 0, "exact").otherwise("district_centroid"), "address": F.lit("Rua A"), "baths": F.lit(None).cast("int"), "parking": F.lit(None).cast("int"), "descr": F.lit("")})


@query("""SELECT source, count(*) AS n, count(*) FILTER (part % 2 = 0) AS with_photo, round(avg(CASE WHEN part % 2 = 0 THEN part % 5 + 1 END), 2) AS mean_photos FROM listing GROUP BY 1""", listing=True)
def photo_means(spark, sf):
    return quality.photo_means(_full(spark, sf))


@query("""WITH v AS (SELECT * FROM listing WHERE price >= 20000), r AS (SELECT * FROM v WHERE rooms = 2), d AS (SELECT district, count(*) AS n FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT 'raw' AS stage, NULL AS name, count(*) AS n FROM listing UNION ALL SELECT 'valid', NULL, count(*) FROM v UNION ALL SELECT 'refined', NULL, count(*) FROM r UNION ALL SELECT 'district', district, n FROM d""", listing=True)
def survival(spark, sf):
    rows = listings(spark, sf).withColumn("reject_reason", F.when(F.col("price") < 20000, "not_a_total_price"))
    return quality.survival(rows, rows, rows.filter("reject_reason IS NULL AND rooms = 2"))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def most_common_values(spark, sf):
    return quality.most_common(table(spark, sf, "part"), "p_type", 3)


@query("""SELECT n_nationkey AS id, n_name AS name FROM nation WHERE contains(lower(n_name), 'n_1') AND n_name NOT IN ('NATION_1', 'NATION_12') ORDER BY NOT starts_with(lower(n_name), 'n_1'), n_nationkey LIMIT 12""")
def suggestions(spark, sf):
    return lookup.suggest(table(spark, sf, "nation"), "n_name", "N_1", 12, ("Nation_1", "nation_12"), "n_nationkey").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


@query("""WITH s AS (SELECT idx, part, price, area, price_m2, (CASE WHEN part % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN part % 3 = 0 THEN 2 ELSE 0 END + 2 + (rooms IS NOT NULL)::INT) AS f FROM listing)
SELECT * FROM (SELECT 'area' AS by_, idx FROM s ORDER BY area DESC, price_m2, idx LIMIT 20) UNION ALL SELECT * FROM (SELECT 'fullness', idx FROM s ORDER BY f DESC, price_m2, idx LIMIT 20) UNION ALL SELECT * FROM (SELECT 'price', idx FROM s ORDER BY price, price_m2, idx LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'best', idx FROM s ORDER BY part % 7 DESC, price_m2, idx LIMIT 20)""", listing=True)
def card_orders(spark, sf):
    rows = _full(spark, sf).withColumn("score", (F.col("part") % 7).cast("double"))
    first = lambda df, name: df.limit(20).select(F.lit(name).alias("by_"), "idx")
    return first(lookup.sort_cards(rows, "area", True), "area").unionByName(first(lookup.sort_cards(rows, "fullness", True), "fullness")).unionByName(first(lookup.sort_cards(rows), "price")).unionByName(first(lookup.best_first(rows), "best"))


@query("""SELECT idx, CASE WHEN price_m2 / 1000 - 1 < -0.08 THEN 'below' WHEN price_m2 / 1000 - 1 > 0.08 THEN 'above' ELSE 'within' END AS colour FROM (SELECT * FROM listing ORDER BY price_m2, idx LIMIT 24)""", listing=True)
def chart_bars(spark, sf):
    return lookup.chart_bars(listings(spark, sf), 1000.0).select("idx", "colour")


@query("""SELECT c_custkey AS id, c_acctbal AS lat, CASE WHEN c_custkey % 2 = 0 THEN 'Rua ' || c_custkey END AS street, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey::VARCHAR END AS number, c_mktsegment AS district, 'Town' AS city, c_custkey % 3 = 0 AS precise FROM customer""")
def geocoder_answers(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    road = F.when(k % 2 == 0, F.concat(F.lit('"road": "Rua '), k, F.lit('", '))).otherwise(F.lit(""))
    number = F.when(k % 3 == 0, F.concat(F.lit('"house_number": "'), F.col("c_nationkey"), F.lit('", '))).otherwise(F.lit(""))
    body = F.concat(F.lit('[{"lat": "'), F.col("c_acctbal").cast("decimal(12,2)"), F.lit('", "lon": "1", "address": {'), road, number, F.lit('"neighbourhood": "'), F.col("c_mktsegment"), F.lit('", "town": "Town"}}]'))
    return lookup.geocoded(c.withColumn("body", body)).select(k.alias("id"), "lat", "street", "number", "district", "city", "precise")


@query("""WITH r AS (SELECT district, count(*) AS n, min(idx) AS f FROM listing WHERE part % 2 = 0 GROUP BY 1) SELECT arg_min(district, (-n, f)) AS district FROM r""", listing=True)
def dominant_district(spark, sf):
    rows = listings(spark, sf)
    return lookup.dominant_district(rows.withColumn("district", F.lit(None).cast("string")), rows.filter("part % 2 = 0"), rows)


@query("""WITH m AS (SELECT part % 40 AS root, idx, CASE WHEN part % 3 = 0 THEN upper(title) ELSE title END AS t, title AS k, CASE WHEN part % 4 = 0 THEN 'Rua A, ' || rooms ELSE 'Rua A' END AS a, part % 4 = 0 AND rooms IS NOT NULL AS numbered, part % 5 = 0 AS p FROM listing),
k AS (SELECT root, arg_max(k, (n, -f)) AS k FROM (SELECT root, k, count(*) AS n, min(idx) AS f FROM m GROUP BY 1, 2) GROUP BY 1),
n AS (SELECT root, arg_max(t, (n, -f)) AS name FROM (SELECT m.root, t, count(*) AS n, min(idx) AS f FROM m JOIN k ON m.root = k.root AND m.k = k.k GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT root, arg_max(a, (h, n, -f)) AS address FROM (SELECT root, a, max(numbered::INT) AS h, count(*) AS n, min(idx) AS f FROM m WHERE a IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT root, 'p' || arg_min(idx, idx) AS photo FROM m WHERE p GROUP BY 1)
SELECT root, name, address, photo FROM n LEFT JOIN a USING (root) LEFT JOIN p USING (root)""", listing=True)
def display_names(spark, sf):
    k = F.col("part")
    address = F.when(k % 4 == 0, F.concat(F.lit("Rua A, "), F.col("rooms"))).otherwise(F.lit("Rua A"))
    rows = listings(spark, sf).withColumns({"root": k % 40, "name_key": F.col("title"), "dev_name": F.when(k % 3 == 0, F.upper("title")).otherwise(F.col("title")), "address": address, "number": F.when(k % 4 == 0, F.col("rooms").cast("string")), "photos": F.when(k % 5 == 0, F.array(F.lit(" "), F.concat(F.lit("p"), F.col("idx"))))})
    return grouping.display_names(rows)


# stored rows


@query("""SELECT city, count(*) AS n, round(avg(value), 2) AS mean FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'Santos' ELSE 'SANTOS' END AS city, o_totalprice AS value, o_orderkey % 4 AS rooms FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 3 <> 2) WHERE rooms = 2 GROUP BY 1""")
def history_of_a_city(spark, sf):
    searches = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("search_id"), F.when(F.col("c_custkey") % 3 == 2, "Recife").when(F.col("c_custkey") % 2 == 0, "Santos").otherwise("SANTOS").alias("city"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("search_id"), F.col("o_orderkey").alias("idx"), (F.col("o_orderkey") % 4).cast("int").alias("rooms"), F.col("o_totalprice").alias("price_m2"), F.concat(F.lit("u"), "o_orderkey").alias("url"), F.lit(None).cast("timestamp_ntz").alias("collected_at"), F.lit("x").alias("source"), F.lit("d").alias("district"))
    spellings = searches.select("city").distinct().filter(text.normalize(F.col("city")) == "santos")
    found = history.history_rows(o, searches, spellings, 2)
    return found.join(searches.select("search_id", F.col("city").alias("said")), "search_id").groupBy(F.col("said").alias("city")).agg(F.count("*").alias("n"), F.round(F.avg("price_m2"), 2).alias("mean"))


@query("""WITH b AS (SELECT c_custkey AS k, c_acctbal AS v, 1 AS step FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT o_custkey, o_totalprice, 2 FROM (SELECT o_custkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1)) SELECT k, arg_max(v, step) AS v, max(step) AS step FROM b GROUP BY 1""")
def upserted(spark, sf):
    old = table(spark, sf, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(1).alias("step"))
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v")).withColumn("step", F.lit(2))
    return stats.upsert(old, new, ["k"], "step")


@query("""SELECT district, week, CASE WHEN n >= 3 THEN mean END AS firm, CASE WHEN n < 3 THEN mean END AS weak FROM (SELECT event_type AS district, strftime(ts, '%Y-W%W') AS week, round(avg(value), 2) AS mean, count(*) AS n FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strftime(ts, '%Y-W%W'), user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn = 1) GROUP BY 1, 2)""")
def firm_and_weak(spark, sf):
    latest = history.latest_per_period(observations(spark, sf), "key", "seen_at", "idx")
    series = history.weekly_series(latest, "price_m2", ["district"])
    out = history.firm_values(series)
    names = [c for c in out.columns if c not in series.columns]
    return out.select("district", "week", F.col(names[0]).alias("firm"), F.col(names[1]).alias("weak"))


@query("""SELECT source, count(*) AS n, count(DISTINCT source || url) AS urls, bool_and(price > 0) AS priced, 0::BIGINT AS blank FROM listing GROUP BY 1""", listing=True)
def united_sources(spark, sf):
    rows = listings(spark, sf).drop("idx").withColumns({"price": F.col("price").cast("string"), "zip": F.lit("  ")})
    united = union_sources([rows.filter("source = 's0'"), rows.filter("source <> 's0'").drop("title")])
    assert_ids = F.count_distinct("idx") == F.count("*")
    per = united.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct(F.concat("source", "url")).alias("urls"), F.bool_and(F.col("price") > 0).alias("priced"), F.count("zip").alias("blank"), (assert_ids & (F.min("idx") >= FIRST_OWN_ID)).alias("ok"))
    return per.filter("ok").drop("ok")


@query("""SELECT 'band' AS name, 0.1::DOUBLE AS value UNION ALL SELECT 'reference_price', 1200.0""")
def workbook_parameters(spark, sf):
    return export.parameters_table(spark, 1200.0)


@query("""WITH g AS (SELECT part AS id, CASE part % 3 WHEN 0 THEN 'same_building' WHEN 1 THEN 'same_place' ELSE 'same_name' END AS level, title, count(*) AS n, round(avg(price_m2), 2) AS mean, min(area) AS lo, max(area) AS hi FROM listing GROUP BY ALL)
SELECT 'group' AS what, id::VARCHAR AS name, n, round(mean / 1234.567 - 1, 4) AS vs_mean, CASE WHEN lo = hi THEN format('{:,.0f}', lo) ELSE format('{:,.0f}', lo) || '–' || format('{:,.0f}', hi) END AS areas FROM g WHERE level = 'same_place'
UNION ALL SELECT 'level', level, CAST(sum(n) AS BIGINT), NULL, NULL FROM g GROUP BY level""", listing=True)
def workbook_groups(spark, sf):
    k = F.col("part")
    rows = listings(spark, sf).groupBy(k, "title").agg(F.count("*").alias("n_listings"), F.round(F.avg("price_m2"), 2).alias("mean"), F.min("area").cast("double").alias("area_low"), F.max("area").cast("double").alias("area_high"), F.sort_array(F.collect_set("source")).alias("sources"))
    groups = rows.withColumns({"group_id": k.cast("string"), "level": pick(k, "same_building", "same_place", "same_name"), "name_key": F.col("title"), "n_probable": F.lit(0), "n_units": F.lit(1), "median": F.col("mean")})
    sheet = export.groups_table(groups, "same_place", 1234.567).select(F.lit("group").alias("what"), F.col("group_id").alias("name"), F.col("n_listings").alias("n"), "vs_mean", "areas")
    return sheet.unionByName(export.group_counts(groups).select(F.lit("level").alias("what"), F.col("level").alias("name"), F.col("listings").alias("n")), allowMissingColumns=True)
