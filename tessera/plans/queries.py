"""The registered queries of the listing operators on the bundled tables, each with the SQL that says the same (where SQL can)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Pairing, Rules
from ..functions import numbers, text
from ..operators import dedup, export, grouping, history, lookup, pairs, quality, refine, stats
from . import cases, identity_cases, source_cases  # noqa: F401  register their queries
from .listing import listings, observations, table
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401

WEEK = "strftime({}, '%Y-W%W')"


# history

LATEST = """
o AS (SELECT event_id AS idx, user_id AS key, event_type AS district, value AS price_m2, ts AS seen_at, strftime(ts, '%Y-W%W') AS week FROM events),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY week, key ORDER BY seen_at DESC, idx) AS rn FROM o) WHERE rn = 1)
"""


@query(f"WITH {LATEST} SELECT district, week, round(avg(price_m2), 2) AS mean, round(median(price_m2), 9) AS median, count(*) AS n, count(*) < 3 AS low_confidence FROM l GROUP BY 1, 2")
def weekly_series(spark, sf):
    return history.weekly_series(history.latest_per_period(observations(spark, sf), "key", "seen_at", "idx"), "price_m2", ["district"], digits=9)


@query(f"WITH {LATEST} SELECT week, round(avg(price_m2), 2) AS mean, round(median(price_m2), 9) AS median, count(*) AS n, count(*) < 3 AS low_confidence FROM l GROUP BY 1")
def weekly_city_series(spark, sf):
    return history.weekly_series(history.latest_per_period(observations(spark, sf), "key", "seen_at", "idx"), "price_m2", [], digits=9)


@query(f"WITH {LATEST} SELECT week, {', '.join(f'round(avg(price_m2) FILTER (district = {chr(39)}{d}{chr(39)}), 2) AS {d}' for d in ('click', 'view', 'purchase'))} FROM l GROUP BY 1")
def weekly_pivot(spark, sf):
    return history.weekly_pivot(weekly_series(spark, sf), "district", "mean", ["click", "view", "purchase"])


@query(f"WITH {LATEST} SELECT week, key, idx, district, price_m2, seen_at FROM l")
def latest_per_period(spark, sf):
    return history.latest_per_period(observations(spark, sf), "key", "seen_at", "idx").select("week", "key", "idx", "district", "price_m2", "seen_at")


@query("SELECT user_id AS key, arg_max(value, (ts, -event_id)) AS price_m2, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS sightings, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS districts FROM events GROUP BY 1")
def first_last_seen(spark, sf):
    seen = history.first_last_seen(observations(spark, sf), "key", "seen_at", "idx", "district")
    return seen.select("key", "price_m2", "first_seen", "last_seen", "sightings", F.array_join("district_seen", ",").alias("districts"))


@query("""WITH s AS (SELECT user_id AS key, arg_max(event_type, (ts, -event_id)) AS district, max(ts) AS last_seen FROM events GROUP BY 1),
c AS (SELECT district, max(last_seen) AS covered_until FROM s GROUP BY 1)
SELECT key, s.district, last_seen, covered_until, last_seen >= covered_until - INTERVAL 14 DAY AS active FROM s JOIN c USING (district)""")
def active_flag(spark, sf):
    seen = history.first_last_seen(observations(spark, sf), "key", "seen_at", "idx")
    return history.with_activity(seen, ["district"]).select("key", "district", "last_seen", "covered_until", "active")


@query("SELECT district, covered_until FROM (SELECT event_type AS district, max(ts) AS covered_until FROM events GROUP BY 1)")
def last_coverage(spark, sf):
    return observations(spark, sf).groupBy("district").agg(F.max("seen_at").alias("covered_until"))


@query("SELECT user_id AS key, event_id AS idx, rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn <= 5")
def last_n_per_key(spark, sf):
    return history.last_n(observations(spark, sf), "key", "seen_at", "idx", 5).select("key", "idx", F.col("rn").cast("long").alias("rn"))


@query(f"""WITH o AS (SELECT event_id AS idx, user_id AS key, event_type AS district, value AS price_m2, ts AS seen_at, strftime(ts, '%Y-W%W') AS week FROM events WHERE value > 0),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY week, key ORDER BY seen_at DESC, idx) AS rn FROM o) WHERE rn = 1),
v AS (SELECT district, count(DISTINCT key) AS volume FROM o GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6)
SELECT district, volume, week, round(avg(price_m2), 2) AS mean, round(median(price_m2), 9) AS median, count(*) AS n, count(*) < 3 AS low_confidence FROM l JOIN v USING (district) GROUP BY 1, 2, 3""")
def district_evolution(spark, sf):
    return history.district_evolution(observations(spark, sf), "key", "seen_at", "district", "price_m2", "idx", digits=9)


@query("""WITH r AS (SELECT user_id AS key, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS rate, count(*) AS tries FROM events GROUP BY 1)
SELECT c_custkey AS key, coalesce(rate, 0.5) AS rate, coalesce(tries, 0) AS tries FROM customer LEFT JOIN r ON key = c_custkey""")
def success_rate_prior(spark, sf):
    attempts = observations(spark, sf).select("key", (F.col("price_m2") > 50).alias("ok"))
    return stats.success_rate(table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), attempts, "key")


@query("""WITH s AS (SELECT l_partkey AS key, 's' || (l_suppkey % 5) AS source, l_extendedprice AS price, (l_orderkey * 10 + l_linenumber) * 10000000000 + l_partkey * 10000 + l_suppkey AS idx, year(l_shipdate) AS y FROM lineitem),
a AS (SELECT key, arg_max(price, idx) AS v, arg_max(source, idx) AS s FROM s WHERE y = 1997 GROUP BY 1), b AS (SELECT key, arg_max(price, idx) AS v, arg_max(source, idx) AS s FROM s WHERE y = 1996 GROUP BY 1),
r AS (SELECT DISTINCT source FROM s WHERE y = 1997),
j AS (SELECT a.key AS ka, b.key AS kb, (a.v - b.v) / nullif(b.v, 0) * 100 AS ch, b.s IN (SELECT source FROM r) AS answered FROM a FULL JOIN b ON a.key = b.key)
SELECT count(*) FILTER (kb IS NULL) AS new, count(*) FILTER (ch < -0.5) AS dropped, count(*) FILTER (ch > 0.5) AS raised, count(*) FILTER (ka IS NULL AND answered) AS gone FROM j""")
def snapshot_diff(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("key"), F.concat(F.lit("s"), F.col("l_suppkey") % 5).alias("source"), F.col("l_extendedprice").alias("price"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("idx"), F.year("l_shipdate").alias("y"))
    return history.snapshot_diff(rows.filter("y = 1997"), rows.filter("y = 1996"), "key", "price", "source", "idx")


@query("""SELECT o_orderkey AS search_id, lag(o_orderkey) OVER w AS previous_id, lag(o_orderdate) OVER w AS previous_at FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey)""")
def same_search_previous(spark, sf):
    return history.previous_same(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], "o_orderdate", "o_orderkey").select(F.col("o_orderkey").alias("search_id"), "previous_id", "previous_at")


@query("""WITH p AS (SELECT event_id, ts, lag(event_id) OVER w AS pid, lag(ts) OVER w AS pts FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT event_id AS search_id, coalesce(pts >= ts - INTERVAL 60 MINUTE, false) AS hit, CASE WHEN pts >= ts - INTERVAL 60 MINUTE THEN pid END AS answer_id FROM p""")
def asof_cache_hit(spark, sf):
    return history.cache_hits(observations(spark, sf), ["key", "district"], "seen_at", "idx").select(F.col("idx").alias("search_id"), "hit", "answer_id")


@query("""WITH s AS (SELECT user_id AS key, event_type = 'view' AS passive, arg_max(value, (ts, -event_id)) AS price, min(ts) AS first_seen FROM events GROUP BY 1, 2), h AS (FROM s WHERE passive), f AS (FROM s WHERE NOT passive)
SELECT coalesce(h.key, f.key) AS key, coalesce(f.price, h.price) AS price, least(h.first_seen, f.first_seen) AS first_seen FROM h FULL JOIN f ON h.key = f.key""")
def merge_collected(spark, sf):
    """What was seen in passing (views) and what was collected afterwards (all other events), by user."""
    seen = observations(spark, sf)
    side = lambda rows: history.first_last_seen(rows, "key", "seen_at", "idx").select("key", F.col("price_m2").alias("price"), "first_seen")
    return history.merge_collected(side(seen.filter("district = 'view'")), side(seen.filter("district <> 'view'")), "key")


@query("""SELECT key, arg_max(payload, read_at) AS payload, max(read_at) AS read_at FROM (SELECT user_id AS key, props AS payload, ts AS read_at, ts + INTERVAL 7 DAY AS expires_at FROM events WHERE event_type = 'view') WHERE expires_at > TIMESTAMP '2024-01-25' GROUP BY 1""")
def unexpired_cache(spark, sf):
    cache = table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("key"), F.col("props").alias("payload"), F.col("ts").alias("read_at"), (F.col("ts") + F.make_dt_interval(days=F.lit(7))).alias("expires_at"))
    return history.unexpired(cache, "view", F.lit("2024-01-25").cast("timestamp_ntz"))


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-W%W') AS week FROM orders")
def week_labels(spark, sf):
    return table(spark, sf, "orders").select(numbers.week_label(F.col("o_orderdate")).alias("week")).distinct()


# statistics


@query("SELECT count(price_m2) AS n, round(avg(price_m2), 2) AS mean, round(median(price_m2), 9) AS median, min(price_m2) AS low, max(price_m2) AS high FROM listing", listing=True)
def search_kpis(spark, sf):
    return stats.kpis(listings(spark, sf), digits=9)


@query("""SELECT requested, count(*) AS n, round(avg(price_m2), 2) AS mean, round(median(price_m2), 9) AS median, min(price_m2) AS low, max(price_m2) AS high
FROM listing JOIN (SELECT unnest(['NATION_1', 'Nation_2', 'nowhere']) AS requested) q ON contains(lower(district), lower(requested)) GROUP BY 1""", listing=True)
def district_summary(spark, sf):
    return stats.by_requested_district(listings(spark, sf), ["NATION_1", "Nation_2", "nowhere"], digits=9)


@query("""WITH g AS (SELECT city, rooms, median(price_m2) AS m, count(*) AS n FROM listing WHERE price_m2 > 0 GROUP BY 1, 2)
SELECT idx, round(m, 9) AS group_median, n AS group_n, n >= 3 AND NOT price_m2 BETWEEN m * 0.5 AND m * 1.8 AS outlier FROM listing l JOIN g ON l.city = g.city AND l.rooms IS NOT DISTINCT FROM g.rooms""", listing=True)
def outlier_band(spark, sf):
    return stats.outlier_band(listings(spark, sf), ["city", "rooms"]).select("idx", F.round("group_median", 9).alias("group_median"), "group_n", "outlier")


@query("""WITH p AS (SELECT round(lat, 5) AS lat, round(lng, 5) AS lng, price_m2, part % 2 = 0 AS e FROM listing)
SELECT lat, lng, count(*) AS n, round(median(price_m2), 9) AS median, bool_or(e) AS estimated FROM p GROUP BY 1, 2""", listing=True)
def map_pins(spark, sf):
    return stats.map_pins(listings(spark, sf).withColumn("coord_origin", F.when(F.col("part") % 2 == 0, "district_centroid").otherwise("exact")), digits=9)


@query("""WITH p AS (SELECT round(lat, 5) AS a, round(lng, 5) AS b, bool_or(part % 2 = 0) AS e FROM listing GROUP BY 1, 2) SELECT count(*) FILTER (NOT e) AS exact_pins, count(*) FILTER (e) AS estimated_pins FROM p""", listing=True)
def pin_counts(spark, sf):
    return stats.pin_counts(map_pins(spark, sf))


@query("""WITH x AS (SELECT idx, district, CASE WHEN idx % 3 <> 0 THEN lat END AS lat, CASE WHEN idx % 3 <> 0 THEN lng END AS lng FROM listing),
c AS (SELECT lower(district) AS k, avg(lat) AS a, avg(lng) AS b FROM x WHERE lat IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)
SELECT idx, round(coalesce(lat, a), 6) AS lat, round(coalesce(lng, b), 6) AS lng, CASE WHEN lat IS NULL AND a IS NOT NULL THEN 'district_centroid' WHEN lat IS NOT NULL THEN 'exact' END AS coord_origin FROM x LEFT JOIN c ON k = lower(district)""", listing=True)
def district_centroid_fill(spark, sf):
    known = F.col("idx") % 3 != 0
    rows = listings(spark, sf).withColumns({"lat": F.when(known, F.col("lat")), "lng": F.when(known, F.col("lng")), "coord_origin": F.when(known, "exact")})
    return stats.fill_centroids(rows).select("idx", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "coord_origin")


@query("""WITH c AS (SELECT city, builder, count(*) AS n, min(idx) AS f FROM listing GROUP BY 1, 2) SELECT city, arg_max(builder, (n, -f)) AS builder FROM c GROUP BY 1""", listing=True)
def mode_first_seen(spark, sf):
    return stats.first_seen_mode(listings(spark, sf), ["city"], "builder")


@query("""WITH n AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) WHEN s_suppkey % 3 = 1 THEN lower(s_name) ELSE s_name END AS name, s_suppkey FROM supplier),
c AS (SELECT lower(name) AS key, name, count(*) AS n FROM n GROUP BY 1, 2) SELECT key, arg_max(name, (n, name <> key, name)) AS spelling, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""")
def display_spelling(spark, sf):
    k = F.col("s_suppkey") % 3
    return stats.display_spelling(table(spark, sf, "supplier").select(F.when(k == 0, F.upper("s_name")).when(k == 1, F.lower("s_name")).otherwise(F.col("s_name")).alias("name")), "name")


ACCENTS = f"translate({{}}, '{text.ACCENTED}', '{text.PLAIN}')"


@query(f"""WITH w AS (SELECT word, min(doc_id) AS doc_id FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY 1), k AS (SELECT doc_id, word, trim(lower({ACCENTS.format("word")})) AS key FROM w)
SELECT key, arg_min(word, (word = {ACCENTS.format("word")}, doc_id, word)) AS spelling FROM k GROUP BY 1""")
def spelling_preference(spark, sf):
    """Over all words of all texts; of spellings first seen in one document the least in order of code points."""
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    return stats.preferred_spelling(words.groupBy("word").agg(F.min("doc_id").alias("idx")), "word")


@query("""SELECT lower(n_name) AS city_key, p_size AS rooms, arg_max(price, (t, k)) AS reference, max(t) AS updated_at FROM (SELECT n_name, p_size, p_retailprice AS price, p_partkey % 1000 AS t, p_partkey AS k FROM part JOIN nation ON p_partkey % 25 = n_nationkey) GROUP BY 1, 2""")
def reference_latest(spark, sf):
    p = table(spark, sf, "part").join(table(spark, sf, "nation"), F.col("p_partkey") % 25 == F.col("n_nationkey"))
    rows = p.select(F.col("n_name").alias("city"), F.col("p_size").alias("rooms"), F.col("p_retailprice").alias("price_m2"), F.struct((F.col("p_partkey") % 1000).alias("at"), F.col("p_partkey").alias("k")).alias("updated_at"))
    return stats.latest_reference(rows).withColumn("updated_at", F.col("updated_at.at"))


@query("SELECT idx, round((price_m2 - p_retailprice) / nullif(p_retailprice, 0) * 100, 6) AS variation FROM listing JOIN part ON part = p_partkey", listing=True)
def variation_vs_reference(spark, sf):
    rows = listings(spark, sf).join(table(spark, sf, "part").select("p_partkey", "p_retailprice"), F.col("part") == F.col("p_partkey"))
    return rows.select("idx", numbers.variation_percent(F.col("price_m2"), F.col("p_retailprice"), 6).alias("variation"))


@query("""WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS s, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS n FROM customer)
SELECT x.c_custkey AS id, count(*) AS twins FROM a x JOIN a y ON x.s IS NOT DISTINCT FROM y.s AND x.n IS NOT DISTINCT FROM y.n GROUP BY 1""")
def null_safe_key(spark, sf):
    c = table(spark, sf, "customer")
    a = c.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("s"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey")).alias("n"))
    return a.alias("a").join(a.groupBy("s", "n").agg(F.count("*").alias("twins")).alias("b"), history.same_request(["s", "n"])).select(F.col("a.c_custkey").alias("id"), "twins")


@query("""SELECT idx, CASE WHEN price_m2 / m - 1 < -0.1 THEN '▼' WHEN price_m2 / m - 1 > 0.1 THEN '▲' ELSE '●' END AS position FROM listing, (SELECT avg(price_m2) AS m FROM listing)""", listing=True)
def position_band(spark, sf):
    return stats.with_position(listings(spark, sf)).select("idx", "position")


@query("""WITH d AS (SELECT idx, (price_m2 / 1000.0 - 1) * 20 AS p FROM listing) SELECT band, count(*) AS n FROM (SELECT CASE WHEN p < -8 THEN 'well below' WHEN p < -2 THEN 'below' WHEN p <= 2 THEN 'at' WHEN p <= 8 THEN 'above' ELSE 'well above' END AS band FROM d) GROUP BY 1""", listing=True)
def deviation_bands(spark, sf):
    return listings(spark, sf).select(numbers.deviation_band((F.col("price_m2") / 1000.0 - 1) * 20).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


@query("""SELECT label, p_partkey AS id FROM (SELECT p_partkey, p_brand || CASE WHEN row_number() OVER w = 1 THEN '' ELSE ' (' || row_number() OVER w || ')' END AS label FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey))""")
def label_disambiguation(spark, sf):
    return stats.numbered_labels(table(spark, sf, "part"), "p_brand", "p_partkey").select("label", F.col("p_partkey").alias("id"))


@query("""SELECT c_nationkey AS k, bool_or(CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_acctbal > 9000 THEN true ELSE false END) AS flag FROM customer GROUP BY 1""")
def three_valued_or(spark, sf):
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(stats.any_true(F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal") > 9000)).alias("flag"))


@query("""SELECT arg_min(title, (price_m2, title)) AS low_row, min(price_m2) AS low, arg_max(title, (price_m2, title)) AS high_row, max(price_m2) AS high FROM listing""", listing=True)
def price_extremes(spark, sf):
    return stats.extremes(listings(spark, sf))


@query("""WITH g AS (SELECT district, round(median(price_m2), 9) AS median, count(*) AS n FROM listing GROUP BY 1) SELECT district, median, n, round(median / (SELECT max(median) FROM g), 6) AS share, n < 15 AS weak FROM g""", listing=True)
def district_bars(spark, sf):
    g = listings(spark, sf).groupBy("district").agg(F.round(F.median("price_m2"), 9).alias("median"), F.count("*").alias("n"))
    return stats.share_of_largest(g, "median", "n").withColumn("share", F.round("share", 6))


# quality

REASONS = """CASE WHEN price IS NULL OR price <= 0 THEN 'no_price' WHEN price < 20000 THEN 'not_a_total_price' WHEN area IS NULL OR area <= 0 THEN 'no_area' WHEN NOT area BETWEEN 15 AND 45 THEN 'implausible_area'
 WHEN NOT price_m2 BETWEEN 1000 AND 1600 THEN 'implausible_price_m2' WHEN rooms <> 2 THEN 'other_rooms' WHEN price > 60000 * 1.1 THEN 'outside_price_range' END"""
RULES, REQUEST = Rules(area_most=45, price_m2_most=1600), {"rooms": 2, "price_max": 60000}


def _checked(spark, sf) -> DataFrame:
    return quality.with_reason(listings(spark, sf).withColumns({"descr": F.lit(None).cast("string"), "baths": F.lit(None).cast("int")}), REQUEST, RULES)


@query(f"SELECT idx, {REASONS} AS reject_reason FROM listing", listing=True)
def reason_chain(spark, sf):
    return _checked(spark, sf).select("idx", "reject_reason")


@query(f"SELECT reason, count(*) AS n FROM (SELECT {REASONS} AS reason FROM listing) WHERE reason IS NOT NULL GROUP BY 1", listing=True)
def reason_funnel(spark, sf):
    return quality.funnel(_checked(spark, sf))


@query("""SELECT source, count(*) AS n, count(*) FILTER (part % 3 <> 0) AS located, count(*) FILTER (part % 4 = 0) AS with_photo, count(*) FILTER (part % 4 <> 0) AS without_photo FROM listing GROUP BY 1""", listing=True)
def source_coverage(spark, sf):
    rows = listings(spark, sf).withColumns({"lat": F.when(F.col("part") % 3 != 0, F.col("lat")), "photos": F.when(F.col("part") % 4 == 0, F.array(F.lit("p"))).otherwise(F.array().cast("array<string>"))})
    return quality.coverage(rows)


@query("""WITH s AS (SELECT unnest(['s0', 's1', 's2', 's9']) AS source), c AS (SELECT source, count(*) AS n FROM listing WHERE source <> 's2' GROUP BY 1)
SELECT s.source, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN 'ok' ELSE 'zero' END AS status FROM s LEFT JOIN c USING (source)""", listing=True)
def source_status(spark, sf):
    counts = listings(spark, sf).filter("source <> 's2'").groupBy("source").agg(F.count("*").alias("n")).withColumn("failed", F.lit(False))
    return quality.source_status(spark.createDataFrame([("s0",), ("s1",), ("s2",), ("s9",)], "source string"), counts)


@query(r"SELECT page_id, regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '/+$', '') AS key, split_part(url, '?', 1) AS before_query FROM pages")
def url_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.url_key(F.col("url")).alias("key"), text.url_before_query(F.col("url")).alias("before_query"))


@query(r"""SELECT page_id, url FROM (SELECT page_id, url, row_number() OVER (PARTITION BY regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '/+$', '') ORDER BY page_id) AS rn FROM pages) WHERE rn = 1""")
def url_dedup_first(spark, sf):
    return quality.keep_first(table(spark, sf, "pages").select("page_id", "url"), text.url_key(F.col("url")), "page_id")


@query(r"""SELECT page_id, coalesce(regexp_matches(url, '^https://([a-z0-9-]+\.)*example\.(com|org)(:443)?([/?#]|$)'), false) AS allowed FROM pages""")
def host_allowlist(spark, sf):
    return table(spark, sf, "pages").select("page_id", numbers.host_allowed(F.col("url"), ("example.com", "example.org")).alias("allowed"))


@query("""WITH d AS (SELECT idx, district, (CASE WHEN contains(lower(district), 'nation_1') OR contains(lower(district), 'nation_24') THEN 1 ELSE 0 END) AS k FROM listing) SELECT district, count(*) AS n FROM d WHERE k = 1 GROUP BY 1""", listing=True)
def district_filter(spark, sf):
    return listings(spark, sf).filter(quality.in_districts(["Nation_1", "NATION_24"])).groupBy("district").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT *, (builder IS NOT NULL)::INT + (rooms IS NOT NULL)::INT + (title <> '')::INT AS f FROM listing) SELECT part, arg_max(idx, (f, -idx)) AS idx, max(f)::BIGINT AS fullness FROM c GROUP BY 1""", listing=True)
def completeness_rank(spark, sf):
    rows = listings(spark, sf).withColumn("f", quality.completeness(["builder", "rooms", "title"]))
    return rows.groupBy("part").agg(F.max_by("idx", F.struct(F.col("f"), -F.col("idx"))).alias("idx"), F.max("f").cast("long").alias("fullness"))


@query("""SELECT source, doc_id, n_chars, rn FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 4 ORDER BY n_chars DESC, doc_id LIMIT 12""")
def topn_per_group_then_global(spark, sf):
    return history.top_per_group(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), F.asc("doc_id")]).withColumn("rn", F.col("rn").cast("long"))


# text

NORM = f"trim(lower({ACCENTS.format('{}')}))"


@query(f"SELECT doc_id, md5({NORM.format('text')}) AS norm, text <> {ACCENTS.format('text')} AS accented FROM documents")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalize(F.col("text"))).alias("norm"), text.has_accent(F.col("text")).alias("accented"))


@query(f"SELECT p_partkey AS id, array_to_string(list_filter(string_split_regex({NORM.format('p_name')}, '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS words FROM part")
def tokenize(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(text.tokens(F.col("p_name")), " ").alias("words"))


@query(f"""WITH t AS (SELECT doc_id, ' ' || array_to_string(list_filter(string_split_regex({NORM.format('text')}, '[^a-z0-9]+'), lambda x: x <> ''), ' ') || ' ' AS w FROM documents)
SELECT doc_id, contains(w, ' apache license ') AS said FROM t""")
def phrase_mention(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.mentions(F.col("text"), F.lit("apache license")).alias("said"))


@query("""SELECT n_nationkey AS id, n_name AS name FROM (SELECT * FROM nation WHERE contains(lower(n_name), 'n_1')) ORDER BY NOT starts_with(lower(n_name), 'n_1'), n_nationkey LIMIT 8""")
def autocomplete_prefix_then_contains(spark, sf):
    low = F.lower("n_name")
    return table(spark, sf, "nation").filter(F.contains(low, F.lit("n_1"))).orderBy(F.desc(F.startswith(low, F.lit("n_1"))), "n_nationkey").limit(8).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_property_map(spark, sf):
    return table(spark, sf, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("""SELECT c_custkey AS id, list_aggregate(list_sort([lower(c_mktsegment), 'zone', lower(c_name)]), 'string_agg', '|') AS key FROM customer""")
def list_key(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), text.list_key(F.array(F.col("c_mktsegment"), F.lit(" Zone"), F.col("c_name"), F.lit("ZONE"))).alias("key"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, len(regexp_extract_all(html, '<p[ >]'))::BIGINT AS paragraphs, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def page_parts(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1).alias("host"), F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("paragraphs"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


SHOWN = "array_to_string(list_transform(string_split({}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
#: Without the generic word that some names begin with.
OWN_WORDS = "regexp_replace(p_name, '^new ', '')"


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN {SHOWN.format(OWN_WORDS)} END AS district FROM part")
def slug_district(spark, sf):
    """Slugs that name the city after the district; every fifth names another city."""
    city = F.when(F.col("p_partkey") % 5 > 0, F.lit("-sao-paulo")).otherwise(F.lit("-recife"))
    url = F.concat(F.lit("https://x.example/venda-apartamento-"), text.slug(F.col("p_name")), city)
    return table(spark, sf, "part").select("p_partkey", text.district_from_slug(url, F.lit("São Paulo")).alias("district"))


@query(f"SELECT p_partkey, {SHOWN.format('p_name')} AS dev_name, 'Brand' AS builder, CASE WHEN regexp_matches({OWN_WORDS}, '[a-z]{{4}}') THEN {OWN_WORDS} END AS name_key FROM part")
def name_parts(spark, sf):
    t = F.concat(F.lit("Apartamento Residencial "), F.initcap("p_name"), F.lit(" com 2 quartos, Construtora "), F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", text.development_name(t).alias("dev_name"), text.builder_name(t).alias("builder"), text.name_key(F.col("p_name")).alias("name_key"))


# joins and sets


@query("""SELECT a.idx AS a_idx, b.idx AS b_idx FROM listing a JOIN listing b ON a.idx < b.idx AND a.part = b.part AND abs(floor(a.price / 1000) - floor(b.price / 1000)) <= 1 AND abs(floor(a.area / 5) - floor(b.area / 5)) <= 1""", listing=True)
def band_pairs(spark, sf):
    return pairs.band_pairs(listings(spark, sf).select("idx", "part", "price", "area"), {"price": 1000, "area": 5}, ["part"]).select("a_idx", "b_idx")


@query("""WITH p AS (SELECT a.idx AS a_idx, b.idx AS b_idx, abs(a.price - b.price) / ((a.price + b.price) / 2) AS dp, abs(a.area - b.area) / ((a.area + b.area) / 2) AS da FROM listing a JOIN listing b ON a.idx < b.idx AND a.part = b.part AND a.source <> b.source)
SELECT a_idx, b_idx, round(CASE WHEN dp <= 0.05 AND da <= 0.08 THEN 0.75 + 0.25 * greatest(0, 1 - 0.5 * dp / 0.05 - 0.3 * da / 0.08) ELSE 0 END, 6) AS score FROM p""", listing=True)
def pair_score(spark, sf):
    rows = listings(spark, sf).select("idx", "source", "price", "area", "part", F.lit(1).alias("rooms"))
    p = rows.alias("a").join(rows.alias("b"), [F.col("a.part") == F.col("b.part"), F.col("a.idx") < F.col("b.idx"), F.col("a.source") != F.col("b.source")])
    p = p.select(*(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in rows.columns))
    return p.select("a_idx", "b_idx", F.round(dedup.pair_score(F.lit(1.0), F.lit(1.0), Pairing()), 6).alias("score"))


@query("""WITH t AS (SELECT DISTINCT p_partkey AS idx, p_brand AS scope, unnest(string_split(lower(p_name), ' ')) AS t FROM part), u AS (SELECT * FROM t WHERE length(t) >= 4)
SELECT a.idx AS a, b.idx AS b, count(*) AS shared FROM u a JOIN u b ON a.t = b.t AND a.scope = b.scope AND a.idx < b.idx GROUP BY 1, 2""")
def token_index_pairs(spark, sf):
    return pairs.token_pairs(table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.col("p_brand").alias("scope"), "p_name"), F.split(F.lower("p_name"), " "), scope=["scope"])


POINTS = """c AS (SELECT c_custkey AS id, -3.7::DOUBLE - (c_custkey % 997) / 20000 AS lat, -38.5::DOUBLE - (c_custkey % 991) / 20000 AS lng FROM customer),
s AS (SELECT s_suppkey AS id, -3.7::DOUBLE - (s_suppkey % 97) / 2000 AS lat, -38.5::DOUBLE - (s_suppkey % 89) / 2000 AS lng FROM supplier),
d AS (SELECT c.id AS a_id, s.id AS b_id, 2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lng - c.lng) / 2), 2)))) AS metres FROM c, s)"""


def _points(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.lit(-3.7) - F.col("c_custkey") % 997 / 20000).alias("lat"), (F.lit(-38.5) - F.col("c_custkey") % 991 / 20000).alias("lng"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.lit(-3.7) - F.col("s_suppkey") % 97 / 2000).alias("lat"), (F.lit(-38.5) - F.col("s_suppkey") % 89 / 2000).alias("lng"))
    return c, s


@query(f"WITH {POINTS} SELECT a_id, b_id, round(metres, 3) AS metres FROM d WHERE metres <= 300")
def grid_pairs_within_radius(spark, sf):
    return pairs.near_pairs(*_points(spark, sf), 300).withColumn("metres", F.round("metres", 3))


@query(f"WITH {POINTS} SELECT a_id, arg_min(b_id, (metres, b_id)) AS b_id, round(min(metres), 3) AS metres FROM d WHERE metres <= 500 GROUP BY 1")
def nearest_within_radius(spark, sf):
    return pairs.nearest(*_points(spark, sf), 500).withColumn("metres", F.round("metres", 3))


@query(f"""WITH {POINTS.split(",\nd AS")[0]} SELECT id, round(2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(-3.71 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(-3.71)) * pow(sin(radians(-38.51 - lng) / 2), 2)))), 3) AS metres FROM c WHERE 2 * 6371000 * asin(sqrt(least(1.0, pow(sin(radians(-3.71 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(-3.71)) * pow(sin(radians(-38.51 - lng) / 2), 2)))) <= 900""")
def radius_target(spark, sf):
    return pairs.within_target(_points(spark, sf)[0], -3.71, -38.51, 900).select("id", F.round("metres", 3).alias("metres"))


@query("""SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents""")
def semi_anti(spark, sf):
    d, l = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    return d.join(l, "doc_id", "left_semi").withColumn("labelled", F.lit(True)).unionByName(d.join(l, "doc_id", "left_anti").withColumn("labelled", F.lit(False)))


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'except', count(*) FROM (SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1)""")
def set_union_intersect_except(spark, sf):
    l = table(spark, sf, "labels")
    good, bad = l.filter("quality = 1").select("doc_id"), l.filter("toxic = 1").select("doc_id")
    n = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return n(good.union(bad).distinct(), "union").unionByName(n(good.intersect(bad), "intersect")).unionByName(n(good.subtract(bad), "except"))


@query("""WITH s AS (SELECT c_custkey AS search_id, c_name AS city FROM customer WHERE c_nationkey = 3), o AS (SELECT o_custkey AS search_id, o_totalprice AS price FROM orders) SELECT city, count(*) AS n, round(avg(price), 2) AS mean FROM o JOIN s USING (search_id) GROUP BY 1""")
def history_by_search(spark, sf):
    s = table(spark, sf, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("search_id"), F.col("c_name").alias("city"))
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("search_id"), "o_totalprice").join(s, "search_id").groupBy("city").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"))


# groups


@query("""WITH m AS (SELECT CASE WHEN part % 2 = 0 THEN part END AS g, price_m2, idx % 10 = 1 AS probable FROM listing),
v AS (SELECT median(price_m2) AS v FROM m WHERE g IS NOT NULL AND NOT probable GROUP BY g UNION ALL SELECT price_m2 FROM m WHERE g IS NULL) SELECT round(median(v), 9) AS median, count(v) AS n FROM v""", listing=True)
def per_building_median(spark, sf):
    rows = listings(spark, sf).withColumns({"group_id": F.when(F.col("part") % 2 == 0, F.col("part")), "group_link": F.when(F.col("idx") % 10 == 1, "probable").otherwise("confirmed")})
    return grouping.median_by_building(rows, digits=9)


@query("""WITH g AS (SELECT part, median(price_m2) AS m FROM listing GROUP BY 1) SELECT idx, round((price_m2 - m) / nullif(m, 0) * 100, 6) AS deviation FROM listing JOIN g USING (part)""", listing=True)
def deviation_in_group(spark, sf):
    return grouping.deviation_in_group(listings(spark, sf).withColumn("group_id", F.col("part")), digits=6).select("idx", "deviation")


def _building_rows(spark, sf) -> DataFrame:
    """Parts as listings: some hundred streets and places, a third with numbers, a seventh with names."""
    k = F.col("p_partkey")
    names = F.element_at(F.array(*[F.lit(x) for x in ("Alpha", "Beta", "Gamma", "Delta")]), (k % 4 + 1).cast("int"))
    address = F.concat(F.lit("Rua Street "), names, F.when(k % 3 == 0, F.concat(F.lit(", "), k % 50)).otherwise(F.lit("")))
    spot = F.pmod(F.xxhash64(k % 701), F.lit(5000))
    return table(spark, sf, "part").select(
        k.alias("idx"), F.lit("City").alias("city"), F.col("p_brand").alias("district"), F.col("p_brand").alias("builder"), F.col("p_type").alias("title"), F.lit(None).cast("string").alias("descr"), F.concat(F.lit("s"), k % 5).alias("source"),
        F.col("p_retailprice").alias("price"), F.lit(1.0).alias("area"), F.col("p_retailprice").alias("price_m2"), (k % 4).cast("int").alias("rooms"), F.when(k % 5 != 0, address).alias("address"),
        F.when(k % 7 == 0, F.concat(F.lit("Residencial "), F.col("p_name"))).alias("dev_name"), F.lit("exact").alias("coord_origin"), F.lit(None).cast("boolean").alias("is_launch"), (-3.7 - spot / 1000).alias("lat"), (-38.5 - spot / 1000).alias("lng"),
    )


@query()
def unit_collapse(spark, sf):
    return grouping.collapse_units(listings(spark, sf).withColumn("group_id", F.col("part"))).select("idx", "unit")


@query()
def guarded_grouping(spark, sf):
    return grouping.group_listings(_building_rows(spark, sf))


@query()
def group_summary(spark, sf):
    rows = _building_rows(spark, sf)
    return grouping.summarize_groups(rows, guarded_grouping(spark, sf)).select("group_id", "level", "n_listings", "n_units", "median", "mean", "low", "high", "confidence")


@query()
def cross_source_dedup(spark, sf):
    return dedup.deduplicate(listings(spark, sf)).select("idx", "source", "cluster_n", F.array_join("dup_sources", ",").alias("dup_sources"))


@query()
def rf_imputation(spark, sf):
    rows = listings(spark, sf).withColumns({"parking": F.when(F.col("idx") % 4 != 0, (F.col("part") % 3).cast("int")), "baths": F.when(F.col("idx") % 5 != 0, (F.col("part") % 2 + 1).cast("int"))})
    return refine.impute(rows, [f"s{i}" for i in range(5)]).select("idx", "rooms", "parking", "baths", F.array_join("imputed", ",").alias("imputed"))


@query()
def double_confirmation(spark, sf):
    rows = listings(spark, sf).withColumns({"parking": (F.col("part") % 3).cast("int"), "baths": (F.col("part") % 2 + 1).cast("int")})
    return refine.refine(rows, [f"s{i}" for i in range(5)]).select("idx", "score", "rejected")


@query()
def evidence_scoring(spark, sf):
    rows = _building_rows(spark, sf)
    t = lookup.Target(name="Residencial part name", address="Rua Street Alpha, 12", lat=-3.712, lng=-38.512, precise=True, radius_m=200)
    return lookup.with_evidence(rows, t).filter("class IS NOT NULL").select("idx", F.array_join("codes", ",").alias("codes"), F.array_join("conflicts", ",").alias("conflicts"), "class", "motive")


@query()
def entity_search(spark, sf):
    rows = _building_rows(spark, sf)
    sure, maybe = lookup.find_building(rows, lookup.Target(address="Rua Street Alpha, 12"), guarded_grouping(spark, sf))
    return sure.select("idx", "class", "motive").unionByName(maybe.select("idx", "class", "motive"))


# workbook


@query("""WITH p AS (SELECT idx, round(price / area, 8) AS per_m2 FROM listing) SELECT idx, per_m2, round(per_m2 / m - 1, 4) AS vs_mean, CASE WHEN per_m2 / m - 1 < -0.1 THEN '▼' WHEN per_m2 / m - 1 > 0.1 THEN '▲' ELSE '●' END AS position, round((per_m2 - 1200) / 1200 * 100, 7) AS vs_reference FROM p, (SELECT avg(per_m2) AS m FROM p)""", listing=True)
def workbook_listings(spark, sf):
    return export.listings_table(listings(spark, sf), 1200.0, digits=8).select("idx", "per_m2", "vs_mean", "position", "vs_reference")


@query("""WITH p AS (SELECT district, area, round(price / area, 8) AS v FROM listing), g AS (SELECT district, count(*) AS n, avg(v) AS m, round(avg(area), 2) AS mean_area FROM p GROUP BY 1)
SELECT district, n, round(m, 2) AS mean, round(m / a - 1, 4) AS vs_mean, CASE WHEN m / a - 1 < -0.1 THEN '▼' WHEN m / a - 1 > 0.1 THEN '▲' ELSE '●' END AS position, round((m - 1200) / 1200 * 100, 1) AS vs_reference, mean_area FROM g, (SELECT avg(v) AS a FROM p)""", listing=True)
def workbook_districts(spark, sf):
    return export.districts_table(listings(spark, sf), 1200.0, digits=8)


@query("""WITH p AS (SELECT round(price / area, 8) AS v FROM listing) SELECT count(v) AS n, round(avg(v), 2) AS mean, round(median(v), 8) AS median, min(v) AS low, max(v) AS high, count(*) FILTER (v / a - 1 < -0.1) AS below, count(*) FILTER (v / a - 1 > 0.1) AS above, round((round(avg(v), 2) - 1200) / 1200 * 100, 1) AS vs_reference FROM p, (SELECT avg(v) AS a FROM p)""", listing=True)
def workbook_summary(spark, sf):
    return export.summary_table(listings(spark, sf), 1200.0, digits=8)


@query("""SELECT u, array_to_string(list_sort(list(DISTINCT k)), ',') AS ks, count(*) AS n FROM (SELECT user_id % 5 AS u, user_id % 3 AS k FROM events) GROUP BY u""")
def sorted_sets(spark, sf):
    return table(spark, sf, "events").groupBy((F.col("user_id") % 5).alias("u")).agg(F.array_join(F.sort_array(F.collect_set(F.col("user_id") % 3)), ",").alias("ks"), F.count("*").alias("n"))


@query("""SELECT role, count(*) AS n, arg_min(text, (turn, conv_id)) AS first_text FROM conversations GROUP BY 1""")
def first_by_order(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.min_by("text", F.struct("turn", "conv_id")).alias("first_text"))


@query("""SELECT city, district, round(avg(price_m2), 2) AS mean, count(*) AS n FROM listing GROUP BY ROLLUP (city, district)""", listing=True)
def rollup_means(spark, sf):
    return listings(spark, sf).rollup("city", "district").agg(F.round(F.avg("price_m2"), 2).alias("mean"), F.count("*").alias("n"))
