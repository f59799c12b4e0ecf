"""Cases of the listing operators on small frames: what is kept, dropped, paired, grouped, counted."""

from __future__ import annotations

import difflib
import math
import random
import statistics
import time
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera import schema
from tessera.config import Grouping, Pairing, Refining
from tessera.functions import nested, numbers, text
from tessera.operators import dedup, export, graph, grouping, history, lookup, pairs, quality, refine, stats
from tessera.schema import LISTING, conform, union_sources
from tessera.sources import pages, paged, tables


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def frame(spark, rows, columns):
    return spark.createDataFrame(rows, columns)


# text and numbers


def test_streets_and_numbers(spark):
    cases = [("Av. Beira Mar, 1200", "avenida beira mar", "1200"), ("R. das Flores 15", "rua flores", "15"), ("Rua 24 de Maio, 007", "rua 24 maio", "7"), ("Rua X, S/N", "rua x", None), ("Rua X, 0", "rua x", None), ("Rua Só Nome", "rua so nome", None), ("", None, None), (None, None, None)]
    got = frame(spark, cases, "a string, street string, number string").select("street", "number", text.street_and_number(F.col("a")).alias("s")).collect()
    assert [(r.s.street, r.s.number) for r in got] == [(c[1], c[2]) for c in cases]


def test_names(spark):
    cases = [("Residencial Solar das Águas", "solar das aguas"), ("Apartamento 3 quartos", None), ("Edifício Ipê", None), ("Torre Blue", "torre blue"), ("um dois tres quatro cinco seis sete nove", None), (None, None)]
    got = frame(spark, cases, "a string, k string").select(text.name_key(F.col("a")).alias("k")).collect()
    assert [r.k for r in got] == [c[1] for c in cases]
    r = one(spark, a=text.development_name(F.lit("Apartamento no Residencial Vila Nova com 3 quartos")), b=text.builder_name(F.lit("Obra da Construtora Alfa Beta, pronta")), c=text.builder_name(F.lit("pela xpto em 2020"), ("XPTO",)), d=text.launch_name(F.lit("https://x.y/lancamento-parque-das-aves-123?z")), e=text.slug_to_name(F.lit("jardim-das-flores")), f=text.phrase(F.lit("Condomínio Solar")))
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("Vila Nova", "Alfa Beta", "XPTO", "Parque das Aves", "Jardim das Flores", "solar")


def test_numbers_in_text(spark):
    cases = [("R$ 1.234.567,89", 1234567.89), ("440.000", 440000.0), ("R$ 440", 440.0), ("62,5", 62.5), ("62.5", 62.5), ("none", None), (None, None)]
    assert [r.v for r in frame(spark, cases, "a string, v double").select(text.to_number(F.col("a")).alias("v")).collect()] == [c[1] for c in cases]
    r = one(spark, a=text.area_number(F.lit("60 m2")), b=text.area_number(F.lit("62,5 m²")), c=text.without_secrets(F.lit("http://p/?api_key=abc&x=1")), d=text.has_accent(F.lit("São")), e=text.normalize(F.lit("  São João Nº ")))
    assert (r.a, r.b, r.c, r.d, r.e) == (60.0, 62.5, "http://p/?api_key=***&x=1", True, "sao joao no")


def test_districts_types_and_flags(spark):
    r = one(
        spark, a=text.district_from_slug(F.lit("https://x/imovel/venda-apartamento-3-quartos-meireles-fortaleza-id-7"), F.lit("Fortaleza")), b=text.district_from_slug(F.lit("https://x/nada"), F.lit("Fortaleza")), c=text.building_type(F.array(F.lit("Elevador")), F.lit("")), d=text.building_type(F.array().cast("array<string>"), F.lit("no 3º andar")),
        e=text.building_type(F.lit(None).cast("array<string>"), F.lit("12º andar")), f=text.building_type(F.lit(None).cast("array<string>"), F.lit(None).cast("string")), g=text.launch_flag(F.lit("x"), F.lit("imóvel usado")), h=text.launch_flag(F.lit("x"), F.lit("bom")), i=text.list_key(F.array(F.lit("B"), F.lit("á"))), j=text.split_names(F.array(F.lit("A, b"), F.lit("Á"))),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i, r.j) == ("Meireles", None, "tower", "probable_block", "tower", "undefined", False, None, "a|b", ["A", "b"])


def test_similarity_is_symmetric_to_the_stated_library(spark):
    from difflib import SequenceMatcher

    cases = [("abc", "abc"), ("solar azul", "solar azuis"), ("a", ""), (None, "x"), ("long name here", "x")]
    got = frame(spark, cases, "a string, b string").select(text.similarity(F.col("a"), F.col("b"), 0.5).alias("s")).collect()
    assert got[0].s == 1.0 and got[1].s == pytest.approx(SequenceMatcher(None, *cases[1]).ratio()) and [r.s for r in got[2:]] == [0, 0, 0]


def test_weeks(spark):
    days = [date(2020, 1, 1) + timedelta(d) for d in range(0, 2200, 3)]
    rows = frame(spark, [(d,) for d in days], "d date").select("d", numbers.week_label(F.col("d")).alias("w"), numbers.week_bounds(numbers.week_label(F.col("d"))).alias("b")).collect()
    assert all(r.w == r.d.strftime("%Y-W%W") and r.b.first <= r.d <= r.b.last for r in rows)


def test_geography_and_hosts(spark):
    r = one(spark, a=numbers.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.001), F.lit(0.0)), b=numbers.tile_exists(F.lit(3), F.lit(7), F.lit(8)), c=numbers.host_allowed(F.lit("https://img.cdn.example/x"), ("cdn.example",)), d=numbers.host_allowed(F.lit("https://u@cdn.example/x"), ("cdn.example",)), e=numbers.host_allowed(F.lit("https://evilcdn.example/"), ("cdn.example",)), f=numbers.host_allowed(F.lit("http://cdn.example/"), ("cdn.example",)))
    assert abs(r.a - 111.2) < 0.2 and (r.b, r.c, r.d, r.e, r.f) == (False, True, False, False, False)


def test_json_expressions(spark):
    r = one(
        spark, a=nested.json_strings(F.lit('["a", 1, {"x": 2}, null]')), b=nested.json_strings(F.lit("broken")), c=nested.property_map(F.from_json(F.lit('[{"name":"a","value":"1"},{"name":"a","value":"2"}]'), "array<struct<name:string,value:string>>")),
        d=nested.photo_urls(F.lit('["//h/a.jpg", {"url": "/b.jpg"}, "https://h/logo.png", "//h/a.jpg", "https://h/{width}.jpg"]'), F.lit("https://base")), e=nested.streamed_text(F.lit(r'push([1,"a\"b"]) x push([1,"c"])')), f=nested.amenities(F.lit('["pool", {"value": "gym"}, {"name": "lift"}]')),
    )
    assert r.b == [] and "a" in r.a and r.c == {"a": "2"} and r.d == ["https://h/a.jpg", "https://base/b.jpg", "https://h/870.jpg"] and r.e == 'a"bc' and r.f == ["pool", "gym", "lift"]


# quality


VALID = "idx long, title string, url string, descr string, price double, area double, price_m2 double, rooms int, baths int"


def test_reasons_first_rule_wins(spark):
    base = dict(idx=0, title="Apartamento", url="https://x/1", descr="", price=400_000.0, area=60.0, price_m2=6666.67, rooms=2, baths=2)
    cases = [({}, None), ({"title": "Apto para ALUGUEL"}, "rental"), ({"url": "https://x/alugar-apto"}, "rental"), ({"price": None}, "no_price"), ({"price": 2_000.0}, "not_a_total_price"), ({"title": "Lançamento 50 - 70 m²"}, "area_range"), ({"title": "R$ 400.000"}, "bad_title"), ({"area": None}, "no_area"), ({"area": 5000.0}, "implausible_area"), ({"price_m2": 90_000.0}, "implausible_price_m2"), ({"price_m2": 0.0}, None), ({"rooms": 3}, "other_rooms"), ({"rooms": None}, None), ({"baths": 1}, "other_baths"), ({"price": 600_000.0, "price_m2": None}, "outside_price_range"), ({"price": 540_000.0, "price_m2": None}, None), ({"title": "Alugado? rental", "price": None}, "rental")]
    rows = [tuple({**base, **c, "idx": i}.values()) for i, (c, _) in enumerate(cases)]
    checked = quality.with_reason(frame(spark, rows, VALID), {"rooms": 2, "baths": 2, "price_min": 280_000, "price_max": 500_000})
    got = {r.idx: r.reject_reason for r in checked.collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
    lost = {r.reason: r.n for r in quality.funnel(checked).collect()}
    assert sum(lost.values()) + checked.filter("reject_reason IS NULL").count() == len(cases) and lost["rental"] == 3
    assert {r.kind: r.n for r in quality.funnel_kinds(quality.combined_funnel(quality.funnel(checked), frame(spark, [("duplicate_url", 4)], "reason string, n long"))).collect()}["duplicates"] == 4


def test_first_of_equal_rows(spark):
    df = frame(spark, [(3, "https://x/a?p=1"), (1, "https://x/a?p=2"), (2, ""), (4, None), (5, "")], "idx long, url string")
    assert sorted(r.idx for r in quality.first_by_url(df).collect()) == [1, 2, 4, 5]


def test_schema_of_sources(spark):
    a = frame(spark, [("1", "x", "12")], "title string, url string, price string")
    b = frame(spark, [(" ", "abc")], "title string, price string")
    rows = union_sources([a, b])
    assert rows.schema == LISTING and [(r.title, r.price) for r in rows.collect()] == [("1", 12.0), (None, None)]
    assert conform(a.limit(0)).count() == 0


# statistics


def test_kpis_bands_and_districts(spark):
    df = frame(spark, [("Centro", 10.0), ("centro sul", 20.0), ("Aldeota", 60.0), (None, 5.0)], "district string, price_m2 double")
    r = stats.kpis(df).first()
    assert (r.n, r.mean, r.median, r.low, r.high) == (4, 23.75, 15.0, 5.0, 60.0)
    assert tuple(stats.kpis(df.limit(0)).first()) == (0, 0.0, 0.0, 0.0, 0.0)
    rows = stats.by_requested_district(df, ["Centro", "ALDEOTA", "none"]).collect()
    assert [(r.requested, r.n) for r in rows] == [("ALDEOTA", 1), ("Centro", 2)] and stats.by_requested_district(df, ["Centro"]).count() == 0


def test_outliers_only_in_groups_of_three(spark):
    rows = [(i, "a", 2, v) for i, v in enumerate([8000.0, 8100.0, 7900.0, 8050.0, 7950.0, 2500.0, 18414.0])] + [(10, "b", 2, 1.0), (11, "b", 2, 100.0)]
    out = stats.outlier_band(frame(spark, rows, "idx long, city string, rooms int, price_m2 double"), ["city", "rooms"])
    assert {r.idx for r in out.filter("outlier").collect()} == {5, 6}


def test_centroids_do_not_feed_themselves(spark):
    rows = [(1, "Á", 1.0, 1.0, "exact"), (2, "a", 3.0, 3.0, "exact"), (3, "A", None, None, None), (4, "b", 1.0, 1.0, "exact"), (5, "b", None, None, None)]
    once = stats.fill_centroids(frame(spark, rows, "idx long, district string, lat double, lng double, coord_origin string"))
    got = {r.idx: (r.lat, r.coord_origin) for r in once.collect()}
    assert got[3] == (2.0, "district_centroid") and got[5] == (None, None)
    assert {r.idx: r.lat for r in stats.fill_centroids(once).collect()} == {k: v[0] for k, v in got.items()}


def test_modes_and_upsert(spark):
    df = frame(spark, [(1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, None)], "idx long, v string").withColumn("k", F.lit(1))
    assert stats.first_seen_mode(df, ["k"], "v").first().v == "b"
    merged = stats.upsert(frame(spark, [("x", 1, 1.0), ("y", 1, 2.0)], "k string, at int, v double"), frame(spark, [("x", 1, 9.0)], "k string, at int, v double"), ["k"], "at")
    assert {r.k: r.v for r in merged.collect()} == {"x": 9.0, "y": 2.0}


# history


def test_latest_per_week_and_series(spark):
    t = lambda d: datetime(2026, 9, d)
    df = frame(spark, [(1, "u", 7000.0, t(7)), (2, "u", 7500.0, t(9)), (3, "u", 7600.0, t(9)), (4, "v", 8500.0, t(8)), (5, "u", 1.0, t(15))], "idx long, key string, price_m2 double, ts timestamp_ntz")
    latest = history.latest_per_period(df, "key", "ts", "idx")
    assert {(r.week, r.key): r.price_m2 for r in latest.collect()} == {("2026-W36", "u"): 7500.0, ("2026-W36", "v"): 8500.0, ("2026-W37", "u"): 1.0}
    r = history.weekly_series(latest, "price_m2", []).filter("week = '2026-W36'").first()
    assert (r.n, r["mean"], r.low_confidence) == (2, 8000.0, True)


def test_snapshot_difference(spark):
    s = "key string, price double, source string, idx long"
    before = frame(spark, [("a", 100.0, "p", 1), ("a", 500_000.0, "p", 2), ("b", 400_000.0, "p", 3), ("c", 1000.0, "p", 4), ("d", 1000.0, "silent", 5)], s)
    now = frame(spark, [("a", 490_000.0, "p", 1), ("b", 400_900.0, "p", 2), ("e", 1.0, "p", 3)], s)
    r = history.snapshot_diff(now, before, "key", "price", "source", "idx").first()
    assert (r.new, r.dropped, r.raised, r.gone) == (1, 1, 0, 1)


def test_previous_search_and_cache(spark):
    t = lambda h: datetime(2026, 1, 1, h)
    df = frame(spark, [(1, "a", None, t(1)), (2, "a", None, t(1)), (3, "a", 2, t(2)), (4, "a", None, t(5))], "idx long, city string, rooms int, at timestamp_ntz")
    got = {r.idx: (r.hit, r.answer_id, r.previous_id) for r in history.cache_hits(df, ["city", "rooms"], "at", "idx").collect()}
    assert got == {1: (False, None, None), 2: (True, 1, 1), 3: (False, None, None), 4: (False, None, 2)}


# pairs, components, dedup


def test_components(spark):
    edges = frame(spark, [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in (100, 101, 103)} == {100}
    assert graph.components(edges.limit(0)).count() == 0


def test_pairs_against_brute_force(spark):
    import random

    rng = random.Random(0)
    pts = [(i, -3.7 + rng.random() / 500, -38.5 + rng.random() / 500) for i in range(120)]
    df = frame(spark, pts, "id long, lat double, lng double")
    got = {(r.a_id, r.b_id) for r in pairs.near_pairs(df, df, 60).collect()}
    every = df.alias("a").crossJoin(df.alias("b")).filter(numbers.haversine_m(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng")) <= 60)
    assert got == {(r[0], r[3]) for r in every.collect()}
    rows = [(i, rng.choice("ab"), float(rng.randint(0, 50)), float(rng.randint(0, 9))) for i in range(80)]
    bands = pairs.band_pairs(frame(spark, rows, "idx long, k string, p double, q double"), {"p": 10, "q": 2}, ["k"])
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and abs(a[2] // 10 - b[2] // 10) <= 1 and abs(a[3] // 2 - b[3] // 2) <= 1}
    assert {(r.a_idx, r.b_idx) for r in bands.collect()} == want and bands.count() == len(want)


UNIT = "idx long, title string, source string, price double, area double, rooms int, district string, builder string, photos array<string>"


def test_cross_source_dedup(spark):
    rows = [
        (1, "Apto Solar 2q", "p", 400_000.0, 60.0, 2, "Meireles", None, ["a"]), (2, "Apto Solar 2 q", "q", 401_000.0, 60.5, 2, "meireles", "B", ["b"]),  # one unit
        (3, "Apto X", "p", 500_000.0, 70.0, 2, "Centro", None, []), (4, "Apto X", "p", 500_000.0, 70.0, 2, "Centro", None, []),  # one source
        (5, "Y", "p", 600_000.0, 80.0, 2, "Aldeota", None, []), (6, "Y", "q", 600_000.0, 80.0, 3, "Aldeota", None, []),  # rooms
        (7, "Z", "p", 700_000.0, 90.0, 2, None, None, []), (8, "Z", "q", 700_000.0, 90.0, 2, None, None, []),  # no district
        (9, "W", "p", 300_000.0, 50.0, 2, "Papicu", None, []), (10, "W", "q", 300_000.0, 50.0, 2, "Cocó", None, []),  # districts
    ]
    out = {r.idx: r for r in dedup.deduplicate(frame(spark, rows, UNIT), Pairing()).collect()}
    assert set(out) == {2, 3, 4, 5, 6, 7, 8, 9, 10}
    assert out[2].dup_sources == ["p"] and out[2].photos == ["b", "a"] and out[2].cluster_n == 2


def test_cross_source_dedup_query_against_brute_force(spark, monkeypatch):
    import random

    from tessera.functions.numbers import relative_gap
    from tessera.plans import queries

    rng = random.Random(3)
    unit = lambda i: (i, rng.choice(["Solar", "Mar", "Luz"]), rng.choice("pq"), round(rng.choice([50_000, 50_000, 400_000, 900_000, 30]) * (1 + rng.random() / 12), 2), round(rng.choice([40, 130]) * (1 + rng.random() / 12), 1), rng.choice([2, None]), rng.choice(["Meireles", "Centro"]), None, [])
    rows = [(1, "A", "p", 50_000.0, 40.0, 2, "Papicu", None, []), (2, "A", "q", 52_100.0, 40.0, 2, "Papicu", None, []), *(unit(i) for i in range(3, 160))]
    df = frame(spark, rows, UNIT)
    a, b = (df.select(*(F.col(c).alias(f"{s}_{c}") for c in df.columns)) for s in "ab")
    every = a.crossJoin(b).filter("a_idx < b_idx AND lower(a_district) = lower(b_district) AND abs(floor(a_price / 10000) - floor(b_price / 10000)) <= 1 AND abs(floor(a_area / 5) - floor(b_area / 5)) <= 1")
    fit = every.filter((relative_gap(F.col("a_price"), F.col("b_price")) <= 0.05) & (relative_gap(F.col("a_area"), F.col("b_area")) <= 0.08))
    assert {(r.a_idx, r.b_idx) for r in dedup.candidates(df).collect()} == {(r.a_idx, r.b_idx) for r in fit.collect()}
    ts = F.when(F.col("a_title") == F.col("b_title"), 1.0).otherwise(text.ratio_udf(F.lower("a_title"), F.lower("b_title")))
    root = {r[0]: r[0] for r in rows}
    for r in every.filter(dedup.pair_score(ts, F.lit(1.0)) >= 0.85).select("a_idx", "b_idx").collect():
        was, now = max(root[r.a_idx], root[r.b_idx]), min(root[r.a_idx], root[r.b_idx])
        root = {k: now if v == was else v for k, v in root.items()}
    want = sorted(list(root.values()).count(v) for v in set(root.values()))
    monkeypatch.setattr(queries, "listings", lambda spark, sf: df)
    out = queries.cross_source_dedup(spark, "").collect()
    assert sorted(r.cluster_n for r in out) == want and want[-1] > 1 and len([r for r in out if r.idx in (1, 2)]) == 1


# grouping


PLACE = "idx long, city string, district string, address string, lat double, lng double, coord_origin string, dev_name string, price_m2 double, price double, area double, rooms int, source string, builder string, is_launch boolean"


def place(i, address=None, lat=None, lng=None, name=None, m2=8000.0, district="D", origin="exact", area=100.0, rooms=2):
    return (i, "C", district, address, lat, lng, origin if lat is not None else None, name, m2, m2 * area, area, rooms, "p", None, None)


def groups_of(spark, rows):
    got = grouping.group_listings(frame(spark, rows, PLACE)).collect()
    assert len({r.idx for r in got}) == len(got)
    by = {}
    for r in got:
        by.setdefault((r.level, r.root), set()).add((r.idx, r.link))
    return {(level, frozenset(i for i, link in v if link == "confirmed"), frozenset(i for i, link in v if link == "probable")) for (level, _), v in by.items()}


def test_group_levels(spark):
    rows = [
        place(1, "Rua A, 10", -3.70, -38.50), place(2, "R. A, 10"), place(3, None, -3.70, -38.50),  # building with attachment
        place(10, "Rua B", -3.80, -38.60), place(11, "Rua B", -3.80, -38.60), place(12, "Rua B", -3.80001, -38.60),  # one place
        place(20, name="Residencial Solar Azul"), place(21, name="Solar Azul"), place(22, name="Outro Nome"),  # one name
        place(30, "Rua Só Rua"), place(31, "Rua Só Rua"),  # street alone never groups
        place(40, "Rua N, 5", -3.9, -38.7), place(41, "Rua N, 7", -3.9, -38.7),  # neighbours
    ]
    f = frozenset
    assert groups_of(spark, rows) == {("same_building", f({1, 2}), f({3})), ("same_place", f({10, 11, 12}), f()), ("same_name", f({20, 21}), f())}


def test_price_guard_at_one_place(spark):
    rows = [place(i, None, -3.7, -38.5, m2=v) for i, v in enumerate([5000.0, 5100.0, 12000.0, 12100.0])]
    got = groups_of(spark, rows)
    assert all(level == "same_place" for level, *_ in got) and sum(len(x) for _, x, _ in got) <= 4
    assert not any({0, 2} <= x or {1, 3} <= x and {0} <= x for _, x, _ in got if len(x) > 2)


def test_far_parts_of_an_address_split(spark):
    rows = [place(1, "Rua A, 1", -3.70, -38.5), place(2, "Rua A, 1", -3.70, -38.5), place(3, "Rua A, 1", -3.75, -38.5), place(4, "Rua A, 1", -3.75, -38.5), place(5, "Rua A, 1", -3.75, -38.5), place(6, "Rua A, 1")]
    f = frozenset
    assert groups_of(spark, rows) == {("same_building", f({1, 2}), f()), ("same_building", f({3, 4, 5, 6}), f())}


def test_units_and_medians(spark):
    rows = [place(1, "Rua A, 1", area=100.0, m2=8000.0), place(2, "Rua A, 1", area=101.0, m2=7950.0), place(3, "Rua A, 1", area=150.0, m2=9000.0), place(4, "Rua A, 1", area=100.0, m2=8000.0, rooms=3)]
    df = frame(spark, rows, PLACE)
    units = {r.idx: r.unit for r in grouping.collapse_units(df.withColumn("group_id", F.lit(1))).collect()}
    assert units == {1: 1, 2: 1, 3: 3, 4: 4}
    r = grouping.summarize_groups(df, grouping.group_listings(df)).first()
    assert (r.n_listings, r.n_units, r.level, r.key) == (4, 3, "same_building", "addr:c|rua a|1") and r.group_id.startswith("grp_") and r.median == 8000.0
    again = grouping.summarize_groups(df.orderBy(F.desc("idx")), grouping.group_listings(df.orderBy(F.desc("idx")))).first()
    assert again.group_id == r.group_id
    m = frame(spark, [("g", "confirmed", 10.0), ("g", "confirmed", 20.0), ("g", "probable", 99.0), (None, None, 30.0)], "group_id string, group_link string, price_m2 double")
    assert tuple(grouping.median_by_building(m).first()) == (22.5, 2)


# refine


def test_isolation_sample_is_of_rows(spark):
    rows = [(i, 100_000.0 if i % 3 else 300_000.0, 50.0 if i % 3 else 90.0) for i in range(6000)]
    scored = refine.isolation_scores(frame(spark, rows, "idx long, price double, area double"), ["price", "area"], Refining(trees=4))
    by = {r.price: r.a for r in scored.groupBy("price").agg(F.avg("anomaly").alias("a")).collect()}
    assert by[300_000.0] > by[100_000.0]


def test_imputation_and_double_confirmation(spark):
    rows = [(i, "p", 200_000.0 + 5000 * i, 50.0 + i, 2, None if i % 5 == 0 else i % 3, None if i == 7 else 2) for i in range(40)] + [(99, "p", 9_000_000.0, 55.0, 2, 1, 2)]
    df = frame(spark, rows, "idx long, source string, price double, area double, rooms int, parking int, baths int")
    filled = refine.impute(df, ["p"]).collect()
    assert len(filled) == 41 and all(r.parking is not None and r.baths is not None for r in filled) and next(r for r in filled if r.idx == 7).imputed == ["baths"]
    out = refine.refine(frame(spark, [tuple(r) for r in filled], "idx long, source string, price double, area double, rooms int, parking int, baths int, imputed array<string>"), ["p"]).collect()
    assert len(out) == 41 and all(0 <= r.score <= 1 for r in out) and sum(r.rejected for r in out) <= 3
    few = refine.refine(df.limit(5), ["p"]).collect()
    assert all(r.score == 1.0 and not r.rejected for r in few)


def test_source_ranking(spark):
    s = "source string, rooms int, price_min double, price_max double, hour int"
    planned = frame(spark, [("a", 2, 1.0, 2.0, 3), ("b", 2, 1.0, 2.0, 3), ("c", 2, 1.0, 2.0, 3)], s)
    few = frame(spark, [("a", 2, 1.0, 2.0, 3, True), ("b", 2, 1.0, 2.0, 3, False)], s + ", ok boolean")
    assert [(r.source, r.chance) for r in refine.rank_sources(few, planned).collect()] == [("a", 1.0), ("c", 0.5), ("b", 0.0)]
    many = frame(spark, [("a", 2, 1.0, 2.0, h, True) for h in range(10)] + [("b", 2, 1.0, 2.0, h, False) for h in range(10)], s + ", ok boolean")
    assert refine.rank_sources(many, planned).first().source == "a"


# lookup


def test_evidence_and_search(spark):
    rows = [
        place(1, "Rua A, 10", -3.70, -38.50, "Solar Azul"), place(2, "Rua A, 10"), place(3, "Rua A, 12"), place(4, None, -3.70, -38.50), place(5, name="Solar Azul", district="Other"), place(6, name="Totally Different Name", district="D"), place(7),
    ]
    df = frame(spark, rows, PLACE).withColumns({"title": F.lit("x"), "descr": F.lit(None).cast("string")})
    t = lookup.Target(name="Residencial Solar Azul", address="Rua A, 10", district="D", lat=-3.70, lng=-38.50, precise=True)
    got = {r.idx: r for r in lookup.with_evidence(df, t).collect()}
    assert got[1]["class"] == "direct" and set(got[1].codes) == {"structured_name", "street", "number", "coordinate", "district"}
    assert got[3].conflicts == ["other_number"] and got[3]["class"] == "probable" and "other_district" in got[5].conflicts and "other_name" in got[6].conflicts and got[7].codes == ["district"]
    sure, maybe = lookup.find_building(df, t, grouping.group_listings(frame(spark, rows, PLACE)))
    assert {r.idx for r in sure.collect()} == {1, 2, 4} and 3 in {r.idx for r in maybe.collect()}
    s = lookup.link_summary(sure, maybe).first()
    assert s.direct == 2 and s.corroborated == 1 and lookup.weakest_level(sure).first().level == "same_place"
    bad = lookup.Target(address="Rua A, 10", reference={"address": "Rua B, 1", "name": "Other"})
    assert bad.resolved(spark)["conflict"] and bad.resolved(spark)["streets"] == ["rua a"]


def test_enrichment_fills_only_gaps(spark):
    df = frame(spark, [(i, "p" if i < 30 else "q", f"u{i}", None if i % 2 else "B") for i in range(40)], "idx long, source string, url string, builder string")
    details = frame(spark, [(f"u{i}", "X") for i in range(40)], "url string, builder string")
    out = lookup.enrich_candidates(df, details, ["builder"]).collect()
    assert len(out) == 40 and sum(r.filled == ["builder"] for r in out) == 8 and all(r.builder == "B" for r in out if r.idx % 2 == 0)


# export, sources


def test_workbook_tables(spark):
    df = frame(spark, [(1, "A", 100.0, 10.0), (2, "A", 300.0, 10.0), (3, None, 200.0, 10.0)], "idx long, district string, price double, area double")
    assert [(r.district, r.n, r.position) for r in export.districts_table(df).collect()] == [("(no district)", 1, "●"), ("A", 2, "●")]
    assert [r.position for r in export.listings_table(df, 20.0).orderBy("idx").collect()] == ["▼", "▲", "●"]
    s = export.summary_table(df).first()
    assert (s.n, s["mean"], s.below, s.above) == (3, 20.0, 1, 1)


LD = '{"@graph":[{"@type":"ItemList","itemListElement":[{"item":{"@type":"Apartment","name":"N","url":"https://x/1","floorSize":{"value":"60 m2"},"offers":{"price":"R$ 400.000"},"numberOfRooms":2,"image":["//h/p.jpg"],"address":{"neighborhood":"D"}}},{"item":{"@type":"Event"}}]}]}'
ADS = '[{"listId":7,"subject":"S","price":"R$ 10.000","properties":[{"name":"size","value":"50m²"},{"name":"rooms","value":"3"}]},{"listId":7,"subject":"again","properties":[]}]'


def test_pages_to_listings(spark):
    import json

    stream = f'self.__next_f.push([1,{json.dumps(chr(34) + "ads" + chr(34) + ":" + ADS + ",")}])'
    state = json.dumps({"props": {"pageProps": {"initialState": {"houses": {"9": {"title": "H", "salePrice": 5000, "area": 40, "bedrooms": 1}}, "search": {"visible": ["9", "10"]}}}}})
    location = 'push([1,%s])' % json.dumps('"href":"https://x/1?z","address":{"street":"Rua A","streetNumber":"10","neighborhood":"Meireles","latitude":-3.7,"longitude":-38.5,"isApproximateLocation":false},"href":"https://x/2","address":{"street":"$undefined","streetNumber":"000","latitude":99}')
    html = f'<script type="application/ld+json">{LD}</script><script>{stream}</script><script id="__NEXT_DATA__">{state}</script><script>{location}</script><div class="card big"><a href="/u"><img data-src="i.jpg">R$ 300.000 70 m² 2 quartos</a></div>'
    df = frame(spark, [(1, html), (2, None), (3, "")], "page_id long, html string")
    a = pages.json_ld_listings(df, "s").collect()
    assert len(a) == 1 and (a[0].price, a[0].area, a[0].rooms, a[0].district, a[0].photos) == (400_000.0, 60.0, 2, "D", ["https://h/p.jpg"])
    b = pages.streamed_listings(df, "s").collect()
    assert len(b) == 1 and (b[0].listing_id, b[0].title, b[0].area, b[0].rooms) == ("7", "S", 50.0, 3)
    c = pages.state_listings(df, "s").filter("title IS NOT NULL").collect()
    assert len(c) == 1 and (c[0].price, c[0].rooms) == (5000.0, 1)
    d = {r.key: r for r in pages.location_index(df).collect()}
    assert d["https://x/1"].number == "10" and d["https://x/1"].coord_origin == "exact" and d["https://x/2"].number is None and d["https://x/2"].street is None and d["https://x/2"].lat is None
    e = pages.card_listings(df, "s", "card").collect()
    assert len(e) == 1 and (e[0].price, e[0].area, e[0].rooms, e[0].url, e[0].photos) == (300_000.0, 70.0, 2, "/u", ["i.jpg"])
    j = frame(spark, [(1, '{"items":[{"titulo":"T","preco":"1.000","attributes":[{"id":"TOTAL_AREA","value_name":"30 m²"}]}]}'), (2, "bad")], "id long, json string")
    g = pages.flexible_listings(j, "s").collect()
    assert len(g) == 1 and (g[0].title, g[0].price, g[0].area) == ("T", 1000.0, 30.0)
    assert pages.first_non_empty([df.limit(0), df.filter("page_id = 2"), df]).count() == 1


def test_paged_scan_stops(spark):
    asked = []

    def fetch(page):
        asked.append(page)
        if page == 2:
            raise OSError
        return [{"url": f"https://x/{page}"}, {"url": "https://x/1?again"}] if page <= 3 else [{"url": "https://x/1"}]

    rows = list(paged.scan(fetch, 30, 3))
    assert [r["url"] for _, r in rows] == ["https://x/1", "https://x/3"] and asked == [1, 2, 3, 4, 5, 6]
    s = paged.paging_stats(frame(spark, [(p,) for p, _ in rows], "page int"), 30).first()
    assert (s.pages, s.hit_cap, s.new_by_page) == (2, False, {1: 1, 3: 1})


def test_store_keeps_and_deletes_searches(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path))
    at = datetime(2026, 5, 1)
    for i, city in ((1, "São Paulo"), (2, "Rio")):
        store.append_search(frame(spark, [(f"s{i}", city, at)], "search_id string, city string, created_at timestamp_ntz"), frame(spark, [(f"s{i}", city, at, 1.0)], "search_id string, city string, collected_at timestamp_ntz, price double"))
    assert [r.search_id for r in store.searches("sao").collect()] == ["s1"] and store.search("s2")[1].count() == 1
    store.delete_search("s2")
    assert [r.search_id for r in store.searches().collect()] == ["s1"] and store.read("observations").count() == 1
    cache = "kind string, key string, payload string, read_at timestamp_ntz, expires_at timestamp_ntz"
    store.put("identity_cache", frame(spark, [("k", "a", "1", at, at + timedelta(7)), ("k", "b", None, at, at - timedelta(7))], cache), ["kind", "key"], "read_at")
    store.put("identity_cache", frame(spark, [("k", "a", "2", at + timedelta(1), at + timedelta(8))], cache), ["kind", "key"], "read_at")
    assert [(r.key, r.payload) for r in store.cached("k", at).collect()] == [("a", "2")]


def test_guarded_union_against_a_sequential_pass(spark):
    """Random places, names and prices; components joined in tasks and in rounds give what one pass over all pairs in order gives."""
    rng = random.Random(4)
    names = ["solar azul", "solar azull", "vista mar", None, None]
    rows = [(i, "c", "d", rng.choice(["s", "t", None]), rng.choice(["1", "2", None, None]), -3.7 - rng.randint(0, 4) / 1000, -38.5 - rng.randint(0, 4) / 500, rng.choice(names), float(rng.choice([1000, 1100, 2000, 3000]))) for i in range(120)]
    df = frame(spark, rows, "idx long, city_key string, district_key string, street string, number string, lat double, lng double, name string, price_m2 double")
    edges = [(a, b, float(rng.randint(0, 5))) for a in range(120) for b in range(a + 1, 120) if rng.random() < 0.03]
    pairs = frame(spark, edges, "a long, b long, weight double")
    metres = lambda x, y: 2 * 6_371_000 * math.asin(min(1.0, math.sqrt(math.sin(math.radians(y[5] - x[5]) / 2) ** 2 + math.cos(math.radians(x[5])) * math.cos(math.radians(y[5])) * math.sin(math.radians(y[6] - x[6]) / 2) ** 2)))
    g = Grouping()
    for by_place in (True, False):
        group = {i: [r] for i, r in enumerate(rows)}
        root = list(range(120))
        for _, a, b in sorted((w, a, b) for a, b, w in edges):
            x, y = sorted((root[a], root[b]))
            if x == y:
                continue
            one, two = group[x], group[y]
            bare = not any(r[7] or (r[3] and r[4]) for r in one + two)
            m = sorted(statistics.median(r[8] for r in q) for q in (one, two))
            bad = by_place and bare and m[1] / m[0] > g.price_ratio
            bad |= any(p[3] and p[4] and q[4] and p[3] == q[3] and p[4] != q[4] for p in one for q in two)
            bad |= any(metres(p, q) > g.apart_m for p in sorted(one)[:20] for q in sorted(two)[:20])
            have = [{r[7] for r in q if r[7]} for q in (one, two)]
            bad |= all(have) and not any(difflib.SequenceMatcher(None, *(" ".join(sorted(t.split())) for t in (p, q))).ratio() >= 0.9 for p in have[0] for q in have[1])
            if not bad:
                group[x] = one + group.pop(y)
                for r in group[x]:
                    root[r[0]] = x
        want = {i: r for i, r in enumerate(root) if root.count(r) > 1}
        for size in (500_000, 0):
            got = {r.idx: r.root for r in grouping.guarded_union(df, pairs, Grouping(component=size), by_place).collect()}
            assert got == want


def test_five_hundred_rows_at_one_place_are_grouped_in_seconds(spark):
    rows = [place(i, "Rua B" if i % 2 else None, -3.80, -38.60) for i in range(500)]
    df = frame(spark, rows, PLACE)
    start = time.monotonic()
    got = grouping.group_listings(df).collect()
    assert len(got) == 500 and len({r.root for r in got}) == 1
    assert time.monotonic() - start < 40


def test_listings_without_idx_get_their_own(spark):
    """Parsed pages have no idx: each row gets one, nothing is merged for lack of it, and copies across sources still are."""
    columns = "url string, source string, city string, district string, title string, price double, area double, rooms int, photos array<string>"
    one = frame(spark, [(f"https://a/{i}", "a", "C", "Centro", f"Flat {i}", 100_000.0 * (i + 1), 50.0, 2, ["p"]) for i in range(6)], columns)
    two = frame(spark, [("https://b/0", "b", "C", "Centro", "Flat 0", 100_000.0, 50.0, 2, ["q"]), ("https://b/9", "b", "C", "Centro", "House", 900_000.0, 300.0, 4, ["r"])], columns)
    rows = schema.union_sources([one, two])
    ids = [r.idx for r in rows.collect()]
    assert len(set(ids)) == 8 and ids == [r.idx for r in rows.collect()]
    out = {(r.source, r.url): (r.cluster_n, r.photos) for r in dedup.deduplicate(rows).collect()}
    assert len(out) == 7 and out["a", "https://a/0"] == (2, ["p", "q"]) and out["b", "https://b/9"][0] == 1
    with pytest.raises(Exception, match="no idx"):
        dedup.deduplicate(one.withColumn("idx", F.lit(None).cast("long"))).collect()
