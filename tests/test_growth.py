"""Work that grows with the input or the result, not with the square of a page or a block."""

from __future__ import annotations

import json
import time
from datetime import datetime

from pyspark.sql import functions as F

from tessera import shared
from tessera.functions import numbers
from tessera.operators import dedup, pairs
from tessera.sources import catalogue, pages, tables


def test_a_state_of_many_houses_is_taken_apart_once(spark):
    n = 12_000
    entry = lambda k: {"title": f"Apto {k}", "salePrice": k, "area": k % 70 + 20, "bedrooms": k % 5, "neighbourhood": "D"}
    state = {"props": {"pageProps": {"initialState": {"houses": {str(k): entry(k) for k in range(n)}, "search": {"visible": [str(k) for k in range(n, -1, -1)]}}}}}
    html = f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(state)}</script>'
    df = spark.createDataFrame([(1, html), (1, html.replace('"D"', '"E"'))], "page_id long, html string")
    began = time.time()
    got = pages.state_listings(df, "s").groupBy("district").agg(F.count("*").alias("n"), F.count_if(F.col("price") == n - F.col("pos")).alias("own")).collect()
    assert time.time() - began < 60
    assert {r.district: (r.n, r.own) for r in got} == {"D": (n, n), "E": (n, n), None: (2, 0)}



def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_tokens_are_listed_behind_the_join(spark):
    word = lambda k: F.element_at(F.array(*map(F.lit, ("north", "south", "east", "bay", None))), (k % 5 + 1).cast("int"))
    k = F.col("id")
    df = spark.range(3000).select((3 * k).alias("idx"), F.when(k % 11 > 0, k % 7).alias("scope"), F.array(word(k), word(k / 5), F.lit("all "), word(k)).alias("ts"))
    got = pairs.token_pairs(df, F.col("ts"), scope=["scope"])
    assert "Exchange" not in _plan(got).split("Join")[0]  # pairs are neither shuffled nor counted by row
    rows = df.select("idx", "scope", F.explode(F.array_distinct(F.filter("ts", lambda t: F.length(t) >= 4))).alias("t"))
    a, b = rows.alias("a"), rows.alias("b")
    want = a.join(b, [F.col("a.t") == F.col("b.t"), F.col("a.scope") == F.col("b.scope"), F.col("a.idx") < F.col("b.idx")]).groupBy(F.col("a.idx").alias("a"), F.col("b.idx").alias("b")).agg(F.count("*").alias("shared"))
    assert got.count() == want.count() and got.exceptAll(want).isEmpty() and got.schema["shared"].dataType == want.schema["shared"].dataType


def _points(spark, n: int, places: int):
    at = F.pmod(F.xxhash64(F.col("id") % places), F.lit(40_000))
    return spark.range(n).select("id", (F.lit(-3.7) - (at % 200) / 20_000).alias("lat"), (F.lit(-38.5) - F.floor(at / 200) / 20_000).alias("lng")).withColumn("lat", F.when(F.col("id") % 50 > 0, F.col("lat")))


def _near(a, b, metres):
    d = numbers.haversine_m(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng"))
    return a.alias("a").crossJoin(b.alias("b")).withColumn("metres", d).filter(F.col("metres") <= metres).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), "metres")


def test_points_in_many_cells_are_not_broadcast(spark):
    a, b = _points(spark, 1500, 600), _points(spark, 900, 150)
    got, want = pairs.near_pairs(a, b, 90), _near(a, b, 90)
    assert "Broadcast" not in _plan(got).split("Exchange hashpartitioning")[0]
    assert got.count() == want.count() > 900 and got.exceptAll(want).isEmpty()


def test_nearest_looks_in_rings(spark):
    a, b = _points(spark, 1500, 600).withColumn("lng", F.when(F.col("id") % 7 == 0, F.col("lng") - 0.007).otherwise(F.col("lng"))), _points(spark, 900, 150)
    got = pairs.nearest(a, b, 500)
    want = _near(a, b, 500).groupBy("a_id").agg(F.min(F.struct("metres", "b_id")).alias("m")).select("a_id", "m.b_id", "m.metres")
    assert "Join [_y" not in _plan(got)  # pairs of points are ranked before ids join
    assert got.count() == want.count() > 900 and got.exceptAll(want).isEmpty() and want.filter("metres > 250").count() > 10


def test_a_name_is_looked_up_in_catalogues_once(spark, tmp_path, monkeypatch):
    counted = {}

    def written(df, name, keep=False):
        out = shared.written(df, name, keep)
        counted[name] = max(counted.get(name, 0), out.count())
        return out

    monkeypatch.setattr(catalogue, "written", written)
    P = catalogue.Provider
    providers = (P("one", "One", "https://one.com", "https://one.com/{city}"), P("two", "Two", "https://two.com", "https://two.com/{city}"))
    names = ["Residencial Bosque", "Residencial Marina", "Residencial Aurora Nova"]
    html = {"https://one.com/sobral": "".join(f'<a href="/{n[-3:]}">{n}</a>' for n in names[:2]), "https://two.com/sobral": "".join(f'<a href="/{n[-3:]}">{n}</a>' for n in names), "https://two.com/ina": "<h1>Marina</h1>", "https://two.com/ova": "<h1>Aurora Nova</h1>"}
    wanted = spark.createDataFrame([(i, "Sobral, CE", names[i % 3]) for i in range(60)], "target_id int, city string, name string")
    found, _ = catalogue.official_references(wanted, spark.createDataFrame([*html.items()], "url string, html string"), tables.Store(spark, str(tmp_path)), datetime(2026, 5, 1), providers)
    assert {(r.target_id, r.url) for r in found.collect()} == {(i, "https://two.com/ina" if i % 3 == 1 else "https://two.com/ova") for i in range(60) if i % 3}
    assert counted["met"] == counted["candidates"] == 5  # not each target with each link that says Residencial


def test_links_within_a_component_are_not_looked_for(spark, monkeypatch):
    counted = []

    def written(df, name, keep=False):
        out = shared.written(df, name, keep)
        counted.append(out.count() if name == "links" else 0)
        return out

    monkeypatch.setattr(dedup, "written", written)
    k = F.col("id")
    rows = spark.range(1200).select(k.alias("idx"), F.lit("Sol").alias("title"), F.concat(F.lit("s"), k % 2).alias("source"), (50_000 + k * 7 % 1200).cast("double").alias("price"), (40 + k * 11 % 1200 / 600).alias("area"), F.lit(2).alias("rooms"), F.lit("Centro").alias("district"))
    [one] = dedup.deduplicate(rows).collect()
    assert (one.idx, one.cluster_n, one.source, one.dup_sources, one.photos) == (0, 1200, "s0", ["s1"], [])
    assert sum(counted) < 180_000  # 360,000 pairs link
