"""A search from sources to the store and back."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from tessera.config import Refining
from tessera.operators.lookup import Target
from tessera.plans.engine import Engine, SearchRequest

ROWS = "idx long, title string, source string, url string, price double, area double, price_m2 double, rooms int, baths int, parking int, district string, address string, city string"


def test_a_search_is_counted_stored_and_found_again(spark, tmp_path):
    rows = [(i, f"Residencial Solar {i}", "a" if i % 2 else "b", f"https://x/{i}", 400_000.0 + 1000 * i, 60.0, (400_000.0 + 1000 * i) / 60, 2, 2, 1, "Meireles" if i % 3 else "Centro", f"Rua Alta, {i // 4 + 1}", "Fortaleza, CE") for i in range(24)]
    rows += [(50, "Para alugar", "a", "https://x/50", 400_000.0, 60.0, None, 2, 2, 1, "Centro", None, "Fortaleza, CE"), (51, "Again", "a", "https://x/1?q", 401_000.0, 60.0, None, 2, 2, 1, "Meireles", None, "Fortaleza, CE"), (52, "Far off", "b", "https://x/52", 499_000.0, 16.0, 31_187.5, 2, 2, 1, "Centro", None, "Fortaleza, CE")]
    df = spark.createDataFrame(rows, ROWS)
    engine, at = Engine(spark, str(tmp_path), refining=Refining(trees=10, impute_trees=5)), datetime(2026, 9, 7, 10)
    engine.set_reference_price("Fortaleza, CE", 2, 6000.0, at)
    request = SearchRequest("Fortaleza, CE", 280_000, 500_000, rooms=2, districts=("Meireles", "Centro"))
    result = engine.search(request, {s: df.filter(f"source = '{s}'") for s in "ab"})
    kept, lost = result.listings.count(), {r.reason: r.n for r in result.funnel.collect()}
    assert kept + sum(lost.values()) == len(rows) and lost["rental"] == 1 and lost["duplicate_url"] == 1 and lost["outlier"] == 1
    assert {r.level for r in result.groups.collect()} == {"same_building"} and result.by_district.count() == 2 and result.extras["reference"] == 6000.0
    assert engine.cached(request, at) is None
    engine.save("s1", request, result, at)
    assert engine.cached(request, at + timedelta(minutes=30)) == "s1" and engine.cached(request, at + timedelta(minutes=90)) is None
    assert engine.evolution("fortaleza").first().n == kept
    assert {r.district for r in engine.district_evolution("FORTALEZA, ce").collect()} == {"Meireles", "Centro"}
    assert tuple(engine.compare_with_previous(result, "s1").first()) == (0, 0, 0, 0)
    address = result.listings.filter("address IS NOT NULL").first().address
    sure, _ = engine.find("Fortaleza", Target(address=address))
    assert {r.address for r in sure.collect()} == {address}
    engine.export(result, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/listings")).count() == kept

    group = result.listings.filter("group_id IS NOT NULL").orderBy("idx").first().group_id
    members = {r.url for r in result.listings.filter(f"group_id = '{group}' AND group_link = 'confirmed'").collect()}
    listed = engine.dossier("Fortaleza", group).collect()
    assert members and members == {r.url for r in listed} and all(r.active for r in listed)
    assert engine.dossier("Fortaleza", "grp_none").count() == 0
    assert [r.spelling for r in engine.districts("Fortaleza").collect()] == ["Centro", "Meireles"]
    assert [r.spelling for r in engine.districts("Fortaleza", "e", chosen=("CENTRO",)).collect()] == ["Meireles"]
    engine.save("s2", request, result, at + timedelta(days=1))
    assert [r.search_id for r in engine.searches("fortal").collect()] == ["s2", "s1"]
    assert engine.stored_search("s1")[1].count() == kept
    assert engine.delete_search("s1") and not engine.delete_search("s1")
    assert [r.search_id for r in engine.searches().collect()] == ["s2"] and engine.stored_search("s1")[1].count() == 0
    assert engine.stored_search("s2")[1].count() == kept


def test_requests_are_validated():
    with pytest.raises(ValueError):
        SearchRequest("Fortaleza", 1, 2)
    with pytest.raises(ValueError):
        SearchRequest("Fortaleza, CE", 3, 2)
