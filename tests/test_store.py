"""The store: versions, broken-off writers, two writers at once, removal of what no version lists."""

from __future__ import annotations

import threading
from datetime import datetime

import pytest

from tessera.sources.tables import Conflict, Store

AT = datetime(2026, 5, 1)
PRICE = "city string, rooms int, price double, at timestamp_ntz"


def price(spark, city: str, value: float, day: int = 1):
    return spark.createDataFrame([(city, 2, value, datetime(2026, 5, day))], PRICE)


def prices(store) -> dict:
    return {r.city: r.price for r in store.read("prices").collect()}


def add(store, spark, search: str, city: str = "Rio"):
    rows = spark.createDataFrame([(search, city, AT, float(i)) for i in range(3)], "search_id string, city string, collected_at timestamp_ntz, price double")
    store.append_search(spark.createDataFrame([(search, city, AT)], "search_id string, city string, created_at timestamp_ntz"), rows)


def test_a_writer_that_dies_before_the_switch_loses_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.put("prices", price(spark, "a", 1.0), ["city", "rooms"], "at")
    add(store, spark, "s1")
    before = store.read("prices")
    died = Store(spark, str(tmp_path))

    def die(*_):
        raise SystemExit

    monkeypatch.setattr(died, "_switch", die)
    for change in (lambda: died.put("prices", price(spark, "a", 2.0, 2), ["city", "rooms"], "at"), lambda: died.delete_search("s1"), lambda: add(died, spark, "s2")):
        with pytest.raises(SystemExit):
            change()
    assert prices(store) == {"a": 1.0} and store.search("s1")[1].count() == 3 and store.read("observations").count() == 3
    assert store.vacuum("prices", hours=0) == 1 and store.vacuum("observations", hours=0) == 1
    assert [r.price for r in before.collect()] == [1.0]
    store.put("prices", price(spark, "a", 3.0, 3), ["city", "rooms"], "at")
    assert prices(store) == {"a": 3.0} and store.version("prices") == 2


def test_two_writers_lose_no_row(spark, tmp_path, monkeypatch):
    one, two = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    one.put("prices", price(spark, "a", 1.0), ["city", "rooms"], "at")
    write, calls = one._write, []

    def late(name, rows, by):  # the other writer comes between this one's read and its switch
        if not calls:
            calls.append(1)
            two.put("prices", price(spark, "b", 2.0), ["city", "rooms"], "at")
            two.append("prices", price(spark, "c", 3.0))
        return write(name, rows, by)

    monkeypatch.setattr(one, "_write", late)
    one.put("prices", price(spark, "a", 4.0, 2), ["city", "rooms"], "at")
    assert prices(one) == {"a": 4.0, "b": 2.0, "c": 3.0}
    assert {r.city: r.price for r in one.read("prices", version=1).collect()} == {"a": 1.0}


def test_many_writers_at_once(spark, tmp_path):
    names = [f"c{i}" for i in range(6)]
    threads = [threading.Thread(target=lambda c=c: Store(spark, str(tmp_path), tries=50).put("prices", price(spark, c, 1.0), ["city", "rooms"], "at")) for c in names]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(prices(Store(spark, str(tmp_path)))) == names


def test_a_writer_that_is_always_late_gives_up(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path), tries=2)
    store.put("prices", price(spark, "a", 1.0), ["city", "rooms"], "at")
    monkeypatch.setattr(store, "version", lambda name: 0)
    with pytest.raises(Conflict):
        store.append("prices", price(spark, "b", 1.0))
    monkeypatch.undo()
    assert prices(store) == {"a": 1.0}


def test_deleting_leaves_other_batches_alone_and_columns_known(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for s in ("s1", "s2"):
        add(store, spark, s)
    kept = store.batches("observations")[1]
    store.delete_search("s1")
    assert kept in store.batches("observations") and store.read("observations").select("search_id").distinct().collect()[0][0] == "s2"
    store.delete_search("s2")
    store.delete_search("none")
    assert store.read("observations").count() == 0 and {"search_id", "city_part", "price"} <= set(store.read("observations").columns)
    assert store.searches("rio").count() == 0
    add(store, spark, "s3", "São Paulo")
    assert store.read("observations").filter("city_part = 'sao-paulo'").count() == 3 and [r.search_id for r in store.searches().collect()] == ["s3"]
    store.vacuum("observations", keep=1, hours=0)
    assert store.read("observations").count() == 3 and len(list((tmp_path / "observations" / "versions").glob("[0-9]*"))) == 1


def test_no_table(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("x") is None and store.read("x", "a int").count() == 0 and store.batches("x") == [] and store.vacuum("x") == 0
