"""The streaming forms on files that arrive as one or several micro-batches."""

from __future__ import annotations

import os
import random
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import history
from tessera.sources.tables import Store
from tessera.streaming import observations as obs

SCHEMA = "url string, collected_at timestamp, price double, source string, idx long"


@pytest.fixture
def stream(spark, tmp_path):
    rows = [("https://x/1?a", datetime(2026, 9, 7), 10.0, "p", 1), ("https://x/1?b", datetime(2026, 9, 9), 12.0, "p", 2), ("https://x/2", datetime(2026, 9, 14), 20.0, "p", 3), ("https://x/1", datetime(2026, 9, 1), 99.0, "p", 4)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i // 2}"))
    both = spark.read.schema(SCHEMA).parquet(*(str(tmp_path / f"in{i}") for i in (0, 1)))
    both.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))


def result(spark, df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def test_weekly_windows_begin_on_monday(spark, stream, tmp_path):
    rows = result(spark, obs.weekly_counts(stream, "source", "price"), tmp_path, "weekly", "complete")
    assert {(r.week_start, r.n) for r in rows} == {(datetime(2026, 8, 31), 1), (datetime(2026, 9, 7), 2), (datetime(2026, 9, 14), 1)}


def test_each_listing_once(spark, stream, tmp_path):
    rows = result(spark, obs.distinct_listings(stream), tmp_path, "once", "append")
    assert sorted(r.key for r in rows) == ["https://x/1", "https://x/2"]


def test_first_and_last_sight(spark, stream, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = result(spark, obs.first_last_stream(stream), tmp_path, "seen", "update")
    got = {r.key: r for r in rows}
    assert got["https://x/1"].first_seen == datetime(2026, 9, 1) and got["https://x/1"].last_seen == datetime(2026, 9, 9) and got["https://x/1"].price == 12.0


def test_alerts_by_micro_batch(spark, stream, tmp_path):
    before, found = spark.createDataFrame([("https://x/2", datetime(2026, 9, 1), 25.0, "p", 1), ("https://x/3", datetime(2026, 9, 1), 1.0, "p", 2)], SCHEMA), []
    handle = obs.snapshot_alerts(lambda: before, lambda df, i: found.append(df.first().asDict()), "url", "price", "source", "idx")
    q = stream.withColumn("url", F.regexp_replace("url", r"\?.*", "")).writeStream.foreachBatch(handle).option("checkpointLocation", str(tmp_path / "alerts")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and found == [{"new": 1, "dropped": 1, "raised": 0, "gone": 1}]


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START = datetime(2026, 1, 1)


def fed(spark, where, batches, schema):
    """A stream that takes each list of rows as one micro-batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    for i, rows in enumerate(batches):
        path = where / f"{i:04d}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
        (part,) = path.glob("part-*")
        (where / "all").mkdir(exist_ok=True)
        target = where / "all" / f"{i:04d}.parquet"
        part.rename(target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(where / "all"))


def run(df, where, handle):
    q = df.writeStream.foreachBatch(handle).outputMode("update").option("checkpointLocation", str(where)).trigger(availableNow=True).start()
    q.awaitTermination(400)
    assert q.exception() is None
    return q


def gather(into):
    return lambda df, i: into.extend((i, r) for r in df.collect())


def test_activity_of_a_stream_is_that_of_the_batch_operator(spark, tmp_path):
    """Rows up to two days late; listings that stop, pause and come back; districts that are covered seldom or no more."""
    schema, rng, batches = "url string, source string, district string, collected_at timestamp, idx long", random.Random(8), []
    for day in range(0, 72, 6):
        rows = []
        for d in range(day, day + 6):
            for n in range(12):
                source, district = "ab"[n % 2], ["Centro", "CENTRO ", "Sul", None][n % 4]
                here = {0: d < 20, 1: d % 24 < 5, 2: True, 3: d < 40 or d > 60, 4: d == 0, 5: d < 50}[n % 6] and (district != "Sul" or d < 45)
                if here and rng.random() < 0.6:
                    rows.append((f"https://x/{source}{n}?q={d}", source, district, START + timedelta(days=d - rng.choice([0, 0, 0, 1, 2]), hours=rng.randint(0, 23)), len(rows)))
        batches.append(rows)
    closing = [("https://x/end", "z", "Z", START + timedelta(days=200), 0)]  # lets the watermark pass all days
    stream = fed(spark, tmp_path / "in", [*batches, closing, [("https://x/end", "z", "Z", START + timedelta(days=201), 1)]], schema)
    got: list = []
    run(obs.activity_stream(stream, late="8 days", shares=3), tmp_path / "at", gather(got))
    final = {}
    for _, r in sorted(got, key=lambda x: (x[0], x[1].last_seen, not x[1].active)):
        final[r.source, r.listing] = r.active
    every = spark.createDataFrame([r for b in batches for r in b], schema).withColumn("key", F.concat("source", F.lit(" "), F.substring_index("url", "?", 1)))
    from tessera.functions.text import normalize

    seen = history.first_last_seen(every.withColumn("district", F.coalesce(normalize(F.col("district")), F.lit("-"))), "key", "collected_at", "idx")
    want = {tuple(r.key.split(" ")): r.active for r in history.with_activity(seen, ["source", "district"]).collect()}
    assert {k: v for k, v in final.items() if k[0] != "z"} == want and 0 < sum(want.values()) < len(want)
    for (_, a), (_, b) in zip(*[iter(sorted((x for x in got if x[1].listing == "https://x/b1"), key=lambda x: (x[0], x[1].last_seen, not x[1].active)))] * 2):
        assert a.active and not b.active  # it comes and goes


def seen_batches(days: int):
    """Each day two listings that are seen on three days and then no more, and one that is always there."""
    rows = lambda d: [(f"https://x/{s}-{n}", START + timedelta(days=d, hours=n), 100.0 + d) for s in range(max(0, d - 2), d + 1) for n in (0, 1)] + [("https://x/stays", START + timedelta(days=d), 1.0 * d)]
    return [[r for d in range(i, min(days, i + 8)) for r in rows(d)] for i in range(0, days, 8)]


def test_state_of_sights_is_bounded_and_survives_a_restart(spark, tmp_path):
    schema, days = "url string, collected_at timestamp, price double", 96
    batches = seen_batches(days)
    stream = fed(spark, tmp_path / "in", batches, schema)
    store, whole = Store(spark, str(tmp_path / "store")), []
    sink = obs.seen_sink(store)
    q = run(obs.first_last_stream(stream, late="4 days", keep=10), tmp_path / "at", lambda df, i: (sink(df.persist(), i), gather(whole)(df, i)))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) < 2 * 2 * 2 * (10 + 4 + 16 + 3) and len({r.key for _, r in whole}) == 2 * days + 1
    table = {r.key: r for r in store.read("seen").collect()}
    assert len(table) == 2 * days + 1
    for r in table.values():
        s = 0 if r.key.endswith("stays") else int(r.key.split("/")[-1].split("-")[0])
        assert r.first_seen.date() == (START + timedelta(days=s)).date() and r.last_seen.date() == (START + timedelta(days=days - 1 if r.key.endswith("stays") else min(days - 1, s + 2))).date()
    # stopped after a third of the files and started again from the checkpoint
    part, split = [], tmp_path / "split"
    (split / "all").mkdir(parents=True)
    files = sorted((tmp_path / "in" / "all").glob("*.parquet"))
    for some in (files[:4], files[4:]):
        for f in some:
            shutil.copy2(f, split / "all" / f.name)
        again = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(split / "all"))
        run(obs.first_last_stream(again, late="4 days", keep=10), tmp_path / "at2", gather(part))
    last = lambda got: {r.key: r for _, r in sorted(got, key=lambda x: (x[0], x[1].last_seen))}
    assert last(part) == last(whole)


def test_regions_are_learned_once_and_forgotten_on_failure(spark, tmp_path):
    schema, rng = "idx long, at timestamp, state string, city string, url string, failed boolean", random.Random(2)
    rows = []
    for i in range(160):
        state, city = rng.choice([("ce", "Sobral"), ("CE", "sobral"), ("sp", "São Paulo"), ("pe", "Recife")])
        failed = rng.random() < 0.2
        url = None if failed else rng.choice([f"https://{state.lower()}.site.com/region-{rng.randint(1, 9)}/imoveis/1", f"https://{state.lower()}.site.com/imoveis/2", "https://zz.site.com/region-0/3", "nonsense"])
        rows.append((i, START + timedelta(minutes=i // 2), state, city, url, failed if failed else rng.choice([False, None])))
    stream = fed(spark, tmp_path / "in", [rows[:50], rows[50:51], rows[51:]], schema)
    got: list = []
    run(obs.region_stream(stream, r"^https?://([a-z]{2})\.site\.com/([a-z0-9-]+)/", {("pe", "recife"): "grande-recife"}), tmp_path / "at", gather(got))
    known, want = {}, []
    for i, _, state, city, url, failed in rows:
        key = state.lower(), {"Sobral": "sobral", "sobral": "sobral", "São Paulo": "sao-paulo"}.get(city)
        if city == "Recife":
            continue
        region = url.split("/")[3] if url and url.startswith(f"https://{key[0]}.") and "/imoveis/2" not in url else None
        if failed and known.pop(key, None):
            want.append((i, *key, None))
        elif not failed and region and key not in known:
            known[key] = region
            want.append((i, *key, region))
    assert sorted((r.idx, r.state, r.city, r.region) for _, r in got) == want and len(want) > 10
