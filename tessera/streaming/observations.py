"""Observations as a stream: keyed first and last sight, distinct keys, weekly windows with late data, snapshot differences by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..config import History
from ..functions.text import normalize, url_key
from ..operators.history import snapshot_diff
from ..sources.tables import Store


def distinct_listings(stream: DataFrame, ts: str = "collected_at", late: str = "14 days") -> DataFrame:
    """Each listing once while its state lives; the watermark bounds the state."""
    return stream.withWatermark(ts, late).withColumn("key", url_key(F.col("url"))).dropDuplicatesWithinWatermark(["key"])


def weekly_counts(stream: DataFrame, group: str, value: str, ts: str = "collected_at", late: str = "14 days") -> DataFrame:
    """Tumbling weeks that begin on Monday: n and mean by group; rows later than the watermark are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "7 days", "7 days", "4 days").alias("w"), group).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("week_start"), group, "n", "mean")


DAY = 86_400_000_000


class SeenState(StatefulProcessor):
    """By key: first and last sight and the price last seen (times in microseconds). An older row only lowers first_seen; it never replaces a newer price.

    A key's state goes when the watermark is `keep` days past its last sight, so what is held follows what was seen lately, not all that ever was.
    """

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("seen", "first long, last long, price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        first, last, price = before = held or (None, None, None)
        for b in rows:
            b = b.dropna(subset=["at"])
            if len(b):
                low, high = int(b["at"].min()), int(b["at"].max())
                first = low if first is None else min(first, low)
                if last is None or high > last:
                    last, price = high, float(b.price[b["at"] == high].iloc[0])
        if first is not None:
            self.state.update((first, last, price))
            if last != before[1]:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer((last + self.keep * DAY) // 1000)
            yield pd.DataFrame({"key": [key[0]], "first": [first], "last": [last], "price": [price]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def first_last_stream(stream: DataFrame, late: str = "14 days", keep: int = 60) -> DataFrame:
    """url, collected_at (timestamp) and price to running first and last sight by key, in update mode. Needs the RocksDB state store.

    Rows older than the watermark (`late` behind the newest) are left out; a key not seen for `keep` days (of the watermark) is forgotten and begins anew
    if it comes back. seen_sink keeps what was forgotten.
    """
    timed = stream.withWatermark("collected_at", late)
    keyed = timed.select(url_key(F.col("url")).alias("key"), "collected_at", F.unix_micros("collected_at").alias("at"), F.col("price").cast("double").alias("price")).groupBy("key")
    out = keyed.transformWithStateInPandas(SeenState(keep), outputStructType="key string, first long, last long, price double", outputMode="Update", timeMode="EventTime")
    return out.select("key", F.timestamp_micros("first").alias("first_seen"), F.timestamp_micros("last").alias("last_seen"), "price")


def seen_sink(store: Store, name: str = "seen") -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: puts running sights into a stored table, where the first sight only falls and the last one, with its price, only rises.

    So a key that the stream has forgotten and met again keeps its first sight, and a micro-batch that is done twice changes nothing.
    """

    def merged(batch: DataFrame, table: DataFrame | None) -> DataFrame:
        both = batch if table is None else table.drop("batch").unionByName(batch)
        return both.groupBy("key").agg(F.min("first_seen").alias("first_seen"), F.max_by("price", "last_seen").alias("price"), F.max("last_seen").alias("last_seen"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        store.change(name, lambda table, _: (merged(batch, table), []))

    return handle


class ActivityState(StatefulProcessor):
    """By source, district and share of their listings: when they were last covered, and the active listings' last sights (in microseconds).

    When the watermark has passed the day of a coverage, no row of before can come any more, and listings not seen for `days` before it are inactive; they
    leave the state. A listing seen (again) is active.
    """

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "listing string", "last long")
        self.covered = handle.getValueState("covered", "at long")

    def _rows(self, key, listings: list[tuple[str, int]], active: bool, covered: int) -> pd.DataFrame:
        return pd.DataFrame({"source": key[0], "district": key[1], "listing": [k for k, _ in listings], "last": [t for _, t in listings], "covered": covered, "active": active})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.covered.get()[0] if self.covered.exists() else None
        covered, newest, came = before, {}, []
        for b in rows:
            b = b.dropna(subset=["at"])
            if len(b):
                covered = max(int(b["at"].max()), covered or 0)
                for k, t in b.dropna(subset=["listing"]).groupby("listing")["at"].max().items():
                    newest[k] = max(int(t), newest.get(k, 0))
        for k, t in newest.items():
            held = self.seen.getValue((k,))
            if held is None or held[0] < t:
                self.seen.updateValue((k,), (t,))
            if held is None:
                came.append((k, t))
        if covered is not None and covered != before:
            self.covered.update((covered,))
        if covered is not None and (came or covered != before):
            self.handle.registerTimer((covered // DAY + 1) * DAY // 1000)
        if came:
            yield self._rows(key, came, True, covered)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        covered = self.covered.get()[0]
        gone = [(k[0], t[0]) for k, t in self.seen.iterator() if t[0] < covered - self.days * DAY]
        for k, _ in gone:
            self.seen.removeKey((k,))
        if gone:
            yield self._rows(key, gone, False, covered)

    def close(self) -> None:
        pass


def activity_stream(stream: DataFrame, late: str = "3 days", days: int = History.active_days, shares: int = 8) -> DataFrame:
    """url, source, district and collected_at to changes of listings' activity: listing, source, district, active, last_seen and covered_until.

    A listing is inactive if it was not seen for `days` before its source and district were last covered (by any listing); this is said once the watermark,
    `late` behind the newest row, has passed that day. Listings of a source and district are dealt into `shares`, and each row tells the others its time, so
    that one busy district is not one task's alone. Null sources and districts are sources and districts of their own. Needs the RocksDB state store.
    """
    listing = url_key(F.col("url"))
    rows = stream.withWatermark("collected_at", late).select("source", normalize(F.col("district")).alias("district"), "collected_at", listing.alias("listing"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    own = F.when(F.pmod(F.xxhash64("listing"), F.lit(shares)) == F.col("share"), F.col("listing"))
    keyed = rows.select("source", "district", "share", "collected_at", F.unix_micros("collected_at").alias("at"), own.alias("listing")).groupBy("source", "district", "share")
    out = keyed.transformWithStateInPandas(ActivityState(days), outputStructType="source string, district string, listing string, last long, covered long, active boolean", outputMode="Update", timeMode="EventTime")
    return out.select("listing", "source", "district", "active", F.timestamp_micros("last").alias("last_seen"), F.timestamp_micros("covered").alias("covered_until"))


class RegionState(StatefulProcessor):
    """By state and city: the region that addresses of listings name. The first one learned stays until a page of it doesn't open; then it is forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.region = handle.getValueState("region", "region string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.region.get()[0] if self.region.exists() else None
        events = sorted((int(t), i, bool(f), r) for b in rows for t, i, f, r in zip(b["at"], b["idx"], b["failed"], b["region"], strict=True))
        for t, i, failed, region in events:
            change = (None if known else False) if failed else (region if region and not known else False)
            if change is not False:
                known = change
                yield pd.DataFrame({"state": [key[0]], "city": [key[1]], "region": [known], "at": [t], "idx": [i]})
        if known:
            self.region.update((known,))
        else:
            self.region.clear()

    def close(self) -> None:
        pass


def region_stream(stream: DataFrame, pattern: str, seeds: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """Regions learned from a source's results and forgotten on failure: state, city, region (null: forgotten) and at, a row for each change.

    stream: idx, at (timestamp), state, city, url (of a listing in that city) and failed (a page of the learned region did not open; null counts as no).
    pattern: two groups, state and region, in a listing's address. Cities with a seed neither learn nor forget; a region named `imoveis` is none.
    Within a micro-batch events count in the order of at, then idx.
    """
    state, city = F.lower("state"), F.regexp_replace(normalize(F.col("city")), r"[\s-]+", "-")
    named = F.lower(F.regexp_extract("url", pattern, 2))
    same = F.lower(F.regexp_extract("url", pattern, 1)) == F.col("state")
    rows = stream.select(state.alias("state"), city.alias("city"), F.unix_micros("at").alias("at"), "idx", F.coalesce("failed", F.lit(False)).alias("failed"), "url").filter("at IS NOT NULL AND idx IS NOT NULL")
    for s, c in seeds or {}:
        rows = rows.filter(~((F.col("state") == s) & (F.col("city") == c)))
    region = F.when(same & ~named.isin("", "imoveis"), named)
    keyed = rows.select("state", "city", "at", "idx", "failed", region.alias("region")).filter("failed OR region IS NOT NULL").groupBy("state", "city")
    out = keyed.transformWithStateInPandas(RegionState(), outputStructType="state string, city string, region string, at long, idx long", outputMode="Update", timeMode="None")
    return out.select("state", "city", "region", F.timestamp_micros("at").alias("at"), "idx")


def snapshot_alerts(previous: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], key: str, value: str, source: str, order: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: hands the difference of each micro-batch against the previous snapshot to a sink."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        sink(snapshot_diff(batch, previous(), key, value, source, order), batch_id)

    return handle


class Progress(StreamingQueryListener):
    """Keeps the last progress of each query for as many minutes as asked, for polling."""

    def __init__(self, minutes: int = 15):
        from datetime import timedelta

        self.keep, self.jobs = timedelta(minutes=minutes), {}

    def _note(self, query, state: str, rows: int | None) -> None:
        from datetime import UTC, datetime

        now = datetime.now(UTC)
        self.jobs = {k: v for k, v in self.jobs.items() if now - v["at"] <= self.keep}
        self.jobs[str(query)] = {"state": state, "rows": rows, "at": now}

    def onQueryStarted(self, event) -> None:
        self._note(event.id, "running", None)

    def onQueryProgress(self, event) -> None:
        self._note(event.progress.id, "running", event.progress.numInputRows)

    def onQueryTerminated(self, event) -> None:
        self._note(event.id, "failed" if event.exception else "done", None)
